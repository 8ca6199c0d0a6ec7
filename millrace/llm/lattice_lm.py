"""Language-model scores by subword lattice likelihood.

The pieces are those of an existing vocabulary file; their scores are unigram
log-probabilities.  A word's probability is the sum over all ways to cut it into
pieces, found by the forward recursion in log space over the lattice; a text's is
the product over its words and its end.  The vocabulary starts from the scores
that the file's order implies (rank r has weight 1/(r + 20)) and is then weighted
by expectation-maximisation over the word counts of all training texts.

Everything the corpus gives is a table: counts of words (shuffled once, summed
before), and lattice scores computed once for each distinct word.  The most
frequent words, at most ``FREQUENT`` of them, are broadcast; the rest of each
text joins the word table.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ship

VOCABULARY = "piece_bpe_32k.model"
#: Bound of the broadcast word table; words of more bytes than LONGEST_KEY are in it by their digest.
FREQUENT = 100_000
LONGEST_KEY = 64
EM_STEPS = 3
#: Words that a task counts before it passes its counts on.
FLUSH = 400_000
#: Longest word of the vectorised recursion; longer ones take the same recursions one by one.
LONGEST_VECTOR = 40
SMOOTH = 0.1
START = "▁"
#: Bits of a slot's place in the tables of pieces.
_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, Lattice] = {}


def read_pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """Pieces of a sentencepiece file in order of rank; byte pieces as single characters U+DC00 + byte."""
    import sentencepiece

    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    out = [chr(0xDC00 + b) for b in range(256)]
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and START not in piece[1:]:
            out.append(piece)
    return list(dict.fromkeys(out))


class Lattice:
    """Pieces with log-probabilities, and the recursions over words."""

    def __init__(self, pieces: list[str], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        self.longest = max(map(len, pieces))
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.chars = {c for p in pieces for c in p}
        self.hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        # Two open tables, by the top and by the low bits: a slot holds one piece.  The
        # few that find no slot in either go to a sorted rest.
        self.slots, left = [], np.arange(len(pieces))
        for at in map(self._slot, (0, 1)):
            table = np.full(1 << _BITS, -1, dtype=np.int32)
            places = at(self.hashes[left])
            first = np.unique(places, return_index=True)[1]
            table[places[first]] = left[first]
            self.slots.append(table)
            left = np.delete(left, first)
        order = np.argsort(self.hashes[left])
        self.rest, self.rest_hash = left[order], self.hashes[left][order]

    @staticmethod
    def _slot(table: int) -> Callable[[np.ndarray], np.ndarray]:
        if table:
            return lambda h: (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        return lambda h: (h >> np.uint64(64 - _BITS)).astype(np.int64)

    @staticmethod
    def start(pieces: list[str]) -> Lattice:
        """Weights from the ranks of an existing vocabulary."""
        weight = 1 / (np.arange(len(pieces)) + 20.0)
        weight[:256] = 1e-5  # byte pieces come first in the file but are rare
        return Lattice(pieces, np.log(weight / weight.sum()))

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)

    def _hash(self, s: str) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for c in s:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return self._mix(h)[0]

    def spell(self, word: str) -> str:
        """The lattice's string: a start mark, and bytes for characters that no piece has."""
        out = START + word
        if self.chars.issuperset(out):
            return out
        return "".join(c if c in self.chars else "".join(chr(0xDC00 + b) for b in c.encode("utf-8", "surrogatepass")) for c in out)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for none."""
        at = self.slots[0][self._slot(0)(hashes)]
        found = np.where((at >= 0) & (self.hashes[at] == hashes), at, -1)
        at = self.slots[1][self._slot(1)(hashes)]
        found = np.where((at >= 0) & (self.hashes[at] == hashes), at, found)
        if len(self.rest):
            k = np.minimum(np.searchsorted(self.rest_hash, hashes), len(self.rest) - 1)
            found = np.where(self.rest_hash[k] == hashes, self.rest[k], found)
        return found

    def _edges(self, spelled: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For each end j the (start i, ids of the pieces from i to j) that any word has; words of one length."""
        n = len(spelled[0])
        codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
        edges: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        h = np.zeros((n, len(spelled)), dtype=np.uint64)
        for k in range(min(n, self.longest)):
            h = h[: n - k] * _BASE + codes[k:]
            found = self.lookup(self._mix(h))
            for i in np.nonzero((found >= 0).any(1))[0]:
                edges[i + k + 1].append((int(i), found[i]))
        return edges

    @staticmethod
    def _sum(parts: list[np.ndarray]) -> np.ndarray:
        if len(parts) == 1:
            return parts[0]
        x = np.stack(parts)
        top = x.max(0)
        top[top == -np.inf] = 0
        x -= top
        np.exp(x, out=x)
        with np.errstate(divide="ignore"):
            return top + np.log(x.sum(0))

    def batch(self, spelled: list[str], weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log-probabilities of words of one length; adds expected piece counts, if asked."""
        n = len(spelled[0])
        logp = np.append(self.logp, -np.inf)
        edges = [[(i, at, logp[at]) for i, at in row] for row in self._edges(spelled)]
        forward = [np.zeros(len(spelled))]
        for j in range(1, n + 1):
            forward.append(self._sum([forward[i] + score for i, _, score in edges[j]]))
        if expected is not None:
            back: list[list[np.ndarray]] = [[] for _ in range(n)]
            with np.errstate(divide="ignore"):
                log_weight = np.log(weights)
            for j in range(n, 0, -1):
                after = self._sum(back[j]) if j < n else log_weight - forward[n]
                for i, at, score in edges[j]:
                    path = score + after
                    back[i].append(path)
                    live = at >= 0
                    expected += np.bincount(at[live], weights=np.exp(forward[i] + path)[live], minlength=len(expected))
        return forward[n]

    def long(self, spelled: str, weight: float = 0.0, expected: np.ndarray | None = None) -> float:
        """The same recursions over the whole of a long word; expected counts need both, each in one pass."""
        forward, n = [0.0], len(spelled)
        for j in range(1, n + 1):
            parts = []
            for k in range(1, min(j, self.longest) + 1):
                at = self.ids.get(spelled[j - k : j])
                if at is not None:
                    parts.append(forward[j - k] + self.logp[at])
            top = max(parts)
            forward.append(top + math.log(sum(math.exp(p - top) for p in parts)))
        if expected is not None and weight > 0:
            # back[i]: log of the weight of all ways from i to the end.
            back = [0.0] * n + [math.log(weight) - forward[n]]
            for i in range(n - 1, -1, -1):
                parts = []
                for k in range(1, min(n - i, self.longest) + 1):
                    at = self.ids.get(spelled[i : i + k])
                    if at is not None:
                        path = self.logp[at] + back[i + k]
                        parts.append(path)
                        expected[at] += math.exp(forward[i] + path)
                top = max(parts)
                back[i] = top + math.log(sum(math.exp(p - top) for p in parts))
        return float(forward[n])

    def score(self, words: list[str], weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each word; adds expected piece counts, if asked."""
        out = np.zeros(len(words))
        groups: dict[int, list[int]] = {}
        spelled = [self.spell(w) for w in words]
        for i, s in enumerate(spelled):
            groups.setdefault(len(s), []).append(i)
        for n, rows in groups.items():
            if n > LONGEST_VECTOR:
                for i in rows:
                    out[i] = self.long(spelled[i], 0.0 if weights is None else float(weights[i]), expected)
                continue
            size = max(1, 60_000 // n)
            for at in range(0, len(rows), size):
                pick = rows[at : at + size]
                out[pick] = self.batch([spelled[i] for i in pick], None if weights is None else weights[pick], expected)
        return out


def key_of(word: bytes) -> bytes:
    """The word's key in the broadcast table: itself, or 0xFF (no byte of UTF-8) and its digest."""
    return word if len(word) <= LONGEST_KEY else b"\xff" + hashlib.md5(word, usedforsecurity=False).digest()


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``rows`` rows, which the vectorised recursion needs to pay."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c, seen): counts in training texts (column ``train``) and whether seen at all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for train, part in enumerate(counts):
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(list(part), type=pa.binary()), pa.array([v * train for v in part.values()], type=pa.int64())], names=["word", "c"])
                part.clear()

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1), strict=True):
                counts[train.as_py()].update((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield from out()
        yield from out()

    return docs.select(F.col("text").cast("string"), "train").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _lattice_of(key: str, pieces: list[str], logp: np.ndarray) -> Lattice:
    """One lattice a worker and model."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = Lattice(pieces, logp)
    return _tables[key]


def fit(spark: SparkSession, words: DataFrame, ends: int, vocabulary: str = VOCABULARY, steps: int = EM_STEPS) -> tuple[Lattice, float]:
    """Piece weights by expectation-maximisation over all counted words; also the end's log-probability."""
    pieces = read_pieces(vocabulary)
    lattice, end = Lattice.start(pieces), math.log(0.05)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, pieces, lattice.logp))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = _lattice_of(*shared.value)
            expected = np.zeros(len(own.pieces))
            for batch in _gathered(batches):
                c = batch.column(1).to_numpy().astype(float)
                own.score([_text(w) for w in batch.column(0).to_pylist()], c, expected)
            live = np.nonzero(expected)[0]
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(expected[live])], names=["piece", "n"])

        # One row a piece at most reaches the driver.
        rows = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(len(pieces), SMOOTH)
        for r in rows:
            n[r["piece"]] += r["n"]
        total = n.sum() + ends + SMOOTH
        lattice, end = Lattice(pieces, np.log(n / total)), math.log((ends + SMOOTH) / total)
        shared.unpersist()
    return lattice, end


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, steps: int = EM_STEPS, frequent: int = FREQUENT) -> DataFrame:
    """Score whole texts (columns doc_id, text, train) with counts learnt where ``train`` is true.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (add-half
    unigram word model) and score (lattice), both log10.  Null text counts as
    empty: an end alone.  Every row gives a row, and repeated rows equal ones; null
    ``train`` is false.  Other columns, whatever their names, are ignored.  An empty
    table gives an empty result.  Without a training row all pieces weigh alike
    (``steps`` > 0) or as the file's order says (``steps`` = 0).
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce("train", F.lit(False)).alias("train"))
    counted = materialize(count_words(docs))
    n_words, n_types = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = docs.where("train").count()
    n_all, v_all = n_words + ends, n_types + (ends > 0)
    whole = n_all + 0.5 * (v_all + 1)
    base_end = math.log10((ends + 0.5) / whole)
    lattice, end = fit(spark, counted, ends, vocabulary, steps)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, lattice.pieces, lattice.logp))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lattice_of(*model.value)
        for batch in _gathered(batches):
            score = own.score([_text(w) for w in batch.column(0).to_pylist()]) / math.log(10)
            base = np.log10((batch.column(1).to_numpy() + 0.5) / whole)
            table = pa.table([*batch.columns, pa.array(base), pa.array(score)], names=["word", "c", "base", "lattice"])
            yield from table.to_batches(max_chunksize=10_000)

    words = materialize(counted.mapInArrow(weigh, "word binary, c long, base double, lattice double"))
    discard(counted)
    # The counts from which on a word is frequent: a histogram of at most 512 steps.
    step = F.floor(F.log2(F.col("c") + 1) * 8)
    least, many = math.inf, 0
    for r in words.where(F.col("c") > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        many += r["n"]
        if many > frequent:
            break
        least = r["step"]
    common = words.where(step >= least) if least < math.inf else words.where("false")
    key = F.when(F.octet_length("word") <= LONGEST_KEY, F.col("word")).otherwise(F.concat(F.unhex(F.lit("FF")), F.unhex(F.md5("word"))))
    known = spark.sparkContext.broadcast({bytes(r["key"]): (r["base"], r["lattice"]) for r in common.select(key.alias("key"), "base", "lattice").toLocalIterator()})
    own_end = end / math.log(10)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in range(4)]
                rare_words, rare_counts, offsets = [], [], [0]
                for text in part.column(1):
                    words_of = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                    base, score, hits = base_end, own_end, 1 if ends else 0
                    for word, tf in Counter(words_of).items():
                        found = get(key_of(word))
                        if found is None:
                            rare_words.append(word)
                            rare_counts.append(tf)
                        else:
                            base += tf * found[0]
                            score += tf * found[1]
                            hits += tf
                    offsets.append(len(rare_words))
                    for column, value in zip(columns, (len(words_of) + 1, hits, base, score), strict=True):
                        column.append(value)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(x, type=t)) for x, t in ((rare_words, pa.binary()), (rare_counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.int64()), pa.array(columns[2], type=pa.float64()), pa.array(columns[3], type=pa.float64()), *lists], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "words", "tfs"])

    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, tfs array<long>"
    parts = materialize(docs.mapInArrow(split, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("words", "tfs")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.tfs").alias("tf"))
    added = (
        rare.join(words, "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.col("base")).alias("b"), F.sum(F.col("tf") * F.col("lattice")).alias("s"))
    )
    zero = F.lit(0)
    return parts.join(added, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
