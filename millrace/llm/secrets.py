"""Secret scans: base patterns, and character Markov models for unlabelled random strings.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: random strings come from a
seeded generator over the usual key alphabets, identifiers from a bounded sample
of words of the corpus in which no base pattern matches, cut and joined as code
does it.  A token is reported if its mean log-likelihood ratio a character passes
a threshold that no identifier of about its length in a held-back part of the
sample passes.  Tokens of fewer than MIN_TOKEN characters are too short to tell, and
those without a letter are ordinary numbers; neither is judged.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, words_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without one of these cannot match ``ASSIGN``.
_HINTS = ("passw", "secret", "token", "api_key", "apikey")
#: Tokens that the models judge: at least MIN_TOKEN characters, as the random strings of the training have, with a letter.
MIN_TOKEN = 16
#: Least lengths of the classes of tokens that have a threshold each.
LENGTHS = (16, 20, 24, 32)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
CHARS = string.ascii_letters + string.digits + "+/_=-"
#: Bounds of the sample that the identifier model learns from: documents, words of them, and bytes of a word.
SAMPLE_DOCS = 2000
SAMPLE_WORDS = 200_000
SAMPLE_WORD_BYTES = 128
RANDOM_STRINGS = 20_000
#: Least threshold of the mean log-likelihood ratio, in nats a character.
MIN_RATIO = 0.35
_INDEX = np.full(128, -1, dtype=np.int64)
_INDEX[[ord(c) for c in CHARS]] = np.arange(len(CHARS))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Markov:
    """First-order character model with a start state and add-one smoothing."""

    def __init__(self, strings: list[str]) -> None:
        n = len(CHARS)
        counts = np.ones((n + 1, n))
        for s in strings:
            at = _INDEX[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]
            if len(at) and (at >= 0).all():
                np.add.at(counts, (np.concatenate([[n], at[:-1]]), at), 1)
        self.log = np.log(counts / counts.sum(1, keepdims=True))


class Detector:
    """Log-likelihood ratio of random strings against ordinary identifiers."""

    def __init__(self, randoms: list[str], ordinary: list[str], min_ratio: float = MIN_RATIO) -> None:
        held = ordinary[::5]
        kept = [s for i, s in enumerate(ordinary) if i % 5]
        self.ratio_of = Markov(randoms).log - Markov(kept).log
        tops = [min_ratio - 0.05] * len(LENGTHS)
        for s in held:
            if len(s) >= MIN_TOKEN:
                k = bisect.bisect_right(LENGTHS, len(s)) - 1
                tops[k] = max(tops[k], self.ratio(s))
        self.thresholds = [max(min_ratio, min(top + 0.05, 1.2)) for top in tops]

    def ratio(self, token: str) -> float:
        at = _INDEX[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
        return float(self.ratio_of[np.concatenate([[len(CHARS)], at[:-1]]), at].mean())

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Added spans: judged tokens that no base span covers."""
        out = []
        for m in TOKEN.finditer(text):
            token = m[0]
            if not any(c.isalpha() for c in token):
                continue
            if any(s <= m.start() and m.end() <= e for s, e, _ in base):
                continue
            if self.ratio(token) > self.thresholds[bisect.bisect_right(LENGTHS, len(token)) - 1]:
                out.append((m.start(), m.end(), "random"))
        return out


def random_strings(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """The labelled sample of random strings: hex, base-64, base-62 and upper-case keys."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-")
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 64))) for i in range(n)]


def identifiers(words: list[str], seed: int = 11) -> list[str]:
    """The labelled sample of ordinary strings: words alone and joined as code and paths join them."""
    rng = random.Random(seed)
    plain = [w for w in (re.sub(r"[^A-Za-z]", "", w) for w in words) if w] or ["value", "index", "name", "count", "item"]
    out = list(plain)
    for i in range(min(len(plain), 40_000)):
        some = [rng.choice(plain) for _ in range(rng.randint(2, 5))]
        end = str(rng.randint(0, 9999)) if rng.random() < 0.5 else ""
        joined = (some[0] + "".join(x.title() for x in some[1:]), "_".join(some), "-".join(some).lower(), "/".join(some), "_".join(some).upper())[i % 5]
        out.append(joined + ("_" if end and rng.random() < 0.5 else "") + end)
    return [s for s in out if s.isascii()]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Detector:
    """Fit both models; about ``sample_docs`` documents, chosen by hash, give words.

    Without a word, as in an empty table, a few plain identifiers stand in.
    """
    n = docs.count()
    part = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    if n > sample_docs:
        part = part.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (sample_docs << 40) // n)
    # Every fourth word by hash, from anywhere in the whole texts, in an order of hashes, so that partitioning changes nothing.
    words = part.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("at", "word")).where(F.octet_length("word") <= SAMPLE_WORD_BYTES)
    some = words.select("word", F.xxhash64("doc_id", "at", "word").alias("h")).where("pmod(h, 4) = 0").orderBy("h", "word").limit(SAMPLE_WORDS)
    return Detector(random_strings(), identifiers(sorted(r["word"] for r in some.collect() if not base_spans(r["word"]))))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, detector: Detector, mask: str = "[SECRET]", with_text: bool = False) -> DataFrame:
    """Spans of every whole text, in code points: doc_id, n_assign, n_access, n_hex, base, spans[, text].

    ``with_text`` adds the text with each span replaced by ``mask`` and, unchanged,
    the other columns of ``docs``.  Null text has no spans and stays null; columns
    named as the operator's own are replaced; repeated rows get equal results; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_assign", "n_access", "n_hex", "base", "spans")] if with_text else []
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *rest)
    found = ["n_assign", "n_access", "n_hex"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_of, all_of, texts = [[], [], []], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text or "")
                spans = base + detector.spans(text or "", base)
                for column, kind in zip(counts, KINDS, strict=False):
                    column.append(sum(k == kind for _, _, k in base))
                base_of.append(joined(base))
                all_of.append(joined(spans))
                if with_text:
                    texts.append(masked(text, spans, mask) if text and spans else text)
            columns = [batch.column(0), *(pa.array(c, type=pa.int64()) for c in counts), pa.array(base_of, type=pa.string()), pa.array(all_of, type=pa.string())]
            if with_text:
                columns += [pa.array(texts, type=pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *found, "base", "spans", *["text"] * with_text, *rest])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    if with_text:
        schema += ", text string" + "".join(f", `{c}` {source.schema[c].dataType.simpleString()}" for c in rest)
    return source.mapInArrow(scan, schema)


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
