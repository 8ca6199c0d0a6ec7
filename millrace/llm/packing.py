"""Best-fit packing of token sequences by minimum bin slack.

The plan of the bins depends only on how many pieces there are of each length,
so it is made on the driver from a histogram of at most ``capacity`` numbers,
whatever the size of the corpus.  Each bin is seeded with the longest piece
left; a bitset subset-sum dynamic programme over the lengths that are left finds
the fullest combination for the rest, and that combination is removed as often
as the counts allow.  Every repetition uses up a length, so there are at most
``capacity`` different bins.  The pieces then find their places by their rank
among the pieces of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Ranks are counted in parts of about this many pieces a length, so that no length is hot; and the least parts of a length.
PART_PIECES = 50_000
LEAST_PARTS = 8
#: The public pre-tokenisation pattern of this byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: ``tiktoken`` panics on runs of white space of about a million characters; texts with a run of this many are left to ``tokenizers``.
LONG_RUN = 100_000
_RUN = re.compile(r"\s+")
_PROBE = "It's  a\t\n test, of 1234 ids\r\néß 你好 <|x|> \U0001f600x"
_encoders: dict = {}


def tokenizer_path(path: str) -> str:
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def encoder(path: str = TOKENIZER):
    """A function from texts to id lists for a byte-level BPE file of ``tokenizers``.

    The vocabulary of that file runs in ``tiktoken``, which gives the same ids
    four times faster; a probe is compared when the file is loaded, and on any
    difference ``tokenizers`` itself encodes, as it does texts that hold one of the
    file's added tokens (such as ``<|endoftext|>``) or a very long run of white space.
    """
    if path in _encoders:
        return _encoders[path]
    import tiktoken
    from tokenizers import Tokenizer

    where = tokenizer_path(path)
    slow = Tokenizer.from_file(where)

    def by_tokenizers(texts: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids for t in texts]

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in visible}
    chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    with open(where, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens") or []]
    ranks = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in chars for c in k) and k not in added}
    out = by_tokenizers
    if len({len(r) == 1 and r for r in ranks}) == 257:  # every byte has a rank
        fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def left(t: str) -> bool:
            return any(a in t for a in added) or (len(t) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _RUN.finditer(t)))

        def by_ranks(texts: list[str]) -> list[list[int]]:
            return [by_tokenizers([t])[0] if left(t) else fast.encode_ordinary(t) for t in texts]

        if by_ranks([_PROBE]) == by_tokenizers([_PROBE]):
            out = by_ranks
    _encoders[path] = out
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but perhaps the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: doc_id, piece, start, length, ids_crc32 [, ids].

    Null text counts as empty: one piece that holds the end id alone.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            docs_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(docs_ids), 64):
                rows: list[list] = [[] for _ in schema]
                for doc_id, ids in zip(docs_ids[at : at + 64], encode([t or "" for t in texts.slice(at, 64).to_pylist()]), strict=True):
                    ids.append(end_id)
                    raw = np.array(ids, dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        part = raw[start : start + length]
                        row = (doc_id, k, start, length, zlib.crc32(part.tobytes()), part.astype("<i4"))
                        for column, value in zip(rows, row, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    sql = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, sql)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ([(length, how many)], repetitions) that use up ``counts`` exactly."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_, room = {seed: 1}, capacity - seed
        if room:
            for length, n in fullest(left, room).items():
                bin_[length] = bin_.get(length, 0) + n
        left[seed] += 1
        times = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((sorted(bin_.items(), reverse=True), times))
    return plan


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, by bitset subset sums."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((k for k, v in counts.items() if v and k <= room), reverse=True):
        n, k = min(counts[length], room // length), 1
        while n:
            k = min(k, n)
            after = (reach | reach << (length * k)) & mask
            if after != reach:
                steps.append((reach, length, k))
                reach = after
            n, k = n - k, k * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Places by (length, rank): sorted keys and, for each, where its run of ranks goes."""
    taken: dict[int, int] = {}
    rows, bin_id = [], 0
    for bin_, times in plan:
        at = 0
        for length, n in bin_:
            base = taken.get(length, 0)
            rows.append((length << 40 | base, base, n, bin_id, at))
            taken[length] = base + n * times
            at += length * n
        bin_id += times
    rows.sort()
    names = ("key", "base", "n", "bin", "at")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (column ``length``).

    ``pieces`` must be stable between reads, as a written table is.  Pieces as long
    as a sequence are one each, with a negative number, and cross no shuffle.
    Repeated rows get places of their own; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    ship(spark)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    order = [c for c in names if c != "ids"]
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") != capacity)
    counts = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(slots(plan_bins(counts, capacity)))
    parts = [max(LEAST_PARTS, -(-counts.get(k + 1, 0) // PART_PIECES)) for k in range(capacity)]
    salted = rest.select(*names, F.pmod(F.xxhash64(*order), F.element_at(F.lit(parts), F.col("length").cast("int"))).cast("int").alias("_salt"))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # The pieces are dealt by (length, _salt) for their ranks, so the join moves the counts alone.
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))).join(before.drop("_n"), ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            i = np.searchsorted(t["key"], length << 40 | rank, side="right") - 1
            k = rank - t["base"][i]
            columns = [*batch.columns[:-1], pa.array(t["bin"][i] + k // t["n"][i]), pa.array(t["at"][i] + k % t["n"][i] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    return full.union(ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and pack them; ``with_ids`` carries the ids of each piece."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity, with_ids=with_ids)), capacity)
