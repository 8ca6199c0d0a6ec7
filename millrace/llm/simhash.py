"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments (22, 21 and 21 bits), read as
words of the perfect binary (23, 12) Golay code: every word lies within three
bits of exactly one codeword.  Two segments that differ in one bit share a key if
one side gives the index of its own codeword and the other side the indices of
all words within one bit (six at most, as most neighbours decode alike); two that
differ in two bits share one if both sides give the latter, as the word between
them decodes to it.

Of at most four differing bits, the two segments with the fewest have at most two
together: one each at most, or two and none.  So for each pair of segments there
are keys of two kinds, each of 24 bits or more:

* both within one bit: (own index of the one, near index of the other) on one
  side and (near, own) on the other;
* one equal, the other two bits off: (the equal segment, near index).

Joining on the keys loses no link; the exact distance is part of the join
condition, with the first kind and pair of segments that finds a pair, so that a
pair is emitted once or a few times however many keys it shares.  Equal
fingerprints are one node, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
HOT = 1000
#: (shift, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the (23, 12) Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the whole text's word shingles (no word: 0)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hashed(joined, SEED)
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=False)), dtype="<u8", count=n)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255):  # so that a byte holds each count
        set_bits += np.unpackbits(hashes[at : at + 255].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint8)
    return int(np.packbits(set_bits * 2 > n).view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text, in one pass."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, fp long")


class Golay:
    """Indices of the nearest codewords, by syndrome tables of 2,048 and 4,096 entries."""

    def __init__(self) -> None:
        parts = np.arange(1 << 12, dtype=np.int64)
        self.low, self.high = self._syndrome(parts), self._syndrome(parts << 12)
        errors = [0, *(1 << i for i in range(23))]
        errors += [1 << i | 1 << j for i in range(23) for j in range(i)]
        errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        fix = np.array(errors, dtype=np.int64)
        self.fix = np.empty(1 << 11, dtype=np.int64)
        self.fix[self._syndrome(fix)] = fix

    @staticmethod
    def _syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i in range(23, 10, -1):
            x ^= np.where(x >> i & 1, GENERATOR << (i - 11), 0)
        return x

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword within three bits of each 23-bit word."""
        return (words ^ self.fix[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index), without repeats: the indices of all words within one of ``width`` bits."""
        around = np.stack([words, *(words ^ (1 << i) for i in range(width))], axis=1)
        found = np.sort(self.index(around), axis=1)
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(new)[0], found[new]


_golay: list[Golay] = []


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key) of unsigned fingerprints.  side 0: left, 1: right, 2: both."""
    if not _golay:
        _golay.append(Golay())
    golay = _golay[0]
    seg = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    own = [golay.index(x) for x in seg]
    near = [golay.near(x, w) for x, (_, w) in zip(seg, SEGMENTS, strict=True)]
    rows, sides, keys = [], [], []

    def put(row: np.ndarray, side: int, kind: int, high: np.ndarray, low: np.ndarray) -> None:
        rows.append(row)
        sides.append(np.full(len(row), side, dtype=np.int8))
        keys.append(np.int64(kind) << 40 | high << 12 | low)

    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        put(near[j][0], 0, kind, own[i][near[j][0]], near[j][1])
        put(near[i][0], 1, kind, near[i][1], own[j][near[i][0]])
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 3):
        put(near[i][0], 2, kind, seg[j][near[i][0]], near[i][1])
    return np.concatenate(rows), np.concatenate(sides), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    """(fp, tag) -> (fp, tag, side, key): a row for each key of a fingerprint."""
    ship(fps.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, side, key = keys_of(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns), pa.array(side), pa.array(key)], names=["fp", "tag", "side", "key"])

    return fps.select("fp", "tag").mapInArrow(of, "fp long, tag long, side byte, key long")


def _bits(x: Column, segment: int) -> Column:
    shift, width = SEGMENTS[segment]
    return F.bit_count(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << width) - 1)))


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v), structs of (fp, tag), of different fingerprints at 4 or fewer differing bits.

    fp is distinct; tag is a long that goes with it and may be null.
    """
    keyed = materialize(_keyed(fps))
    a = keyed.where("side <> 1").select("key", F.col("fp").alias("u"), F.col("tag").alias("u_tag"))
    b = keyed.where("side <> 0").select(F.col("key").alias("key2"), F.col("fp").alias("v"), F.col("tag").alias("v_tag"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    e = [_bits(x, i) for i in range(3)]
    one = [(e[i] <= 1) & (e[j] <= 1) for i, j in ((0, 1), (0, 2), (1, 2))]
    first = F.when(one[0], 0).when(one[1], 1).when(one[2], 2)
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 3):
        first = first.when((e[i] == 2) & (e[j] == 0), k)
    # The exact check is part of the join condition: only links leave the join.
    found = a.join(b, (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & (F.bit_count(x) <= MAX_BITS) & (first == F.shiftright("key", 40)))
    end = lambda c: F.struct(F.col(c).alias("fp"), F.col(f"{c}_tag").alias("tag")).alias(c)
    out = materialize(found.select("u", "v", "u_tag", "v_tag").distinct().select(end("u"), end("v")))
    discard(keyed)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links of fingerprints.

    Null and word-less texts have fingerprint 0 and link like any other.  Every
    input row gives a row, repeated doc_ids too; rows without doc_id take no part
    in the smallest id.  Other columns, whatever their names, are ignored.  An empty
    table gives an empty result.
    """
    own = materialize(fingerprints(docs))
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("tag"), F.count("*").alias("n")))
    # A node is ordered by its least doc_id, so the least node of a component carries the answer and no group is gathered by its root.
    node = lambda c: F.struct(F.col(f"{c}.tag").isNull().alias("none"), F.col(f"{c}.tag").alias("tag"), F.col(f"{c}.fp").alias("fp")).alias(c)
    root = components(links(least).select(node("u"), node("v")))
    found = root.select(F.col("node.fp").alias("fp"), F.col("root.tag").alias("root_tag"), F.lit(True).alias("linked"))
    named = materialize(least.join(found, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("root_tag")).otherwise(F.col("tag")).alias("component_id")))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Fewer than HOT fingerprints can have more than a HOT-th of the rows each, so these are broadcast and no key of the other join is hot.
    is_hot = F.col("n") * HOT > total
    hot = F.broadcast(named.where(is_hot).drop("n"))
    cold = named.where(~is_hot).drop("n")
    few = own.join(hot, "fp")
    rest = own.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp")
    return few.union(rest).select("doc_id", "fp", "component_id")
