"""Embedding near-duplicates by product quantisation with exact guarantees.

Vectors are normalised; a cosine of at least t means a distance of at most
``d = sqrt(2 - 2t)``.  A bounded sample trains coarse centroids and, on the
residuals, a codebook for each subspace; every vector is then indexed.

* Sufficient probes: if y lies in list c and x in list a, the distance of x to the
  plane between both centroids is at most |x - y|.  So x probes the lists whose
  plane is within d, and no link is lost.
* Asymmetric table look-up: the estimate |x - y'| of a coded y' errs by at most
  |y - y'|, which is stored with y.  Candidates beyond d plus that error are
  dropped, and no link is lost.
* The rest is compared by exact cosine in double precision.

Equal vectors of a label are one node.  Lists are dealt in blocks, so that no
task holds a whole list, and a block passes on counts of links and the edges of a
spanning forest rather than all its pairs.

Every dimension has an index of its own.  Its lists number a quarter of the root of
its vectors, and an eighth of its share of the sample at most: a larger table wants
a larger ``sample``, or its lists grow in proportion to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .graph import components

COSINE = 0.98
#: Bound of the sample that trains the centroids and codebooks, over all dimensions, and its least part for one.
SAMPLE = 20_000
LEAST_SAMPLE = 256
SUBSPACES = 8
CODES = 16
#: Rows of one side of a block.
BLOCK = 2048
SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks of one dimension."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 3) -> None:
        self.coarse = _kmeans(x, lists, seed)
        c = self.coarse
        # Rounded up a little, as a distance by inner products is less exact than one by differences.
        self.apart = np.sqrt(np.maximum(self._squares(c), 0)) + SLACK
        residual = x - c[self._squares(x).argmin(1)]
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))]
        self.books = [_kmeans(residual[:, p], CODES, seed + 1 + i) for i, p in enumerate(self.parts)]

    def _squares(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T

    def assign(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, coding error, and which lists to probe, of normalised vectors."""
        squares = self._squares(x)
        own = squares.argmin(1)
        residual = x - self.coarse[own]
        codes = np.stack([((residual[:, None, p] - b[None]) ** 2).sum(2).argmin(1) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        error = np.sqrt(((residual - coded) ** 2).sum(1))
        gap = squares - squares[np.arange(len(x)), own][:, None]
        return own, codes, error, gap <= 2 * self.apart[own] * (reach + SLACK)

    def estimates(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors x to the coded vectors of list ``at``, by tables of each x."""
        residual = x - self.coarse[at]
        out = np.zeros((len(x), len(codes)))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            table = ((residual[:, None, p] - b[None]) ** 2).sum(2)
            out += table[:, codes[:, i]]
        return np.sqrt(out)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def train(classes: DataFrame, sample: int = SAMPLE) -> dict[int, Index]:
    """An index for each dimension, from a sample picked by hash that gives each an equal share."""
    dim = F.size("v")
    # One row a dimension.
    counts = {r["d"]: r["n"] for r in classes.groupBy(dim.alias("d")).agg(F.count("*").alias("n")).collect()}
    each = max(LEAST_SAMPLE, sample // max(1, len(counts)))
    share = F.lit(0)
    for d, n in counts.items():
        share = F.when(dim == d, 1 << 40 if n <= each else (each << 40) // n).otherwise(share)
    by_dim: dict[int, list] = {}
    for row in classes.where(F.pmod(F.xxhash64("k1"), F.lit(1 << 40)) < share).select("cid", "v").orderBy("cid", "v").collect():
        by_dim.setdefault(len(row["v"]), []).append(row["v"])
    lists = lambda d: max(1, min(len(by_dim[d]) // 8, round(math.sqrt(counts[d]) / 4)))
    return {d: Index(_unit([np.array(v, dtype="<f8").tobytes() for v in x]), lists(d)) for d, x in by_dim.items()}


def joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots of a forest after joining the ends u[k] and v[k] of links; each root is the least of its tree."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, least = u[apart], v[apart], np.minimum(a, b)[apart]
        np.minimum.at(root, a[apart], least)
        np.minimum.at(root, b[apart], least)
        while (root[root] != root).any():
            root = root[root]


def _cell(index: dict[int, Index], cosine: float, table: pa.Table) -> pa.Table:
    """One block: links of its probes (role 1) with its stored vectors (role 0)."""
    role = table["role"].to_numpy()
    stored, probes = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
    rows: list[tuple[int, int, int]] = []
    if stored.num_rows and probes.num_rows:
        reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        at = table["list"][0].as_py()
        y, x = _unit(stored["vec"].to_pylist()), _unit(probes["vec"].to_pylist())
        y_id, x_id = stored["cid"].to_numpy(), probes["cid"].to_numpy()
        y_n, x_n = stored["n"].to_numpy(), probes["n"].to_numpy()
        own = index.get(y.shape[1])
        codes = np.frombuffer(b"".join(stored["codes"].to_pylist()), dtype=np.uint8).reshape(len(y), -1)
        error = stored["error"].to_numpy()
        x_links, y_links = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        ids, place = np.unique(np.concatenate([x_id, y_id]), return_inverse=True)
        root = np.arange(len(ids))
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            may = x_id[s : s + 256, None] < y_id[None]
            if own is not None:
                may &= own.estimates(part, at, codes) <= reach + error + SLACK
            i, j = np.nonzero(may)
            for k in range(0, len(i), 65536):
                a, b = i[k : k + 65536], j[k : k + 65536]
                live = np.einsum("ij,ij->i", part[a], y[b]) >= cosine
                a, b = a[live] + s, b[live]
                np.add.at(x_links, a, y_n[b])
                np.add.at(y_links, b, x_n[a])
                root = joined(root, place[a], place[len(x) + b])
        tied = np.nonzero(root != np.arange(len(ids)))[0]
        rows += zip([1] * len(tied), ids[root[tied]].tolist(), ids[tied].tolist(), strict=True)
        for of, n in ((x_id, x_links), (y_id, y_links)):
            rows += zip([0] * int((n > 0).sum()), of[n > 0].tolist(), n[n > 0].tolist(), strict=True)
    kinds, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, type=pa.int32()), "a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Vectors link within a label and dimension.  Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without label or vec_id, link
    with nothing.  Repeated rows count as vectors of their own.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    source = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False))
    keyed = source.withColumn("fine", fine).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit("other"), "v", "label")})
    classes = materialize(keyed.where("fine").groupBy("k1", "k2", "label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")))
    index = train(classes, sample)
    shared = spark.sparkContext.broadcast(index)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    names = ["cid", "n", "dim", "vec", "list", "codes", "error", "probes"]

    def assign(batches):
        for batch in batches:
            label, dims = batch.column(0), np.array([len(v) for v in batch.column(3)])
            for d in np.unique(dims):
                pick = pa.array(np.nonzero(dims == d)[0])
                ids, n, v = (batch.column(i).take(pick) for i in (1, 2, 3))
                raw = [np.array(e, dtype="<f8").tobytes() for e in v.to_pylist()]
                own = shared.value.get(int(d))
                if own is None:  # no vector of a rare dimension was sampled: one list, compared exactly
                    at, codes, error, probe = np.zeros(len(raw), dtype=int), np.zeros((len(raw), 0), dtype=np.uint8), np.zeros(len(raw)), np.ones((len(raw), 1), dtype=bool)
                else:
                    at, codes, error, probe = own.assign(_unit(raw), reach)
                yield pa.RecordBatch.from_arrays(
                    [label.take(pick), ids, n, pa.array(np.full(len(raw), d), type=pa.int32()), pa.array(raw, type=pa.binary()), pa.array(at, type=pa.int32()), pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(error, type=pa.float64()), pa.array([np.nonzero(p)[0] for p in probe], type=pa.list_(pa.int32()))],
                    names=["label", *names],
                )

    label_type = classes.schema["label"].dataType.simpleString()
    assigned = materialize(classes.select("label", "cid", "n", "v").mapInArrow(assign, f"label {label_type}, cid long, n long, dim int, vec binary, list int, codes binary, error double, probes array<int>"))
    probing = assigned.select("label", "dim", "cid", "n", "vec", F.explode("probes").alias("list"))
    at = ["label", "dim", "list"]
    per = assigned.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("s_blocks")).join(probing.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("p_blocks")), at)
    per = materialize(per)
    part = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    stored = assigned.join(per, at).select(*at, "cid", "n", "vec", "codes", "error", F.lit(0).alias("role"), part("s_blocks").alias("s"), spread("p_blocks").alias("p"))
    probes = probing.join(per, at).select(*at, "cid", "n", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), F.lit(1).alias("role"), part("p_blocks").alias("p"), spread("s_blocks").alias("s"))

    def cell(table: pa.Table) -> pa.Table:
        return _cell(shared.value, cosine, table)

    found = materialize(stored.unionByName(probes).groupBy(*at, "s", "p").applyInArrow(cell, "kind int, a long, b long"))
    discard(per)
    root = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    named = classes.join(degree, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left").select(
        F.col("k1"), F.col("k2"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id")
    )
    linked = keyed.where("fine").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
