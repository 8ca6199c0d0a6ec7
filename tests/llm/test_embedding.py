import math

import numpy as np
import pytest
from fixtures import groups_of

from millrace.llm import embedding_dedup as ed


def brute(rows, cosine=0.98):
    good, out = [], {}
    for k, (i, v, label) in enumerate(rows):
        fine = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if fine:
            x = np.array(v, dtype=float)
            x = x / np.abs(x).max()
            good.append((k, x / np.sqrt((x * x).sum()), label))
    links = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= cosine]
    root = groups_of(range(len(rows)), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    for k, (i, _, _) in enumerate(rows):
        out.setdefault(i, []).append((sum(k in e for e in links), least.get(root[k]), i is None or least[root[k]] == i))
    return {i: sorted(v, key=str) for i, v in out.items()}


def check(spark, rows, **options):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ed.near_duplicates(d, **options).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert {i: sorted(v, key=str) for i, v in got.items()} == brute(rounded)


def planted(n=600, dim=16, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i and rng.random() < 0.4:
            v = np.array(rows[rng.integers(i)][1]) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.08])
        rows.append((i + 1, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    return rows


def test_no_link_is_lost(spark):
    check(spark, planted())


def test_small_blocks_give_the_same(spark):
    check(spark, planted(seed=2), block=17)


def test_small_sample_gives_the_same(spark):
    check(spark, planted(seed=3), sample=100)


def test_dense_group_and_copies(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * 0.05], 1) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(100)] + [(2000 + i, rows[0][1], 2) for i in range(3)]
    check(spark, rows)


def test_many_lists_and_rare_dimensions(spark):
    # Lists by the root of the table, down to one vector of a dimension.
    rows = planted(n=900, dim=8, seed=5, labels=1) + [(10_000 + i, v, label) for i, v, label in planted(n=70, dim=3, seed=6, labels=2)] + [(20_000, [1.0, 2.0], 0)]
    check(spark, rows)
    check(spark, rows, sample=1)


def test_joined_is_a_forest_of_least_roots():
    rng = np.random.default_rng(9)
    for n, m in ((1, 0), (50, 30), (300, 2000), (500, 260)):
        u, v, root = rng.integers(n, size=m), rng.integers(n, size=m), np.arange(n)
        for at in range(0, m, 37):
            root = ed.joined(root, u[at : at + 37], v[at : at + 37])
        assert dict(enumerate(root.tolist())) == groups_of(range(n), list(zip(u.tolist(), v.tolist(), strict=True)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [1e-30, 0.0], 1), (11, [3e38, 0.0], 1), (12, [], 1)]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, n_links int")
    assert ed.near_duplicates(empty).count() == 0


def test_recall_on_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in d.collect()]
    got = {r["vec_id"]: [(r["n_links"], r["component_id"], r["kept"])] for r in ed.near_duplicates(d).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("dim", [3, 16])
def test_probes_and_estimates_keep_every_near_pair(dim):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.1 / math.sqrt(dim)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    reach = math.sqrt(2 - 2 * 0.98)
    index = ed.Index(x, 20)
    at, codes, error, _ = index.assign(y, reach)
    _, _, _, probe = index.assign(x, reach)
    for i in np.nonzero((x * y).sum(1) >= 0.98)[0]:
        assert probe[i, at[i]]
        assert index.estimates(x[i : i + 1], int(at[i]), codes[i : i + 1])[0, 0] <= reach + error[i] + 1e-6
