import random

import numpy as np
import xxhash
from fixtures import documents, groups_of, odd, words

from millrace.llm import simhash
from millrace.llm.graph import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(rows, texts):
    fps = {i: brute(t) for i, t in texts}
    values = sorted(set(fps.values()))
    links = [(u, v) for k, u in enumerate(values) for v in values[:k] if (u ^ v).bit_count() <= 4]
    root = groups_of(values, links)
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    for r in rows:
        assert r["fp"] & (2**64 - 1) == fps[r["doc_id"]]
        assert r["component_id"] == least.get(root[fps[r["doc_id"]]])


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    for i in range(60):  # near copies
        w = (texts[i][1] or "x y z").split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append((10_000 + i, " ".join(w)))
    texts += [(20_000 + i, t) for i, t in enumerate(["a", "b", "a b c", "A B C", "", None, "a b c d", "A  b\tc D"])]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    check(simhash.near_duplicates(d).collect(), texts)


def test_odd_rows(spark):
    d = odd(spark)
    rows = simhash.near_duplicates(d).collect()
    assert len(rows) == d.count()
    check(rows, [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(d.where("false")).count() == 0


def test_keys_find_every_pair_within_four_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sides = []
    for v, skip in ((x, 1), (y, 0)):
        row, side, key = simhash.keys_of(v)
        sides.append(set(zip(row[side != skip].tolist(), key[side != skip].tolist(), strict=True)))
    assert {i for i, _ in sides[0] & sides[1]} == set(range(len(x)))


def test_links_are_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base:
        for _ in range(12):
            v = int(b)
            for k in rng.choice(64, rng.integers(1, 8), replace=False):
                v ^= 1 << int(k)
            fps.add(v)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    rows = simhash.links(spark.createDataFrame([(s, i or None) for i, s in enumerate(signed)], "fp long, tag long")).collect()
    assert all(e.tag == (signed.index(e.fp) or None) for r in rows for e in (r.u, r.v))
    got = {(r.u.fp, r.v.fp) for r in rows}
    want = {(u, v) for u in signed for v in signed if u < v and ((u ^ v) & (2**64 - 1)).bit_count() <= 4}
    assert got == want


def test_repeated_and_missing_ids(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(5, base), (5, "another text under the same id as the first one here"), (None, base + " more"), (None, "alone and without any id at all"), (9, base + " more words"), (3, "another text under the same id as the first one here")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    fps = [brute(t) for _, t in texts]
    root = groups_of(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {k: min((texts[i][0] for i in root if root[i] == k and texts[i][0] is not None), default=None) for k in set(root.values())}
    want = sorted((str(i), f, str(least[root[k]])) for k, ((i, _), f) in enumerate(zip(texts, fps, strict=True)))
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in simhash.near_duplicates(d).collect()) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    assert got == groups_of(nodes, [e for e in edges if e[0] != e[1]])
