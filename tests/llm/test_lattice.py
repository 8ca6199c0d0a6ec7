import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from fixtures import documents, odd, words
from pyspark.sql import functions as F

from millrace.llm import lattice_lm as lm
from millrace.llm.queries import fold


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def small():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c", "abc"]
    rng = np.random.default_rng(0)
    return lm.Lattice(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))))


def brute(lattice, spelled):
    total, n = 0.0, len(spelled)
    for cuts in product([0, 1], repeat=n - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(spelled[at:i])
                at = i
        parts.append(spelled[at:])
        if all(p in lattice.ids for p in parts):
            total += math.exp(sum(lattice.logp[lattice.ids[p]] for p in parts))
    return math.log(total)


def test_forward_sums_all_segmentations():
    lattice = small()
    given = ["a", "ab", "abc", "ba", "cab", "abab", "aaaa", "bcabc"]
    want = [brute(lattice, lm.START + w) for w in given]
    assert lattice.score(given) == pytest.approx(want)
    assert [lattice.long(lm.START + w) for w in given] == pytest.approx(want)


def test_expected_counts_are_the_gradient():
    lattice, given, c = small(), ["ab", "abab", "cab"], np.array([2.0, 1.0, 3.0])
    expected = np.zeros(len(lattice.pieces))
    lattice.score(given, c, expected)
    for i in range(len(lattice.pieces)):
        up = lattice.logp.copy()
        up[i] += 1e-6
        slope = ((lm.Lattice(lattice.pieces, up).score(given) - lattice.score(given)) * c).sum() / 1e-6
        assert expected[i] == pytest.approx(slope, abs=1e-4)


@pytest.mark.parametrize("n", [39, 40, 41, 90])
def test_long_words_have_the_counts_of_the_whole_lattice(n):
    lattice = small()
    rng = np.random.default_rng(n)
    words, c = ["".join(rng.choice(list("abc"), n - 1)) for _ in range(3)], np.array([2.0, 1.0, 3.0])
    expected = [np.zeros(len(lattice.pieces)) for _ in range(2)]
    scores = lattice.score(words, c, expected[0])
    want = lattice.batch([lattice.spell(w) for w in words], c, expected[1])  # vectorised, whatever the length
    assert scores == pytest.approx(want) and expected[0] == pytest.approx(expected[1])


def test_a_common_long_word_is_looked_up_by_digest(spark):
    long = "x" * 50_000
    d = spark.createDataFrame([(i, f"{long} and some {'y' * 200} words {i}", i % 3 > 0) for i in range(60)], "doc_id long, text string, train boolean")
    a, b = (sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in lm.score_documents(d, steps=1, frequent=k).collect()) for k in (100_000, 0))
    assert a == b
    check(lm.score_documents(d, steps=0).collect(), [tuple(r) for r in d.collect()])


def test_vocabulary_covers_any_text():
    lattice = lm.Lattice.start(lm.read_pieces())
    strange = ["naïve", "你好世界", "\U0001f600", "x" * 500, "é" * 90, "\u0000\u0001", "▁▁"]
    got = lattice.score(strange)
    assert np.isfinite(got).all() and (got < 0).all()
    assert got == pytest.approx([lattice.long(lattice.spell(w)) for w in strange])
    assert np.exp(lattice.logp).sum() == pytest.approx(1)


def check(rows, docs):
    train = [words(lower(t)) for _, t, tr in docs if tr]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    want = []
    for i, t, tr in docs:
        ws = words(lower(t))
        want.append((i, tr, len(ws) + 1, sum(c[w] > 0 for w in ws) + bool(train), n, round(sum(log(c[w]) for w in ws) + log(len(train)), 6)))
    got = [(r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5)


@pytest.mark.parametrize("frequent", [100_000, 50])
def test_base_scores(spark, frequent):
    d = documents(spark).select("doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("train"))
    rows = lm.score_documents(d, steps=1, frequent=frequent).collect()
    check(rows, [tuple(r) for r in d.collect()])
    assert all(r["score"] < 0 for r in rows)


def test_frequent_bound_changes_no_score(spark):
    d = documents(spark).select("doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("train"))
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_documents(d, steps=1, frequent=k).collect()} for k in (100_000, 0))
    assert a == pytest.approx(b)


def test_learning_raises_the_likelihood(spark):
    d = documents(spark).select("doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("train"))
    held = [sum(r["score"] for r in lm.score_documents(d, steps=k).collect() if not r["train"]) for k in (0, 1, 3)]
    assert held[0] < held[1] < held[2]


def test_odd_rows(spark):
    d = odd(spark)
    for train in ("doc_id < 9", "false", "true"):
        part = d.withColumn("train", F.expr(train))
        rows = lm.score_documents(part, steps=1).collect()
        check(rows, [(r.doc_id, r.text, bool(r.train)) for r in part.select("doc_id", "text", "train").collect()])
        assert all(math.isfinite(r["score"]) for r in rows)
    assert lm.score_documents(d.where("false").withColumn("train", F.lit(True))).count() == 0
