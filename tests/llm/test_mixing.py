from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from fixtures import documents, odd, words

from millrace.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        level = left / sum(w[s] for s in open_) if open_ else 0
        out = {s: most * sizes[s] if s in stopped else level * w[s] for s in names}
        over = {s for s in open_ if out[s] > most * sizes[s]}
        if not over:
            return out
        stopped |= over


def check(d, near=None):
    got = mixing.mix(d, with_rows=False).collect()
    rows = d.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows)
    by_target = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by_target[round(r["target"], 3), r["source_size"]].append(r)
    assert set(by_target) == {(round(want[s], 3), sizes[s]) for s in sizes}
    for (target, _), part in by_target.items():
        n = sum(1 for s in sizes if round(want[s], 3) == target and sizes[s] == part[0]["source_size"])
        assert abs(sum(r["taken"] for r in part) - n * target) <= max(r["size"] for r in part) * n
        assert sum(r["rate"] * r["size"] for r in part) == pytest.approx(n * target, rel=1e-6, abs=1e-6)
    return got


def test_targets_and_rates(spark):
    check(documents(spark))


def test_reruns_agree_and_partitioning_does_not_matter(spark):
    d = documents(spark)
    key = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert key(mixing.mix(d).collect()) == key(mixing.mix(d.repartition(7)).collect())


def test_tilt_is_exponential_in_size(spark):
    import math

    by = defaultdict(list)
    for r in mixing.mix(documents(spark)).collect():
        if r["size"] and 0 < r["rate"] < 3:
            by[r["target"], r["source_size"]].append(math.log(r["rate"]) / r["size"])
    assert all(max(v) - min(v) < 1e-9 for v in by.values())


def test_odd_rows(spark):
    d = odd(spark)
    check(d)
    whole = mixing.mix(d, with_rows=True)
    assert "text" in whole.columns and whole.columns.count("size") == 1 and whole.count() == d.count()
    assert mixing.mix(d.where("false")).count() == 0
    only_empty = d.where("text IS NULL OR text = ''")
    assert all(r["taken"] == 0 for r in mixing.mix(only_empty).collect())


def check_targets(spark, sizes):
    d = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(d).collect()}
    assert got == pytest.approx(brute_targets(sizes)) and min(got.values(), default=0) >= 0
    if sizes:
        assert sum(got.values()) == pytest.approx(min(sum(sizes.values()), 3 * sum(sizes.values())))


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from([*"abcdefghij", "\U0001f600", "\uffff"])), st.sampled_from([0, 1, 2, 3, 100, 200, 300, 600, 900, 1800, 12345]), max_size=8))
def test_targets_against_brute_force(spark, sizes):
    check_targets(spark, sizes)


def test_targets_of_proportional_sizes(spark):
    for sizes in ((100, 200, 300), (100, 200, 900), (10_000, 20_000), (1, 2, 3, 1, 2, 3), (0, 0), (5,), (0, 0, 7)):
        check_targets(spark, dict(zip("abcdef", sizes)))


def test_repeated_rows_move_apart(spark):
    rows = [(7, "one two three four five six seven eight", "a")] * 500 + [(1000 + i, " ".join(["w"] * (1 + i % 15)), "a") for i in range(500)]
    rows += [(5000 + i, "some words of another source here", "b") for i in range(200)] + [(None, "x y z", "b")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for some in (d, d.repartition(9)):
        got = check(some)
    assert len({r["taken"] for r in got if r["doc_id"] == 7}) > 1
    key = lambda x: sorted((r["doc_id"] is None, r["doc_id"], r["taken"]) for r in x)
    assert key(got) == key(mixing.mix(d).collect())


def test_many_equal_rows_are_numbered_in_buckets(spark, monkeypatch):
    rows = [(7, "one two three", "a")] * 900 + [(i, "a b c d", "b") for i in range(1000, 1400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect())
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 100)
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()) == want
