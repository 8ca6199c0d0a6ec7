import zlib
from collections import Counter, defaultdict

from fixtures import documents, odd
from pyspark.sql import functions as F

from millrace.llm import sharding


def check(d, shards=40):
    rows = sharding.shard(d, shards).collect()
    texts = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    counts = Counter(r["shard"] for r in rows)
    per = [counts[s] for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(per) - min(per) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_counts_and_groups(spark):
    d = documents(spark)
    rows = check(d, 8)
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_hot_group_spreads_over_few_shards(spark):
    d = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = check(d, 12)
    hot = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    before = 400 * 399 // 2
    cut = before - sum(n * (n - 1) // 2 for n in hot.values())
    assert cut < 0.85 * before  # an even deal cuts 92 %


def away(d, rows):
    """Rows that are not on the main shard of their text."""
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    where = defaultdict(Counter)
    for r in rows:
        where[texts[r["doc_id"]]][r["shard"]] += 1
    return sum(c.total() - max(c.values()) for c in where.values())


def test_rounds_go_on_while_they_gather(spark):
    # One text in a third of the rows, then groups of falling size: four rounds leave more rows away than a standstill.
    texts = ["hot"] * 400 + [f"g{k}" for k in range(2, 40) for _ in range(k)] + [f"t{i}" for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    some = [away(d, sharding.shard(d, 12, rounds=n).collect()) for n in (0, 1, 4, 100)]
    assert some == sorted(some, reverse=True) and some[0] > 2 * some[-1]
    check(d, 12)


def test_odd_rows(spark):
    d = odd(spark)
    check(d, 40)
    check(d, 3)
    check(d, 1)
    assert sharding.shard(d.where("false")).count() == 0
