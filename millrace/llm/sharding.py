"""Sharding by balanced label propagation, in DataFrame operations.

Rows start dealt evenly over the shards.  Linked rows (those of equal text) then
move towards the shard where most of their group is: in every round each wants to
go to the fullest shard of its group that can still take rows, and as many moves
from shard i to shard j are accepted as there are rows that may go from j to i in
return: rows of j that want to go to i, and rows without links, which cost no cut
edge wherever they lie.  So every round keeps the number of rows of each shard, and
the counts stay at most one apart.  Rounds go on as long as they bring rows to the
shard where most of their group is.  A group that no shard could hold is split into
parts of about a shard first, each of which gathers by itself.

Ranks within a large set are taken in hash buckets, with the buckets' offsets
added, so that no task sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SHARDS = 40
#: Rounds at most; propagation ends before, once a round gathers no row.
ROUNDS = 100
#: Rows of a bucket in which ranks are counted, and bound of the buckets over all.
BUCKET_ROWS = 100_000
BUCKETS = 65_536
OVERHEAD = 16


def ranked(df: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add a gapless rank from 0 within the columns ``by`` (few different values).

    Rows are ranked within ``bucket``, and the counts of the buckets before are
    added; both need one shuffle by (by, bucket).
    """
    cut = df.withColumn("_bucket", bucket)
    counts = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    # The rows are dealt by (by, bucket) for their ranks, so the join moves the counts alone.
    return inner.join(before, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_before", "_rank")


def _bucket(total: int, values: int) -> Column:
    """Bucket of a row where ranks are counted within ``values`` values: at most BUCKETS, and eight a value, in all."""
    n = min(BUCKETS, total // BUCKET_ROWS + 64) // values + 8
    return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, size (UTF-8 bytes plus 16), text_crc32 and the key of equal texts (null text: none)."""
    text = F.col("text").cast("string")
    raw = F.encode(text, "UTF-8")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.when(text.isNotNull(), F.struct(F.xxhash64(text), F.xxhash64(F.lit("other"), text))).alias("key"),
    )


def _inside(linked: DataFrame) -> DataFrame:
    """Rows of each part on each shard: (part, shard, n)."""
    return materialize(linked.groupBy("part", "shard").agg(F.count("*").alias("n")))


def _away(inside: DataFrame) -> int:
    """Rows that are not on the shard where most of their part is."""
    return inside.groupBy("part").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _moves(now: DataFrame, linked: DataFrame, inside: DataFrame, total: int, shards: int) -> DataFrame:
    """Accepted moves (row, to) of one round."""
    free = now.where("part IS NULL").groupBy("shard").agg(F.count("*").alias("free"))
    # One row a shard: how many rows without links it could give away.
    inside = inside.join(free, "shard", "left")
    inside = materialize(inside.withColumn("rank", F.struct("n", F.xxhash64("part", "shard"))))
    # The fullest shard of each part, among those that can still take rows if there are any.
    open_ = F.when(F.col("free") > 0, F.col("rank"))
    goal = inside.groupBy("part").agg(F.coalesce(F.max_by("shard", open_), F.max_by("shard", "rank")).alias("to"), F.coalesce(F.max(open_), F.max("rank")).alias("best"))
    # A written table, so that the join below is of two plain shuffles, which Spark can split where a part is large.
    goal = materialize(inside.join(goal, "part").where("rank < best").select("part", "shard", "to"))
    wants = linked.join(goal, ["part", "shard"]).select("row", "shard", "to")
    wants = ranked(wants, ["shard", "to"], [F.col("row")], _bucket(total, shards * shards), "rank")
    wish = wants.groupBy("shard", "to").agg(F.count("*").alias("n"))
    back = wish.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("n").alias("back"))
    pairs = wish.join(back, ["shard", "to"], "left").select("shard", "to", "n", F.coalesce("back", F.lit(0)).alias("back"))
    # Rows without links fill what wishes in return do not; shard ``to`` lends them, in order of ``shard``.
    pairs = pairs.join(free.withColumnRenamed("shard", "to"), "to", "left").withColumn("lack", F.greatest(F.col("n") - F.col("back"), F.lit(0)))
    before = F.coalesce(F.sum("lack").over(Window.partitionBy("to").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = pairs.withColumn("before", before).withColumn("lent", F.greatest(F.least(F.col("lack"), F.coalesce("free", F.lit(0)) - F.col("before")), F.lit(0)))
    pairs = pairs.withColumn("quota", F.least(F.col("n"), F.col("back")) + F.col("lent"))
    # At most one row for each pair of shards, whatever the data: ``shards`` squared.
    accepted = wants.join(F.broadcast(pairs.select("shard", "to", "quota")), ["shard", "to"]).where("rank < quota").select("row", "to")
    lenders = ranked(now.where("part IS NULL").select("row", "shard"), ["shard"], [F.col("row")], _bucket(total, shards), "rank")
    runs = pairs.where("lent > 0").select(F.col("to").alias("lender"), F.col("shard").alias("to2"), "before", "lent")
    returned = lenders.join(F.broadcast(runs), (F.col("shard") == F.col("lender")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("lent"))).select("row", F.col("to2").alias("to"))
    return accepted.union(returned)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, linked: rows of equal text together, counts at most one apart.

    Null text has size 16 and the checksum of no bytes, and links with nothing.
    Repeated rows are rows of their own.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    rows = materialize(sized(docs))
    total = rows.count()
    most = max(1, total // shards)
    # A written table, so that the join below is of two plain shuffles, which Spark can split where a key is hot.
    groups = materialize(rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # Each row of a group beyond a shard takes one of its parts.
    parts = F.ceil(F.col("n") / most).cast("int")
    part = F.when(F.col("n").isNotNull(), F.struct("key", F.pmod(F.xxhash64("row"), parts).alias("i")))
    start = rows.select("row", "key").join(groups, "key", "left").select("row", part.alias("part"))
    now = materialize(ranked(start, [], [F.col("row")], _bucket(total, 1), "at").select("row", "part", F.pmod("at", F.lit(shards)).cast("int").alias("shard")))
    linked = now.where("part IS NOT NULL")
    inside = _inside(linked)
    away = _away(inside)
    for _ in range(rounds if shards > 1 else 0):
        if not away:
            break
        moves = materialize(_moves(now, linked, inside, total, shards))
        after = materialize(now.join(moves, "row", "left").select("row", "part", F.coalesce("to", "shard").alias("shard")))
        discard(moves)
        linked_after = after.where("part IS NOT NULL")
        inside_after = _inside(linked_after)
        away_after = _away(inside_after)
        better = away_after < away
        discard(inside if better else inside_after)
        discard(now if better else after)
        if not better:
            break
        now, linked, inside, away = after, linked_after, inside_after, away_after
    discard(inside)
    placed = ranked(now.select("row", "shard", F.col("part").isNotNull().alias("linked")), ["shard"], [F.col("row")], _bucket(total, shards), "slot")
    return rows.join(placed, "row").select("doc_id", "size", "text_crc32", "shard", "slot", "linked")
