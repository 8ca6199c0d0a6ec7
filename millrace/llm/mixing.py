"""Mixing sources to target weights by entropy balancing, in DataFrame operations.

Each document gets a rate (expected copies) as close as possible to 1 in relative
entropy such that every source's tokens meet its target and no rate passes
``MOST``.  The optimum is exponentially tilted, rate = min(MOST, exp(lambda * x))
with x the document's size over the mean size of its source, and lambda solves
the convex dual of its source.  Newton's method, kept inside a bracket, runs for
all sources at once on a histogram of sizes; each step is one aggregation.

Rates are rounded to copies by a threshold that is a hash of the document (and of
its number among equal rows), shifted for each source so that its tokens come as near to the target as whole documents
allow: two aggregations over binned shifts find the shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, word_count

WEIGHTS = (1, 2, 3)
MOST = 3.0
NEWTON_STEPS = 24
TOLERANCE = 1e-9
BINS = 1024
#: Equal rows that one task numbers.
EQUAL_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) -> adds target.  Sources by code point, null last, weigh ``weights`` in turn.

    Targets share all tokens by weight; those above ``most`` times their source stop
    there and the excess goes to the others.  As target / weight is one level for
    all that do not stop, sorting sources by (limit / weight) finds the level at once.
    """
    # One row a source, which the first pass over the documents has summed.
    place = [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(*place)) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    w = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), *place)
    w = w.withColumn("_place", F.row_number().over(by_level))
    w = w.withColumn("_limits", F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("_weights", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("_level", (F.sum("source_size").over(every) - F.col("_limits")) / F.col("_weights"))
    # The first source in that order whose limit is no less than its share ends the stopping; its level holds for all after it.
    open_ = F.col("limit") >= F.col("_level") * F.col("weight")
    w = w.withColumn("_first", F.min(F.when(open_, F.struct("_place", "_level"))).over(every))
    target = F.when(F.col("_place") < F.coalesce(F.col("_first._place"), F.lit(1 << 30)), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("_first._level") * F.col("weight")))
    return w.select("source", "source_size", target.alias("target"))


def _solve(hist: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """Lambda of every source: (sid, mean, lam, full) from (sid, size, n) and (sid, mean, target, ...)."""
    # full: even the limit of every document does not pass the target.
    state = goal.select(
        "sid", "mean", "target", (F.col("target") >= F.col("source_size") * most * (1 - TOLERANCE)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"),
    )
    state = materialize(state)
    for _ in range(NEWTON_STEPS):
        open_ = state.where("NOT full AND NOT done AND target > 0 AND mean > 0")
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        # One row a source: the broadcast side holds the sources still open.
        step = hist.join(open_.select("sid", "mean", "lam"), "sid").groupBy("sid").agg(
            F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(most))).alias("value"),
            F.sum(F.when(tilt < most, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"),
        )
        s = state.join(step, "sid", "left")
        low = F.col("value") < F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(~low, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("target") - F.col("value")) / F.col("slope"))))
        wide = F.when(low, F.coalesce((F.col("lam") + F.col("hi")) / 2, F.col("lam") * 2 + 1)).otherwise(F.coalesce((F.col("lam") + F.col("lo")) / 2, F.col("lam") * 2 - 1))
        inside = newton.isNotNull() & (newton > F.coalesce(lo, F.lit(float("-inf")))) & (newton < F.coalesce(hi, F.lit(float("inf"))))
        near = F.abs(F.col("value") - F.col("target")) <= F.col("target") * TOLERANCE
        moved = s.select(
            "sid", "mean", "target", "full",
            F.when(F.col("value").isNull() | near, F.col("lam")).when(inside, newton).otherwise(wide).alias("lam"),
            F.when(F.col("value").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("value").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
            (F.col("done") | F.coalesce(near, F.lit(False))).alias("done"),
        )
        after = materialize(moved)
        discard(state)
        state = after
    return state


def _shift(crossing: DataFrame) -> DataFrame:
    """(sid, want, at, size) -> (sid, shift): documents with ``at`` up to shift change a copy.

    ``want`` tokens are to change; the shift is that whose sum comes nearest, found
    in BINS bins of [0, 1), and again in BINS bins of the bin where ``want`` is passed.
    """
    every = ["sid", "want"]

    def passed(rows: DataFrame, at: Column, base: Column) -> DataFrame:
        bins = rows.groupBy(*every, "base", at.alias("bin")).agg(F.sum("size").alias("tokens"))
        up_to = F.sum("tokens").over(Window.partitionBy("sid").orderBy("bin"))
        return bins.withColumn("end", base + up_to).withColumn("start", F.col("end") - F.col("tokens"))

    first = passed(crossing.withColumn("base", F.lit(0)), F.floor(F.col("at") * BINS).cast("int"), F.col("base"))
    hit = first.where("end >= want AND start < want").select("sid", F.col("bin").alias("coarse"), F.col("start").alias("base"))
    inner = crossing.drop("base").join(hit, "sid").where(F.floor(F.col("at") * BINS) == F.col("coarse"))
    fine = F.floor((F.col("at") * BINS - F.col("coarse")) * BINS).cast("int")
    second = passed(inner.withColumn("at2", fine), F.col("at2"), F.col("base")).join(hit.select("sid", "coarse"), "sid")
    last = second.where("end >= want AND start < want")
    take = F.when(F.col("end") - F.col("want") <= F.col("want") - F.col("start"), F.col("bin") + 1).otherwise(F.col("bin"))
    found = last.select("sid", ((F.col("coarse") + take / BINS) / BINS).alias("shift"))
    # Where all crossings together stay below, all change.
    all_of = crossing.groupBy(*every).agg(F.sum("size").alias("tokens")).select("sid", F.when(F.col("tokens") < F.col("want"), 1.0).alias("every"))
    return all_of.join(found, "sid", "left").select("sid", F.coalesce("every", "shift", F.lit(0.0)).alias("shift"))


def _with_threshold(rows: DataFrame) -> DataFrame:
    """Add u in [0, 1): a hash of (doc_id, size, sid) and of the row's number among rows equal in those.

    Equal rows are numbered in buckets, so that no task holds all of a row that is
    repeated without end; a table without any is not joined.
    """
    same = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("no"), "size", "sid").alias("same")
    threshold = lambda again: F.shiftrightunsigned(F.xxhash64("doc_id", "size", "sid", again, F.lit("mix")), 11) / float(1 << 53)
    slim = rows.select("row", same)
    equal = materialize(slim.groupBy("same").agg(F.count("*").alias("n")).where("n > 1"))
    if equal.isEmpty():
        return rows.withColumn("u", threshold(F.lit(0).cast("long")))
    cut = materialize(slim.join(equal, "same").select("row", "same", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / EQUAL_ROWS)).cast("int").alias("bucket")))
    before = cut.groupBy("same", "bucket").agg(F.count("*").alias("k"))
    before = before.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("same").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = cut.withColumn("at", F.row_number().over(Window.partitionBy("same", "bucket").orderBy("row")))
    numbers = ranked.join(before, ["same", "bucket"]).select("row", (F.col("before") + F.col("at") - 1).alias("again"))
    out = materialize(rows.join(numbers, "row", "left").withColumn("u", threshold(F.coalesce("again", F.lit(0).cast("long")))).drop("again"))
    discard(cut)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, with_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken; ``with_rows`` adds the input columns.

    Null text has no words, so its rate changes nothing; null sources are one
    source.  Repeated rows are rows of their own.  Reruns agree: thresholds are
    hashes of doc_id, size, source and the number among rows equal in those.  Input columns with those names give way.  An
    empty table gives an empty result.
    """
    own = ("row", "again", "u", "y", "lam", "full", "mean", "miss", "shift", "size", "source_size", "target", "rate", "copies", "taken", "sid")
    kept = [c for c in docs.columns if c not in own] if with_rows else ["doc_id"]
    source = F.col("source").cast("string")
    sid = F.struct(F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("no"))
    rows = docs.select(*kept, word_count(F.col("text").cast("string")).alias("size"), sid.alias("sid"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = _with_threshold(rows)
    hist = materialize(rows.groupBy("sid", "size").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("sid").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n"))
    named = sizes.select(F.when(~F.col("sid.no"), F.col("sid.s")).alias("source"), "source_size")
    aim = targets(named, weights, most).select(F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no")).alias("sid"), "target")
    goal = materialize(sizes.withColumn("mean", F.col("source_size") / F.col("n")).drop("n").join(aim, "sid"))
    solved = _solve(hist, goal, most).select("sid", "lam", "full").join(goal, "sid")
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), most).when(F.col("target") <= 0, 0.0).otherwise(F.least(tilt, F.lit(most)))
    # One row a source on the other side.
    rated = rows.join(materialize(solved), "sid").withColumn("rate", rate).withColumn("y", F.col("rate") + F.col("u"))
    limited = lambda c: F.least(F.floor(c), F.lit(int(most))).cast("long")
    first = limited(F.col("y"))
    sums = rated.groupBy("sid").agg(F.sum(first * F.col("size")).alias("got"), F.first("target").alias("target"))
    miss = materialize(sums.select("sid", (F.col("target") - F.col("got")).alias("miss")))
    # Which shift of the threshold makes a document gain, or lose, a copy.
    up = F.ceil(F.col("y") + 1e-12) - F.col("y")
    down = F.col("y") - F.floor("y")
    gains = F.col("miss") > 0
    can = (F.col("size") > 0) & F.when(gains, first < int(most)).otherwise(first >= 1)
    at = F.least(F.greatest(F.when(gains, up).otherwise(F.when(F.col("y") >= most + 1, 0.0).otherwise(down)), F.lit(0.0)), F.lit(1 - 1e-12))
    crossing = rated.join(miss, "sid").where(can & (F.col("miss") != 0)).select("sid", F.abs("miss").alias("want"), at.alias("at"), "size")
    shift = materialize(_shift(crossing))
    done = rated.join(miss, "sid").join(shift, "sid", "left")
    change = F.when(can & (F.floor(at * BINS * BINS) < F.round(F.coalesce("shift", F.lit(0.0)) * BINS * BINS)), F.when(gains, 1).otherwise(-1)).otherwise(0)
    copies = first + F.when(F.col("miss") == 0, 0).otherwise(change)
    out = done.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(*kept, "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", "taken")
