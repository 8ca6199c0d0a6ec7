"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  Large: neighbours above a node get the least of its neighbourhood; small: those below."""
    if large:
        around = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> (node, root): root is the least node reachable.

    Nodes are of any type with an order, such as a long or a struct of longs; those
    without an edge to another node are absent.  Edges stay distributed; every step is a
    written table, so a lost executor repeats one step at most.  The number of
    steps grows with the logarithm of the number of nodes.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        large = materialize(_stars(now, large=True))
        after = materialize(_stars(large, large=False))
        discard(large)
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
