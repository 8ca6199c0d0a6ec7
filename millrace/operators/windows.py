"""Window operators: post-window filters, latest rows, top-N, and explicit frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_TEMP = "__qualify"


def _columns(order: Sequence[Column | str] | Column | str) -> list[Column]:
    items = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(c) if isinstance(c, str) else c for c in items]


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows where a condition on window expressions holds; no column is left over.

    The condition is worked out on all rows of ``df`` first, as QUALIFY does.
    """
    return df.withColumn(_TEMP, condition).where(F.col(_TEMP)).drop(_TEMP)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | Column | str, n: int, distinct_values: bool = False) -> DataFrame:
    """First ``n`` rows (or rows of the first ``n`` distinct values) of each group.

    The filter has the shape ``rank <= n``, which Spark also applies below the shuffle.
    """
    over = Window.partitionBy(*keys).orderBy(*_columns(order))
    rank = F.dense_rank() if distinct_values else F.row_number()
    return df.withColumn(_TEMP, rank.over(over)).where(F.col(_TEMP) <= n).drop(_TEMP)


def latest_per_key(df: DataFrame, keys: Sequence[str], recency: str, tie_breaker: Sequence[str] | str) -> DataFrame:
    """One row a key: the newest by ``recency``, ties settled by ``tie_breaker``, nulls last.

    A tie-breaker is required: without one the row kept would depend on the run.
    """
    ties = [tie_breaker] if isinstance(tie_breaker, str) else list(tie_breaker)
    if not ties:
        raise ValueError("latest_per_key needs a tie-breaker")
    return top_n(df, keys, [F.col(c).desc_nulls_last() for c in (recency, *ties)], 1)


def rank_family(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | Column | str) -> DataFrame:
    """Add row_number, rank and dense_rank over one window."""
    over = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumns({f.__name__: f().over(over).cast("long") for f in (F.row_number, F.rank, F.dense_rank)})


def frame(keys: Sequence[str], order: Sequence[Column | str] | Column | str | None = None, kind: str = "default") -> WindowSpec:
    """A window with a named frame: ``default``, ``rows`` (running), ``whole`` or ``unordered``."""
    spec = Window.partitionBy(*keys)
    if order is None or kind == "unordered":
        return spec
    spec = spec.orderBy(*_columns(order))
    if kind == "rows":
        return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kind == "whole":
        return spec.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return spec


def above_group_average(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """Rows whose value is above the mean of their group."""
    v = F.col(value) if isinstance(value, str) else value
    return qualify(df, v > F.avg(v).over(Window.partitionBy(*keys)))


def share_of_total(df: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """Rows a group, and their share of all rows in percent."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    # One row a group reaches the empty window.
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), digits).cast("double"))
