"""Aggregations with defined order, fingerprints and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Distinct keys with the position where each first occurs, to be ordered by it."""
    return df.groupBy(*keys).agg(F.min(position).alias("first_seen"))


def fingerprint(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One row (n_rows, digest) that changes when any row does.

    ``ordered`` gathers the sorted rows for an md5 prefix and is meant for small
    tables; otherwise row hashes are combined without gathering anything.
    """
    if ordered:
        rows = F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))
        return df.agg(F.count("*").alias("n_rows"), F.substring(F.md5(F.array_join(rows, "\n")), 1, 12).alias("digest"))
    row = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.concat_ws(":", F.hex(F.bit_xor(row)), F.sum(F.pmod(row, F.lit(2**31 - 1))).cast("string")).alias("digest"))


def change_date_profile(df: DataFrame, column: str) -> DataFrame:
    """How usable a change-date column is: rows, distinct values, range, nulls, and share of the commonest value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(column).alias("n_values"),
        F.min(column).alias("oldest"), F.max(column).alias("newest"),
        F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        (F.max(F.when(F.col(column).isNotNull(), F.col("n"))) / F.sum("n")).alias("top_share"),
    )


def latest_against_history(df: DataFrame, keys: Sequence[str], order: Column, value: str, prior: int = 7, below: float = 0.2) -> DataFrame:
    """Groups whose newest value is under ``below`` times the mean of the ``prior`` before it."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    two = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"),
        F.avg(F.when(F.col("rn").between(2, prior + 1), F.col(value))).alias("prior_avg"),
    )
    return two.where(F.col("latest") < below * F.nullif(F.col("prior_avg"), F.lit(0)))
