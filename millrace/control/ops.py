"""Operational reports over the control tables.

Column names of the results are fixed values: those that operators know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import latest_against_history
from ..operators.windows import share_of_total
from .tables import ControlStore

NAMES = ["table_id", "source_schema", "source_table"]


def _gb(size_mb: str) -> Column:
    return F.round(F.col(size_mb) / 1024.0, 1).cast("double").alias("gb_estimated")


def progress(store: ControlStore) -> DataFrame:
    """Tables in scope by phase: how many, how large, and their share of all."""
    scoped = store.read("state").join(store.read("config").where("in_scope").select("table_id"), "table_id")
    sizes = scoped.groupBy("phase").agg(F.sum("est_size_mb").alias("size_mb"))
    shares = share_of_total(scoped, ["phase"]).select("phase", F.col("n").alias("tables"), F.col("pct").alias("pct_of_tables"))
    return shares.join(sizes, "phase").select("phase", "tables", _gb("size_mb"), "pct_of_tables").orderBy(F.desc("tables"), "phase")


def outstanding(store: ControlStore) -> DataFrame:
    """What a baseline still has to bring: by priority, the largest first."""
    open_ = store.read("state").where("phase IN ('PENDING', 'BASELINE')").select("table_id", "phase", "est_size_mb", "consecutive_failures")
    both = store.read("config").where("in_scope AND enabled").select(*NAMES, "priority").join(open_, "table_id")
    ordered = both.orderBy("priority", F.col("est_size_mb").desc_nulls_last(), "table_id")
    return ordered.select("source_schema", "source_table", "phase", "priority", _gb("est_size_mb"), "consecutive_failures")


def last_runs(store: ControlStore, n: int = 7) -> DataFrame:
    """The newest runs with their status and roll-up."""
    return store.read("runs").orderBy(F.desc("batch_run_id")).limit(n).select(
        "batch_run_id", "run_type", "status", "start_at", "end_at", F.col("succeeded").alias("tables_succeeded"), F.col("failed").alias("tables_failed"), F.col("skipped").alias("tables_skipped")
    )


def failures(store: ControlStore) -> DataFrame:
    """Failed tasks of the newest run, and why they failed."""
    newest = store.read("runs").agg(F.max("batch_run_id").alias("batch_run_id"))
    failed = store.read("tasks").where("status = 'FAILED'").join(F.broadcast(newest), "batch_run_id")  # an aggregate: one row
    return failed.join(store.read("config").select(*NAMES), "table_id").select("source_schema", "source_table", "chunk_no", "attempt", "window_from", "window_to", "rows_extracted", "source_rows", "error").orderBy("source_schema", "source_table", "chunk_no")


def where_it_stopped(store: ControlStore, source_schema: str, source_table: str, n: int = 50) -> DataFrame:
    """The newest events of a table."""
    one = store.read("config").where((F.col("source_schema") == source_schema) & (F.col("source_table") == source_table)).select("table_id")
    return store.read("events").join(one, "table_id").orderBy(F.desc("at"), F.desc("event_id")).limit(n).select(F.col("at").alias("event_at"), "step", "kind", "message")


def anomalies(store: ControlStore, prior: int = 7, below: float = 0.2) -> DataFrame:
    """Tables whose newest unchunked extraction is small against those before it."""
    published = store.read("tasks").where("status = 'PUBLISHED' AND chunk_no IS NULL").select("table_id", "start_at", "rows_extracted")
    odd = latest_against_history(published, ["table_id"], F.desc("start_at"), "rows_extracted", prior, below)
    named = odd.join(store.read("config").select(*NAMES), "table_id")
    return named.select("source_schema", "source_table", F.col("latest").alias("latest_rows"), F.round("prior_avg", 0).alias("prior_7_avg")).orderBy("source_schema", "source_table")


def held(store: ControlStore) -> DataFrame:
    """Tables held for a changed schema, the longest held first."""
    one = store.read("state").where("phase = 'HELD'").select("table_id", "column_hash", "last_success_at")
    return one.join(store.read("config").select(*NAMES), "table_id").select("source_schema", "source_table", "column_hash", "last_success_at").orderBy("last_success_at", "source_schema", "source_table")


def hours_of_baseline(sizes: DataFrame, rates: list[int]) -> DataFrame:
    """Hours to move each size (tb) at each of a few rates in GB an hour."""
    each = sizes.select("tb", F.explode(F.array(*map(F.lit, rates))).alias("gb_per_hour"))
    return each.withColumn("hours", F.round(F.col("tb") * 1024.0 / F.col("gb_per_hour"), 0).cast("long"))
