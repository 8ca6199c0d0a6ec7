"""How well a file layout prunes: per-file ranges, clustering depth, files a predicate must read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_ranges(df: DataFrame, column: str) -> DataFrame:
    """(file, lo, hi, bytes) of each file of a dataset read from Parquet."""
    meta = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col(column).alias("c"))
    return meta.groupBy("file", "bytes").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))


def clustering_depth(df: DataFrame, column: str) -> DataFrame:
    """(n_files, average_depth): files that overlap a file's range, itself included, on average.

    Counted by a sweep: a file overlaps all that start up to its end, but for those
    that end before its start.  So the work is that of a sort, not of all pairs.
    """
    ranges = file_ranges(df, column).where("lo IS NOT NULL").select("lo", "hi")
    starts = ranges.groupBy("lo").count().selectExpr("lo AS at", "count AS started", "0L AS ended")
    ends = ranges.groupBy("hi").count().selectExpr("hi AS at", "0L AS started", "count AS ended")
    points = starts.union(ends).groupBy("at").agg(F.sum("started").alias("s"), F.sum("ended").alias("e"))
    # One row a distinct bound: as many as there are files at most, twice.
    points.createOrReplaceTempView("__points")
    ranges.createOrReplaceTempView("__ranges")
    return df.sparkSession.sql("""
        WITH sums AS (SELECT at, SUM(s) OVER (ORDER BY at) AS started, SUM(e) OVER (ORDER BY at) - e AS ended FROM __points)
        SELECT COUNT(*) AS n_files, AVG(h.started - l.ended) AS average_depth
        FROM __ranges r JOIN sums h ON h.at = r.hi JOIN sums l ON l.at = r.lo""")


def pruning_report(df: DataFrame, column: str, value: object, wrapped: bool = False) -> DataFrame:
    """(scanned, total, pct) of files that ``column = value`` must read by min/max; all if the column is wrapped."""
    ranges = file_ranges(df, column)
    hit = F.lit(True) if wrapped else (F.col("lo") <= F.lit(value)) & (F.col("hi") >= F.lit(value))
    return ranges.agg(F.count(F.when(hit, 1)).alias("scanned"), F.count("*").alias("total")).withColumn("pct", F.round(100.0 * F.col("scanned") / F.nullif(F.col("total"), F.lit(0)), 1))


def bytes_by_layout(flat: DataFrame, partitioned: DataFrame, column: str, value: object) -> dict[str, int]:
    """Bytes of files that a partition predicate reads in each layout."""
    of = lambda d: d.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct().agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    return {"flat": of(flat), "partitioned": of(partitioned.where(F.col(column) == F.lit(value)))}
