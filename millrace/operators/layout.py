"""Sinks and layouts: partitioned, flat, clustered and run-scoped Parquet, with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, column: str, parts_per_value: int = 1) -> None:
    """Hive layout.  With one part a value each folder holds one file; more parts spread a large value."""
    dealt = df.repartition(column) if parts_per_value == 1 else df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(parts_per_value)))
    dealt.write.mode("overwrite").partitionBy(column).parquet(path)


def write_flat(df: DataFrame, path: str, files: int = 1) -> None:
    df.coalesce(files).write.mode("overwrite").parquet(path)


def write_clustered(df: DataFrame, path: str, column: str, files: int) -> None:
    """Sorted by ranges of ``column``, so that files hardly overlap in it."""
    df.repartitionByRange(files, column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_lines(df: DataFrame, path: str, sep: str = " ") -> None:
    """Rows as text with a separator of any length; null is empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *texts).alias("value")).write.mode("overwrite").text(path)


def create_table_as(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), replace: bool = True) -> None:
    """A managed table in the warehouse from a query; ``replace`` drops one of that name."""
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name.split('.')[0]}`")
    writer = df.write.mode("overwrite" if replace else "errorifexists").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def append_evolving(df: DataFrame, path: str) -> None:
    """Append rows that may have new columns; :func:`read_evolving` merges the schemas."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def run_folder(root: str, schema: str, table: str, load_type: str, stamp: str) -> str:
    """The folder of one extraction; a retry of the same run replaces it."""
    return f"{root.rstrip('/')}/{schema.lower()}/{table.lower()}/load_type={load_type.lower()}/run_id={stamp}"


def export(df: DataFrame, folder: str, max_file_size_mb: int = 512) -> int:
    """Write a run folder, replacing what a failed try left; returns the rows written, counted on the write itself.

    Files are kept under ``max_file_size_mb``: rows a file follow from the width of
    the schema, and where texts are wider than that, from the files of a first try.
    """
    limit = max_file_size_mb * 1024**2
    lowered = df.toDF(*(c.lower() for c in df.columns))
    rows = max(1, limit // max(1, lowered._jdf.schema().defaultSize()))
    while True:
        seen = Observation()
        lowered.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(folder)
        written = seen.get["rows"]
        largest = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).agg(F.max("length")).first()[0] or 0
        if largest <= limit or rows == 1 or not written:
            return written
        rows = max(1, min(rows, written) * limit * 9 // (largest * 10))


def manifest(df_written: DataFrame) -> DataFrame:
    """(url, content_length, record_count) for each file of a written dataset."""
    meta = df_written.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_size").alias("content_length"))
    return meta.groupBy("url", "content_length").agg(F.count("*").alias("record_count"))


def manifest_document(df_written: DataFrame) -> DataFrame:
    """The manifest as one row: entries[]{url, meta{content_length, record_count}}, schema{elements[]{name, type}}, meta{content_length, record_count}, total.

    The names are fixed values of the manifest format; ``total`` is the rows of all files.
    """
    rows = manifest(df_written)
    entry = F.struct("url", F.struct("content_length", "record_count").alias("meta"))
    elements = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df_written.schema))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = F.struct(total("content_length").alias("content_length"), total("record_count").alias("record_count"))
    return rows.agg(F.array_sort(F.collect_list(entry)).alias("entries"), sums.alias("meta"), total("record_count").alias("total")).withColumn("schema", F.struct(elements.alias("elements")))
