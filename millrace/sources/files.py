"""File scans with the schema fixed up front."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def read_catalogue(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    """Separated text without header; blank lines and ``#`` comments are skipped, the row order is kept in ``ordinal``."""
    lines = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), sep=sep, comment="#", header=False)
    return lines.withColumn("ordinal", F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, array: bool = False) -> DataFrame:
    """JSON lines, or with ``array`` a whole-file JSON array."""
    reader = spark.read.option("multiLine", str(array).lower())
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_partitioned(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """Hive-partitioned Parquet; folder values stay strings unless ``typed``."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(typed).lower())
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: object, high: object, parts: int, **options: str) -> DataFrame:
    """Partitioned JDBC scan; for small tables, bulk data goes through files."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files as a relation: path, modificationTime, length.  The contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "modificationTime", "length")


def newest(files: DataFrame, like: str) -> DataFrame:
    """The newest file whose name holds ``like`` in any case: one row, null for none."""
    return files.where(F.col("path").ilike(f"%{like}%")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def pending_per_token(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """For each token the number of files whose name holds it, 0 for none.

    A name is cut into all its parts of a token's length, so files and tokens meet
    in an equality join; tokens have few different lengths.
    """
    lengths = sorted(r[0] for r in tokens.select(F.length("token")).where(F.length("token") > 0).distinct().collect())
    name = F.element_at(F.split("path", "/"), -1)

    def cuts(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring(F.col("name"), i, F.lit(n)))
        return F.when(F.length("name") >= n, every).otherwise(F.array().cast("array<string>"))

    parts = files.select(name.alias("name")).select(F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(cuts, lengths)))).alias("token"))
    counts = parts.join(tokens.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("pending"))
    return tokens.join(counts, "token", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def same_path(path: Column) -> Column:
    """A path in one form: listings say ``file:/x``, checkpoints and metadata ``file:///x``."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+(?=[^/])", "$1/")


def in_blocks(paths: DataFrame, size: int = 1000) -> Iterator[list[str]]:
    """A column of paths in lists of bounded length, for readers that take lists."""
    held: list[str] = []
    for row in paths.toLocalIterator():
        held.append(row[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def total_bytes(files: DataFrame) -> int:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """Catalogue of a relation: (name, type)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def schema_fingerprint(df: DataFrame) -> str:
    """sha-256 of names and types; a change means that the source has drifted."""
    import hashlib

    return hashlib.sha256("|".join(f"{n}:{t}" for n, t in columns_of(df)).encode()).hexdigest()
