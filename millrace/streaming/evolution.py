"""Schema tracking for ingestion: inference kept on disk, added columns, rescued data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..sources.files import in_blocks, listing, same_path
from .ingest import drained, processed_files

RESCUED = "_rescued_data"


class UnknownFieldError(RuntimeError):
    """New fields were found and recorded; the next run takes them in."""


class SchemaStore:
    """Versions of a schema, each one row of text in its own folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def load(self) -> StructType | None:
        found = self.versions()
        if not found:
            return None
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/{found[-1]}", wholetext=True).first()[0]))

    def save(self, schema: StructType) -> int:
        version = (self.versions() or [-1])[-1] + 1
        self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/{version}")
        return version


def _union(a: StructType, b: StructType) -> StructType:
    """Fields of both; one that differs in type is text, as JSON inference has it."""
    fields = {f.name: f for f in a}
    for f in b:
        same = fields.get(f.name)
        if same is None or same.dataType == f.dataType:
            fields[f.name] = f
        else:
            numbers = {"bigint", "double"} == {same.dataType.simpleString(), f.dataType.simpleString()}
            fields[f.name] = StructField(f.name, DoubleType() if numbers else StringType())
    return StructType(list(fields.values()))


def observe(spark: SparkSession, pending: DataFrame) -> StructType:
    """The schema of pending JSON files (column path), read in blocks of bounded length."""
    found = StructType([])
    for paths in in_blocks(pending.select("path")):
        found = _union(found, spark.read.json(paths).schema)
    return StructType(sorted(found, key=lambda f: f.name))


def track(spark: SparkSession, store: SchemaStore, pending: DataFrame | Sequence[str], mode: str = "addNewColumns", hints: dict[str, str] | None = None) -> StructType:
    """The schema to read pending JSON files with.

    The first call infers and keeps it.  Later, with ``addNewColumns``, new fields
    are recorded and UnknownFieldError is raised, so the next run succeeds;
    ``rescue`` leaves the schema as it is and ``failOnNewColumns`` only raises.
    """
    if not isinstance(pending, DataFrame):
        pending = spark.createDataFrame([(p,) for p in pending], "path string")
    observed = observe(spark, pending)
    if hints:
        observed = StructType([StructField(f.name, spark.range(0).select(F.lit(None).cast(hints[f.name]).alias("x")).schema[0].dataType if f.name in hints else f.dataType) for f in observed])
    known = store.load()
    if known is None:
        store.save(observed)
        return observed
    names = {n.lower() for n in known.names}
    new = [f for f in observed if f.name.lower() not in names]
    if new and mode == "addNewColumns":
        store.save(StructType([*known.fields, *new]))
        raise UnknownFieldError(", ".join(f.name for f in new))
    if new and mode == "failOnNewColumns":
        raise UnknownFieldError(", ".join(f.name for f in new))
    return known


def unread(spark: SparkSession, landing: str, checkpoint: str, glob: str = "*.json", notices: DataFrame | None = None) -> DataFrame:
    """Files (column path) that a checkpoint has not recorded.

    They are found by listing the folder, or with ``notices`` (column path) taken
    from arrival notices, so that no folder is listed.
    """
    files = (listing(spark, landing, glob) if notices is None else notices).select(same_path(F.col("path")).alias("path")).distinct()
    try:
        return files.join(processed_files(spark, checkpoint).select("path"), "path", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return files


def auto_load(spark: SparkSession, landing: str, target: str, checkpoint: str, schemas: str, mode: str = "addNewColumns", hints: dict[str, str] | None = None, glob: str = "*.json", notices: DataFrame | None = None) -> int:
    """Append JSON files not seen before, with schema tracking and rescued data; returns the rows read.

    The schema is inferred from the files that are pending and kept under
    ``schemas``.  With ``addNewColumns`` a new field stops the run before anything
    is read; the run after it takes the field in.  ``notices`` names the files to
    infer from instead of a listing.  Read the target back with ``mergeSchema``.
    """
    pending = unread(spark, landing, checkpoint, glob, notices)
    if pending.isEmpty():
        return 0
    schema = track(spark, SchemaStore(spark, schemas), pending, mode, hints)
    lines = spark.readStream.option("pathGlobFilter", glob).text(landing).select("value", "_metadata")
    query = rescued(lines, schema).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return drained(query)


def rescued(lines: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """JSON lines as typed columns plus ``_rescued_data``.

    A field that is not in the schema, differs in case or does not fit its type is
    null in its column and kept, with the source path, in a JSON blob.  Lines that
    are not JSON objects are kept whole.
    """
    lines = lines.select(F.col(value).alias("__line"), F.col("_metadata.file_path").alias("__file"))
    raw = lines.withColumn("__raw", F.from_json("__line", "map<string,string>"))

    def typed(f: StructField) -> Column:
        text = F.col("__raw")[f.name]
        simple = f.dataType.simpleString()
        if simple.startswith(("struct", "array", "map")):
            return F.from_json(text, simple)
        return F.expr(f"try_cast(__raw['{f.name}'] AS {simple})")

    declared = F.array(*(F.lit(f.name) for f in schema))
    bad = F.array_compact(F.array(*(F.when(F.col("__raw")[f.name].isNotNull() & typed(f).isNull(), f.name) for f in schema)))
    extra = F.map_filter("__raw", lambda k, v: ~F.array_contains(declared, k) | F.array_contains(bad, k))
    blob = F.when(F.col("__raw").isNull() & F.col("__line").isNotNull(), F.to_json(F.struct(F.col("__line").alias("_line"), F.col("__file").alias("_file_path")))).when(
        F.size(extra) > 0, F.to_json(F.map_concat(extra, F.create_map(F.lit("_file_path"), F.col("__file"))))
    )
    return raw.select(*(typed(f).alias(f.name) for f in schema), blob.alias(RESCUED))
