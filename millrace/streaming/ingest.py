"""Checkpointed file ingestion: each file once, with optional re-reads and upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from ..operators.merge import PartitionedTable, SnapshotTable, merge
from ..operators.windows import latest_per_key
from ..sources.files import listing, same_path


def drained(query) -> int:
    """Wait for a run to end, raise what it raised, and return the rows it read."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return sum(p["numInputRows"] for p in query.recentProgress)


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: StructType | str, fmt: str = "json", max_files: int = 1000) -> int:
    """Append files not seen before to a Parquet table and stop; returns the rows read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(landing)
    return drained(stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest_each(spark: SparkSession, landing: str, checkpoint: str, schema: StructType | str, handle: Callable[[DataFrame, int], None], fmt: str = "json") -> int:
    """Hand each micro-batch to ``handle`` and stop; returns the rows read."""
    stream = spark.readStream.schema(schema).format(fmt).load(landing)
    return drained(stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def upsert_batches(table: SnapshotTable | PartitionedTable, keys: Sequence[str], recency: str, tie_breaker: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler: each batch's latest row a key is merged into a table.

    A :class:`PartitionedTable` rewrites only the partitions that the batch touches;
    a snapshot table, meant for small ones, all of it.  A batch replayed after a
    crash finds its own version current and does nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        version = f"snap_{batch_id}"
        if table.version() == version:
            return
        newest = latest_per_key(batch, keys, recency, tie_breaker)
        if isinstance(table, PartitionedTable):
            table.upsert(newest, version)
            return
        before = table.read()
        table.commit(newest if before is None else merge(before, newest, keys), version)

    return handle


def total_rows(spark: SparkSession, path: str) -> int:
    """Rows of a table, 0 if it is not there yet; other errors are raised."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise


def processed_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The files a stream's checkpoint has recorded: path, timestamp, batchId."""
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/sources/0/*").where(F.col("value").startswith("{"))
    found = lines.select(F.from_json("value", "path string, timestamp long, batchId long").alias("x")).select("x.*").distinct()
    return found.withColumn("path", same_path(F.col("path")))


class Journal:
    """Discovery by (path, modification time), so that a file overwritten in place is read again.

    Seen files are appended to a log, one folder a run; a re-read appends the whole
    file, and readers keep the latest row a key.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def seen(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/run=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def pending(self, landing: str, glob: str = "*") -> DataFrame:
        files, seen = listing(self.spark, landing, glob), self.seen()
        return files if seen is None else files.join(seen, ["path", "modificationTime"], "left_anti")

    def run(self, landing: str, handle: Callable[[DataFrame], None], glob: str = "*") -> int:
        """Pass the pending files (path, modificationTime, length) to ``handle``, then record them; returns how many there were.

        They are a written table before ``handle`` sees them, so what is handled is
        what is recorded, and they stay distributed.  A run that dies in ``handle``
        records nothing.
        """
        number = uuid.uuid4().hex
        at = f"{self.path}/_pending/{number}"
        self.pending(landing, glob).write.parquet(at)
        found = self.spark.read.schema("path string, modificationTime timestamp, length long").parquet(at)
        n = found.count()
        if n:
            handle(found)
            found.select("path", "modificationTime").write.parquet(f"{self.path}/run={number}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return n


def watch(spark: SparkSession, landing: str, checkpoint: str, schema: StructType | str, handle: Callable[[DataFrame, int], None], every: str = "1 second", fmt: str = "json"):
    """A running query that waits for files and hands each arrival to ``handle``, until it is stopped."""
    stream = spark.readStream.schema(schema).format(fmt).load(landing)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def path_of_event(event: dict, bucket: str, prefix: str) -> str | None:
    """The object path of an arrival notice, or None if bucket or prefix do not match."""
    detail = event.get("detail", event)
    found, key = detail["bucket"]["name"], detail["object"]["key"]
    return f"s3://{found}/{key}" if found == bucket and key.startswith(prefix) else None


def ingest_object(spark: SparkSession, path: str, target: str, casts: dict[str, str]) -> int:
    """Read one object, cast, stamp the time of ingestion, append; rows are counted on the write."""
    from pyspark.sql import Observation

    df = spark.read.json(path)
    df = df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns}).withColumn("ingested_at", F.current_timestamp())
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(target)
    return seen.get["rows"]


def poll(list_pending: Callable[[], list[str]], handle: Callable[[list[str]], None], wait: Callable[[], None], rounds: int) -> int:
    """Look for files ``rounds`` times; returns how many looks found nothing."""
    idle = 0
    for _ in range(rounds):
        found = list_pending()
        if found:
            handle(found)
        else:
            idle += 1
        wait()
    return idle
