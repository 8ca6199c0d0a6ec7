"""Idempotent upsert without a table format, and versioned snapshots to keep the result.

``merge`` is a pure function of two DataFrames.  Rows are chosen by match flags, so
a null of a matched source row overwrites; null keys never match, so they insert.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import latest_per_key


class AmbiguousMergeError(ValueError):
    """A target row has several source rows, or one key would be inserted twice."""


def duplicated_keys(source: DataFrame, on: Sequence[str]) -> DataFrame:
    """Non-null keys that occur more than once in the source."""
    known = source.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on))
    return known.groupBy(*on).count().where("count > 1").drop("count")


def guard(target: DataFrame, source: DataFrame, on: Sequence[str], on_duplicate_insert: str = "error") -> None:
    """Raise if the upsert is ambiguous, naming up to ten keys."""
    twice = duplicated_keys(source, on)
    if on_duplicate_insert == "allow":
        twice = twice.join(target.select(*on), list(on), "left_semi")
    found = twice.limit(10).collect()
    if found:
        raise AmbiguousMergeError("several source rows for " + "; ".join(str(tuple(r)) for r in found))


def merge(
    target: DataFrame,
    source: DataFrame,
    on: Sequence[str],
    columns: Sequence[str] | None = None,
    matched: Column | None = None,
    delete_when: Column | None = None,
    not_matched_by_source: str | dict[str, Column] = "keep",
    insert: bool = True,
    dedupe_by: tuple[str, str] | None = None,
    on_duplicate_insert: str = "error",
) -> DataFrame:
    """Rows of the target after the upsert.

    columns: which are updated (default: all common ones but the keys); inserts take
    every target column that the source has.  matched: condition on source columns
    that narrows both update and ambiguity check.  delete_when: condition on the
    updated values of matched rows that deletes them.  not_matched_by_source:
    ``keep`` or ``delete`` rows of the target without a source row, or the values
    (of target columns) that their columns are updated to.  dedupe_by: (recency,
    tie-breaker) picks one source row a key first.
    """
    orphans = not_matched_by_source if isinstance(not_matched_by_source, dict) else {}
    if not orphans and not_matched_by_source not in ("keep", "delete"):
        raise ValueError(not_matched_by_source)
    if dedupe_by:
        no_key = " OR ".join(f"`{k}` IS NULL" for k in on)
        source = latest_per_key(source.where(f"NOT ({no_key})"), on, *dedupe_by).unionByName(source.where(no_key))
    if matched is not None:
        # A row that matches but fails the condition neither updates nor inserts.
        passing = source.where(matched)
        failing = source.where(~F.coalesce(matched, F.lit(False))).join(target.select(*on), list(on), "left_anti")
        guard(target, passing, on, on_duplicate_insert)
        source = passing.unionByName(failing)
    else:
        guard(target, source, on, on_duplicate_insert)
    updated = [c for c in (columns or source.columns) if c in target.columns and c not in on]
    s = source.select(*(F.col(c).alias(f"__s_{c}") for c in source.columns if c in target.columns), F.lit(True).alias("__in_s"))
    t = target.withColumn("__in_t", F.lit(True))
    keys = [F.col(k) == F.col(f"__s_{k}") for k in on]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    both = t.join(s, condition, "full_outer")
    in_s, in_t = F.coalesce("__in_s", F.lit(False)), F.coalesce("__in_t", F.lit(False))

    def value(c: str) -> Column:
        new = F.col(f"__s_{c}") if c in source.columns else F.lit(None)
        kept = F.when(in_s, new).otherwise(F.col(c)) if c in updated else F.col(c)
        if c in orphans:
            kept = F.when(in_s, kept).otherwise(orphans[c])
        return F.when(in_t, kept).otherwise(new).cast(target.schema[c].dataType).alias(c)

    keep = in_t | F.lit(insert)
    if not_matched_by_source == "delete":
        keep = keep & in_s
    out = both.where(keep).select(*(value(c) for c in target.columns), (in_s & in_t).alias("__matched"))
    if delete_when is not None:
        out = out.where(~(F.col("__matched") & F.coalesce(delete_when, F.lit(False))))
    return out.drop("__matched")


class SnapshotTable:
    """A Parquet table kept as versions; a pointer file names the one that counts.

    A new version is written beside the old one and the pointer is swapped by an
    atomic rename, so a reader or a failed writer never sees half a table.  A
    version named already is not written again, which makes replays harmless.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        at = self._path(f"{self.path}/_current")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}")

    def commit(self, df: DataFrame, version: str) -> bool:
        """Write ``df`` as ``version`` and make it current; False if it already is."""
        if self.version() == version:
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/{version}")
        new, current = self._path(f"{self.path}/_current.new"), self._path(f"{self.path}/_current")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        before = self.version()
        context.rename(new, current, array)
        # Readers of the version before may still be at work; what is older goes.
        for found in self._fs.listStatus(self._path(self.path)):
            if found.isDirectory() and found.getPath().getName() not in (version, before):
                self._fs.delete(found.getPath(), True)
        return True


class PartitionedTable:
    """A keyed Parquet table in hash partitions, each a folder of versions; one manifest says which count.

    An upsert reads and rewrites only the partitions that hold a key of the batch.
    The manifest is a snapshot table with a row a partition, and its commit is the
    commit of the whole upsert.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = 256) -> None:
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), list(keys), parts
        self.manifest = SnapshotTable(spark, f"{self.path}/manifest")

    def version(self) -> str | None:
        return self.manifest.version()

    def _current(self) -> dict[int, str]:
        now = self.manifest.read()
        return {} if now is None else {r["part"]: r["version"] for r in now.collect()}

    def _folders(self, current: dict[int, str]) -> DataFrame | None:
        """Rows of some partitions, each from its own version."""
        paths = [f"{self.path}/version={v}/part={p}" for p, v in sorted(current.items())]
        return self.spark.read.option("basePath", self.path).parquet(*paths).drop("version", "part") if paths else None

    def read(self) -> DataFrame | None:
        return self._folders(self._current())

    def upsert(self, newest: DataFrame, version: str) -> bool:
        """Merge rows (one a key) and make ``version`` current; False if it already is."""
        if self.version() == version:
            return False
        # Null keys match nothing and would gather in one partition, so they are dealt by the whole row.
        null = " OR ".join(f"`{k}` IS NULL" for k in self.keys)
        part = lambda d: F.pmod(F.when(F.expr(null), F.xxhash64(*d.columns)).otherwise(F.xxhash64(*self.keys)), F.lit(self.parts)).cast("int")
        current = self._current()
        touched = [r[0] for r in newest.select(part(newest).alias("p")).distinct().collect()]  # bounded by ``parts``
        before = self._folders({p: v for p, v in current.items() if p in touched})
        rows = newest if before is None else merge(before, newest, self.keys)
        rows.withColumn("part", part(rows)).repartition(len(touched) or 1, "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/version={version}")
        after = current | dict.fromkeys(touched, version)
        return self.manifest.commit(self.spark.createDataFrame(sorted(after.items()), "part int, version string").coalesce(1), version)

    def vacuum(self) -> int:
        """Delete partition folders that the current manifest does not name; returns how many."""
        jvm, current, n = self.spark.sparkContext._jvm, self._current(), 0
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for version in fs.listStatus(path(self.path)):
            name = version.getPath().getName()
            if not name.startswith("version="):
                continue
            for folder in fs.listStatus(version.getPath()):
                part = folder.getPath().getName().removeprefix("part=")
                if folder.isDirectory() and part.isdigit() and current.get(int(part)) != name.removeprefix("version="):
                    fs.delete(folder.getPath(), True)
                    n += 1
        return n
