"""Shared helpers: tables in the cluster's shared folder, and UTF-8 word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, as in tests, may it be unset: then a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(sc, "_millrace_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path(root.name) / path.relative_to(root)))
    sc.addPyFile(str(archive))
    sc._millrace_shipped = True


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table from :func:`materialize` that is not read again."""
    path = getattr(df, "_millrace_path", None)
    if path:
        _remove(df.sparkSession, path)
        _kept[:] = [x for x in _kept if x[1] != path]


@contextmanager
def scoped() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialised inside are deleted at the end, but for those passed to the function given."""
    before, spared = {x[1] for x in _kept}, set()

    def keep(df: DataFrame) -> DataFrame:
        spared.add(df._millrace_path)
        return df

    yield keep
    for spark, path in [x for x in _kept if x[1] not in before | spared]:
        _remove(spark, path)
        _kept.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that it is worked out once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order (null: null)."""
    spaced = text
    for c in WS[1:]:  # a replacement that finds nothing costs one scan; translate would look every character up
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.size(words_of(F.coalesce(text, F.lit("")))), F.lit(0)).cast("long")
