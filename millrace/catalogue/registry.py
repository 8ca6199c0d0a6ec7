"""The registry that the modules of this package fill."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The test tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        for n in names:
            getattr(self, n).createOrReplaceTempView(n)
        return self.spark


def query(sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its own name, with its DuckDB SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = Query(lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add
