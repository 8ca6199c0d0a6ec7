"""Exports behind one interface: Spark writes files itself, a warehouse is told to by a statement.

Both leave Parquet in a run folder that a retry replaces, so what follows (manifest,
count check, publishing) does not depend on who wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import export


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def redshift(query: str, folder: str, max_mb: int, access: str) -> str:
    return f"UNLOAD ({_quoted(query)}) TO {_quoted(folder + '/')} IAM_ROLE {_quoted(access)} FORMAT PARQUET MAXFILESIZE {max_mb} MB MANIFEST VERBOSE CLEANPATH"


def snowflake(query: str, folder: str, max_mb: int, access: str) -> str:
    return f"COPY INTO {_quoted(folder + '/')} FROM ({query}) STORAGE_INTEGRATION = {access} FILE_FORMAT = (TYPE = PARQUET) MAX_FILE_SIZE = {max_mb * 1024**2} HEADER = TRUE OVERWRITE = TRUE DETAILED_OUTPUT = TRUE"


def bigquery(query: str, folder: str, max_mb: int, access: str) -> str:
    """The engine chooses its own file sizes."""
    return f"EXPORT DATA WITH CONNECTION `{access}` OPTIONS (uri = {_quoted(folder + '/*.parquet')}, format = 'PARQUET', overwrite = true) AS {query}"


def synapse(query: str, folder: str, max_mb: int, access: str) -> str:
    """An external table as select; ``access`` is the external data source, and the folder lies below it."""
    name = "export_" + "".join(c if c.isalnum() else "_" for c in folder.strip("/"))
    return f"CREATE EXTERNAL TABLE [{name}] WITH (LOCATION = {_quoted(folder + '/')}, DATA_SOURCE = [{access}], FILE_FORMAT = [parquet]) AS {query}"


STATEMENTS: dict[str, Callable[[str, str, int, str], str]] = {"redshift": redshift, "snowflake": snowflake, "bigquery": bigquery, "synapse": synapse}


@dataclass(frozen=True)
class SparkExport:
    """Spark reads the source and writes the files."""

    source: Callable[[str], DataFrame]

    def run(self, query: str, folder: str, max_mb: int = 512) -> int:
        return export(self.source(query), folder, max_mb)


@dataclass(frozen=True)
class StatementExport:
    """A warehouse writes the files; ``execute`` sends it the statement, and the rows are counted in what it wrote."""

    spark: SparkSession
    engine: str
    access: str
    execute: Callable[[str], None]

    def statement(self, query: str, folder: str, max_mb: int = 512) -> str:
        return STATEMENTS[self.engine](query, folder.rstrip("/"), max_mb, self.access)

    def run(self, query: str, folder: str, max_mb: int = 512) -> int:
        self.execute(self.statement(query, folder, max_mb))
        return self.spark.read.parquet(folder).agg(F.count("*")).first()[0]
