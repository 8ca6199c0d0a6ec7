"""Session factory: every setting the library relies on is declared, none inherited."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of a session made here; a caller's own values come last and win.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require(settings: dict, *names: str) -> None:
    """Raise at the start of a run if a required setting is missing or empty."""
    missing = [n for n in names if settings.get(n) in (None, "")]
    if missing:
        raise KeyError(f"required settings are not set: {', '.join(missing)}")
