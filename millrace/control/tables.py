"""Control tables of the extraction: schemas, defaults, constraints, and append-only storage.

Every table is a log.  A write adds one small file of JSON lines under a hidden name
and renames it, so it is there as a whole or not at all; nothing stored is read or
rewritten.  A reader takes the newest row of each key.  :meth:`ControlStore.compact`
folds a log into a Parquet snapshot, sorted by the columns that reports filter on, so
that row-group ranges do the work of an index.

A task's row carries the files it published.  So publishing is one atomic write, and
the file log is a view of the tasks that cannot name a file of an unfinished one.

Column names are this library's own design.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from datetime import datetime, timedelta
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import SnapshotTable
from ..operators.windows import top_n

CONFIG = "table_id int, source_schema string, source_table string, in_scope boolean, enabled boolean, load_type string, change_date_column string, marker_type string, chunk_column string, chunk_size string, priority int, target_prefix string, max_file_size_mb int, run_frequency string"
STATE = "table_id int, phase string, marker string, baseline_boundary string, est_size_mb long, est_row_count long, last_duration_seconds int, column_hash string, last_run string, last_success_at timestamp_ntz, consecutive_failures int, locked_by string, locked_at timestamp_ntz"
RUNS = "batch_run_id string, run_type string, start_at timestamp_ntz, end_at timestamp_ntz, status string, succeeded int, failed int, skipped int, held int"
TASKS = "task_id string, batch_run_id string, table_id int, chunk_no int, attempt int, window_from string, window_to string, status string, rows_extracted long, source_rows long, file_count int, bytes_written long, target string, start_at timestamp_ntz, end_at timestamp_ntz, duration_seconds int, error string, published_at timestamp_ntz, files array<struct<path:string,row_count:long,byte_size:long>>"
FILES = "task_id string, table_id int, path string, row_count long, byte_size long, published_at timestamp_ntz"
EVENTS = "event_id string, batch_run_id string, table_id int, step string, kind string, message string, at timestamp_ntz"
SCHEMAS = {"config": CONFIG, "state": STATE, "runs": RUNS, "tasks": TASKS, "files": FILES, "events": EVENTS}
KEYS = {"config": ["table_id"], "state": ["table_id"], "runs": ["batch_run_id"], "tasks": ["task_id"], "events": ["event_id"]}
#: What snapshots are sorted by.
SORTED = {"config": ["table_id"], "state": ["table_id"], "runs": ["batch_run_id"], "tasks": ["published_at", "batch_run_id", "table_id"], "events": ["at", "event_id"]}

CONFIG_DEFAULTS = {"in_scope": False, "enabled": True, "load_type": "INCREMENTAL", "change_date_column": None, "marker_type": "timestamp", "chunk_column": None, "chunk_size": None, "priority": 100, "target_prefix": None, "max_file_size_mb": 512, "run_frequency": "DAILY"}
STATE_DEFAULTS = {"phase": "PENDING", "marker": None, "baseline_boundary": None, "est_size_mb": None, "est_row_count": None, "last_duration_seconds": None, "column_hash": None, "last_run": None, "last_success_at": None, "consecutive_failures": 0, "locked_by": None, "locked_at": None}
LOAD_TYPES = ("INCREMENTAL", "FULL_REFRESH")
PHASES = ("PENDING", "BASELINE", "INCREMENTAL", "HELD")
#: Calendar units that a table is due in once; ALWAYS is due at every run.
FREQUENCIES = {"ALWAYS": None, "HOURLY": "hour", "DAILY": "day", "WEEKLY": "week", "MONTHLY": "month"}
RUN_STATUSES = ("RUNNING", "COMPLETE", "PARTIAL", "FAILED", "STOPPED")
TASK_STATUSES = ("RUNNING", "PUBLISHED", "FAILED", "SKIPPED", "HELD", "SPLIT")
STEPS = ("SELECT", "LOCK", "SCHEMA", "BOUNDS", "EXTRACT", "VERIFY", "PUBLISH", "MARKER")
KINDS = ("START", "END", "ERROR", "WARNING", "RETRY")
STALE_LOCK = timedelta(hours=6)
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


class ConstraintError(ValueError):
    """A control row breaks a constraint."""


def _one_of(row: dict, column: str, allowed: Iterable[str]) -> None:
    if row.get(column) not in allowed:
        raise ConstraintError(f"{column} {row.get(column)}")


def _present(row: dict, *columns: str) -> None:
    for c in columns:
        if row.get(c) is None:
            raise ConstraintError(f"{c} is missing")


def check_config(rows: Iterable[dict]) -> None:
    """Known load type and frequency; a change date for what is in scope and incremental; unique ids and source names."""
    ids, names = set(), set()
    for r in rows:
        _one_of(r, "load_type", LOAD_TYPES)
        _one_of(r | {"run_frequency": r.get("run_frequency", "DAILY")}, "run_frequency", FREQUENCIES)
        if r["in_scope"] and r["load_type"] == "INCREMENTAL" and not r["change_date_column"]:
            raise ConstraintError(f"table {r['table_id']} is incremental and has no change date column")
        name = (r["source_schema"], r["source_table"])
        if r["table_id"] in ids or name in names:
            raise ConstraintError(f"table {r['table_id']} {name} is there already")
        ids.add(r["table_id"])
        names.add(name)


def check_state(rows: Iterable[dict], config_ids: set[int]) -> None:
    for r in rows:
        _one_of(r, "phase", PHASES)
        if r["table_id"] not in config_ids:
            raise ConstraintError(f"state of unknown table {r['table_id']}")


def check_log(name: str, row: dict, knows_table, knows_run) -> None:
    """Constraints of runs, tasks and events: what must be there, known words, and rows they refer to."""
    if name == "runs":
        _present(row, "batch_run_id", "start_at")
        _one_of(row, "status", RUN_STATUSES)
    if name == "tasks":
        _present(row, "task_id", "batch_run_id", "table_id", "attempt", "start_at")
        _one_of(row, "status", TASK_STATUSES)
        if row["attempt"] < 1:
            raise ConstraintError(f"attempt {row['attempt']}")
        for f in row.get("files") or []:
            _present(f, "path", "row_count")
    if name == "events":
        _present(row, "event_id", "at")
        _one_of(row, "step", STEPS)
        _one_of(row, "kind", KINDS)
    if row.get("table_id") is not None and not knows_table(row["table_id"]):
        raise ConstraintError(f"{name} of unknown table {row['table_id']}")
    if name != "runs" and row.get("batch_run_id") is not None and not knows_run(row["batch_run_id"]):
        raise ConstraintError(f"{name} of unknown run {row['batch_run_id']}")


class ControlStore:
    """The control tables under one folder.  One driver writes, from any of its threads.

    Configuration and state hold one row a table and are kept in memory too; the
    logs of runs, tasks and events are never read to write them.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._lock, self._seq = RLock(), 0
        self._runs: set[str] = set()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bases = {k: SnapshotTable(spark, f"{self.root}/{k}/base") for k in KEYS}
        self.refresh()

    def refresh(self) -> None:
        """Read configuration and state again, as another driver may have written them."""
        with self._lock:
            self._config = {r["table_id"]: r for r in self.rows("config")}
            self._state = {r["table_id"]: r for r in self.rows("state")}

    def _logs(self, name: str) -> list[tuple[int, object]]:
        """(sequence number, path) of a log's files."""
        at = self._path(f"{self.root}/{name}/log")
        if not self._fs.exists(at):
            return []
        found = [s.getPath() for s in self._fs.listStatus(at)]
        return [(int(p.getName().removesuffix(".json")), p) for p in found if p.getName().endswith(".json")]

    def _numbered(self, name: str) -> DataFrame:
        """Newest row of each key, with its sequence number."""
        schema = f"seq long, {SCHEMAS[name]}"
        base = self._bases[name].read()
        parts = [] if base is None else [base]
        if self._logs(name):
            parts.append(self.spark.read.schema(schema).option("timestampNTZFormat", _STAMP).json(f"{self.root}/{name}/log"))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return top_n(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), KEYS[name], F.desc("seq"), 1)

    def read(self, name: str) -> DataFrame:
        if name == "files":
            published = self.read("tasks").where("status = 'PUBLISHED'")
            return published.select("task_id", "table_id", "published_at", F.inline("files")).select(*(c.split()[0] for c in FILES.split(", ")))
        return self._numbered(name).drop("seq")

    def rows(self, name: str) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.read(name).collect()]

    def _append(self, name: str, rows: list[dict]) -> None:
        if not rows:
            return
        text = lambda v: v.isoformat(timespec="microseconds") if isinstance(v, datetime) else v
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema] if name == "tasks" else [c.split()[0] for c in SCHEMAS[name].split(", ")]
        with self._lock:
            seq = self._seq = max(self._seq + 1, time.time_ns())
        body = "".join(json.dumps({"seq": seq} | {n: text(r.get(n)) for n in names}) + "\n" for r in rows)
        hidden, final = (self._path(f"{self.root}/{name}/log/{x}") for x in (f"_{seq}", f"{seq:020d}.json"))
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        if not self._fs.rename(hidden, final):
            raise OSError(f"cannot add to {name}")

    def _knows_run(self, run: str) -> bool:
        if run not in self._runs and self.read("runs").where(F.col("batch_run_id") == run).isEmpty():
            return False
        self._runs.add(run)
        return True

    def add(self, name: str, rows: list[dict]) -> None:
        """Append rows; a row with a key that is there replaces it for readers."""
        if name == "config":
            check_config((self._config | {r["table_id"]: r for r in rows}).values())
            self._config |= {r["table_id"]: r for r in rows}
        elif name == "state":
            check_state(rows, set(self._config))
            self._state |= {r["table_id"]: r for r in rows}
        else:
            for r in rows:
                check_log(name, r, self._config.__contains__, self._knows_run)
            if name == "runs":
                self._runs |= {r["batch_run_id"] for r in rows}
        self._append(name, rows)

    def compact(self, name: str) -> None:
        """Fold the log into a sorted snapshot.

        Files that the snapshot before holds are deleted now, so a reader of them has
        had the time between two compactions.
        """
        base = self._bases[name]
        before = base.read()
        folded = -1 if before is None else before.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        for seq, path in self._logs(name):
            if seq <= folded:
                self._fs.delete(path, False)
        now = self._numbered(name)
        if self._logs(name):
            version = int((base.version() or "v0")[1:]) + 1
            base.commit(now.repartitionByRange(max(1, len(self._logs(name)) // 10_000), *SORTED[name]).sortWithinPartitions(*SORTED[name]), f"v{version}")

    def register(self, rows: list[dict]) -> None:
        """Add configuration rows with defaults, and the state rows that are missing."""
        given = [CONFIG_DEFAULTS | r for r in rows]
        check_config([*self._config.values(), *given])
        self.add("config", given)
        self.seed_state()

    def seed_state(self) -> None:
        self.add("state", [STATE_DEFAULTS | {"table_id": i} for i in sorted(self._config.keys() - self._state.keys())])

    def configure(self, table_id: int, **values: object) -> None:
        with self._lock:
            self.add("config", [self._config[table_id] | values])

    def state(self, table_id: int) -> dict:
        return dict(self._state[table_id])

    def update(self, table_id: int, **values: object) -> None:
        with self._lock:
            self.add("state", [self._state[table_id] | values])

    def lock(self, table_id: int, run: str, now: datetime) -> bool:
        """Take a table's lock if it is free, or stale for six hours."""
        with self._lock:
            state = self._state[table_id]
            if state["locked_by"] and state["locked_by"] != run and now - state["locked_at"] < STALE_LOCK:
                return False
            self.update(table_id, locked_by=run, locked_at=now)
            return True


def clear_stale_locks(state: DataFrame, now: datetime) -> DataFrame:
    """State rows with locks older than six hours removed."""
    stale = F.coalesce(F.col("locked_at") < F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL '6' HOUR"), F.lit(False))
    return state.withColumns({c: F.when(stale, None).otherwise(F.col(c)) for c in ("locked_by", "locked_at")})


def ready_files(files: DataFrame, config: DataFrame, after: object = None) -> DataFrame:
    """Published files with their table's name, newest last; ``after`` is the consumer's watermark."""
    published = files.where("published_at IS NOT NULL")
    if after is not None:
        published = published.where(F.col("published_at") > F.lit(after).cast("timestamp_ntz"))
    return published.join(config.select("table_id", "source_schema", "source_table"), "table_id").select("source_schema", "source_table", "path", "row_count", "byte_size", "published_at")


def create_views(store: ControlStore) -> None:
    """Temporary views of the control tables, and ``files_ready_for_load`` over them."""
    for name in SCHEMAS:
        store.read(name).createOrReplaceTempView(f"md_{name}")
    ready_files(store.read("files"), store.read("config")).createOrReplaceTempView("files_ready_for_load")
