"""The extraction run: watermarked windows, chunks, reconciliation, publish last.

The order verify, file log, marker, unlock is the invariant: whatever step a run
dies at, a retry of the same window replaces its own folder and nothing published
is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import export, manifest, run_folder
from ..sources.files import schema_fingerprint
from .tables import FREQUENCIES, ControlStore

#: Faults and what to do: retry with back-off, smaller chunks, fail without retry, hold, stop the run, disable.
POLICY = {
    "transient": "retry", "resource": "smaller_chunks", "count_mismatch": "fail",
    "schema_drift": "hold", "mass_failure": "stop_run", "repeat_failure": "disable", "unknown": "fail",
}
MAX_ATTEMPTS = 3
REPEATED = 3
MASS_SHARE = 0.5
MASS_LEAST = 4


class ReconcileError(RuntimeError):
    """Rows written and rows in the files differ; nothing is published."""


def decide(fault: str, attempt: int = 1, consecutive: int = 0, failed_share: float = 0.0) -> str:
    """The action for a fault; repeated and mass failures come before its own rule."""
    if failed_share >= MASS_SHARE:
        return POLICY["mass_failure"]
    if consecutive >= REPEATED:
        return POLICY["repeat_failure"]
    action = POLICY[fault]
    return "fail" if action == "retry" and attempt >= MAX_ATTEMPTS else action


def fault_of(error: Exception) -> str:
    """The fault that an error stands for; a caller may know better."""
    if isinstance(error, ReconcileError):
        return "count_mismatch"
    if isinstance(error, MemoryError):
        return "resource"
    return "transient" if isinstance(error, (OSError, TimeoutError)) else "unknown"


def due(config: DataFrame, state: DataFrame, now: datetime | None = None) -> DataFrame:
    """Tables to run in order: priority, then size (baseline) or last duration (incremental), largest first.

    With ``now``, a table that has succeeded in the current unit of its frequency
    (hour, day, week, month) is not due, unless its baseline is unfinished.
    """
    both = config.where("in_scope AND enabled").join(state, "table_id").where("phase <> 'HELD'")
    if now is not None:
        at, fresh = F.lit(now).cast("timestamp_ntz"), F.lit(False)
        for name, unit in FREQUENCIES.items():
            if unit:
                fresh = F.when(F.col("run_frequency") == name, F.date_trunc(unit, "last_success_at") >= F.date_trunc(unit, at)).otherwise(fresh)
        both = both.where((F.col("phase") == "BASELINE") | ~F.coalesce(fresh, F.lit(False)))
    weight = F.when(F.col("phase") == "INCREMENTAL", F.col("last_duration_seconds").cast("long")).otherwise(F.col("est_size_mb"))
    return both.orderBy(F.col("priority").asc_nulls_last(), weight.desc_nulls_last(), "table_id")


def high_mark(source: DataFrame, column: str) -> object:
    return source.agg(F.max(column)).first()[0]


def window(source: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Rows of (low, high]; without low all up to high.  Null change dates are in no window."""
    kept = F.col(column) <= F.lit(high)
    return source.where(kept if low is None else (F.col(column) > F.lit(low)) & kept)


def chunks(source: DataFrame, column: str, step: str) -> list[tuple[object, object]]:
    """Half-open ranges [lo, hi) that cover a column, by an interval such as ``1 month`` or a number.

    Their number is that of a plan, fixed by the column's range and the step.
    """
    lo, hi = source.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return []
    if step.strip().isdigit():
        edges = list(range(int(lo), int(hi) + 1, int(step)))
        return list(zip(edges, [*edges[1:], edges[-1] + int(step)], strict=True))
    each = source.sparkSession.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi), F.expr(f"INTERVAL {step}"))).alias("lo")).orderBy("lo")
    edges = [r[0] for r in each.withColumn("hi", F.col("lo") + F.expr(f"INTERVAL {step}")).collect()]
    return list(zip(edges, [*edges[1:], each.selectExpr(f"max(lo) + INTERVAL {step}").first()[0]], strict=True))


def chunk(source: DataFrame, column: str, lo: object, hi: object, first: bool = False) -> DataFrame:
    """One range; rows without a value of the column go with the first."""
    kept = (F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi))
    return source.where(kept | F.col(column).isNull() if first else kept)


def with_overlap(target: DataFrame, late: DataFrame, keys: list[str], recency: str, tie_breaker: str) -> DataFrame:
    """Take an overlapping window in: the latest row a key of both."""
    from ..operators.windows import latest_per_key

    return latest_per_key(target.unionByName(late), keys, recency, tie_breaker)


def middle(lo: object, hi: object) -> object | None:
    """A value between the bounds of a chunk, None if there is none."""
    if isinstance(lo, int):
        return lo + (hi - lo) // 2 if hi - lo > 1 else None
    half = (hi - lo) / 2
    return lo + half if half.total_seconds() >= 1 else None


class Runner:
    """Runs due tables through ``slots`` threads that share one queue.

    source: table name -> DataFrame.  clock: the time, injected.  closes: when no
    new table or chunk may start.  fail: a hook that tests use to break a step.
    fault: names the fault of an error, which :func:`decide` turns into an action;
    wait: the back-off before the next attempt.

    Each step of a table logs its START and END.  A START is written at once, with
    the events before it, so the log shows where a run that was killed had got to.
    """

    def __init__(self, store: ControlStore, source: Callable[[str], DataFrame], root: str, clock: Callable[[], datetime], slots: int = 6, closes: datetime | None = None, fail: Callable[[str, int], None] = lambda step, table: None, fault: Callable[[Exception], str] = fault_of, wait: Callable[[int], None] = lambda attempt: None) -> None:
        self.fault, self.wait, self._ended = fault, wait, []
        self.store, self.source, self.root, self.clock, self.slots, self.closes, self.fail = store, source, root, clock, slots, closes, fail
        self._lock = Lock()

    def _closed(self, expected_seconds: int | None) -> bool:
        if self.closes is None:
            return False
        left = (self.closes - self.clock()).total_seconds()
        return left <= (expected_seconds or 0)

    def run(self, run_type: str = "SCHEDULED", compact: bool = True) -> dict:
        """One pass over the tables that are due; a ``CATCHUP`` run takes those, too, that have run already."""
        run = self.clock().strftime("%Y%m%d_%H%M%S")
        start = self.clock()
        self.store.refresh()
        self.store.add("runs", [{"batch_run_id": run, "run_type": run_type, "start_at": start, "status": "RUNNING"}])
        queue = [r.asDict() for r in due(self.store.read("config"), self.store.read("state"), start if run_type == "SCHEDULED" else None).collect()]
        self._ended = []
        with ThreadPoolExecutor(self.slots) as pool:
            # Every future is read, so no failure goes unseen.
            results = [f.result() for f in [pool.submit(self._table, run, t) for t in queue]]
        counts = {k: results.count(k) for k in ("SUCCEEDED", "FAILED", "SKIPPED", "HELD")}
        status = "COMPLETE" if not counts["FAILED"] and not counts["HELD"] else "PARTIAL" if counts["SUCCEEDED"] else "FAILED"
        self.store.add("runs", [{"batch_run_id": run, "run_type": run_type, "start_at": start, "end_at": self.clock(), "status": status, "succeeded": counts["SUCCEEDED"], "failed": counts["FAILED"], "skipped": counts["SKIPPED"], "held": counts["HELD"]}])
        if compact:
            for name in ("state", "events"):
                self.store.compact(name)
        return {"batch_run_id": run, "status": status, **counts}

    def plan(self) -> list[dict]:
        """What a run would do now, without writing: tables in order with mode and window."""
        out = []
        for t in due(self.store.read("config"), self.store.read("state"), self.clock()).collect():
            source = self.source(f"{t['source_schema']}.{t['source_table']}")
            high = None if t["load_type"] == "FULL_REFRESH" else high_mark(source, t["change_date_column"])
            out.append({"table_id": t["table_id"], "load_type": t["load_type"], "phase": t["phase"], "low": t["marker"], "high": None if high is None else str(high)})
        return out

    def _table(self, run: str, t: dict) -> str:
        if self._closed(t["last_duration_seconds"]) or self._mass_failure():
            return "SKIPPED"
        out = _Task(self, run, t).run()
        with self._lock:
            self._ended.append(out)
        return out

    def _mass_failure(self) -> bool:
        with self._lock:
            n = len(self._ended)
            return n >= MASS_LEAST and decide("unknown", failed_share=self._ended.count("FAILED") / n) == "stop_run"


class _Task:
    """One table in one run."""

    def __init__(self, runner: Runner, run: str, t: dict) -> None:
        self.runner, self.store, self.run_id, self.t, self.table = runner, runner.store, run, t, t["table_id"]
        self.began, self.step, self._events, self._n = runner.clock(), "SELECT", [], 0

    def _log(self, step: str, kind: str, message: str = "", write: bool = True) -> None:
        self._n += 1
        self._events.append({"event_id": f"{self.run_id}/{self.table}/{self._n:06d}", "batch_run_id": self.run_id, "table_id": self.table, "step": step, "kind": kind, "message": message[:500], "at": self.runner.clock()})
        if write:
            self.store.add("events", self._events)
            self._events = []

    def _enter(self, step: str) -> None:
        """End the step before and start the next one."""
        if self._n:
            self._log(self.step, "END", write=False)
        self.step = step
        self._log(step, "START")
        self.runner.fail(step, self.table)

    def _leave(self, outcome: str, **state: object) -> str:
        self.store.update(self.table, locked_by=None, locked_at=None, **state)
        self._log(self.step, "END", "" if outcome == "SUCCEEDED" else outcome.lower())
        return outcome

    def run(self) -> str:
        try:
            return self._steps()
        except Exception as e:  # one table's failure is recorded and must not stop the others
            self._log(self.step, "ERROR", f"{type(e).__name__}: {e}")
            failures = self.store.state(self.table)["consecutive_failures"] + 1
            self.store.update(self.table, consecutive_failures=failures, locked_by=None, locked_at=None)
            if decide(self.runner.fault(e), MAX_ATTEMPTS, failures) == "disable":
                self.store.configure(self.table, enabled=False)
                self._log(self.step, "WARNING", "disabled after repeated failures")
            return "FAILED"

    def _steps(self) -> str:
        t, table, store = self.t, self.table, self.store
        self._enter("SELECT")
        self._enter("LOCK")
        if not store.lock(table, self.run_id, self.runner.clock()):
            self._log("LOCK", "END", "locked by another run")
            return "SKIPPED"
        self._enter("SCHEMA")
        source = self.runner.source(f"{t['source_schema']}.{t['source_table']}")
        found = schema_fingerprint(source)
        if t["column_hash"] and t["column_hash"] != found:
            self._log("SCHEMA", "WARNING", "columns changed")
            return self._leave("HELD", phase="HELD")
        self._enter("BOUNDS")
        low = high = None
        if t["load_type"] == "INCREMENTAL":
            kind = source.schema[t["change_date_column"]].dataType
            low = self._marked()
            high = t["baseline_boundary"] if t["phase"] == "BASELINE" and t["baseline_boundary"] else high_mark(source, t["change_date_column"])
            if high is None or (low is not None and source.sparkSession.range(1).select(F.lit(str(high)).cast(kind) <= F.lit(low).cast(kind)).first()[0]):
                return self._leave("SKIPPED")
            high = str(high)
            source = window(source, t["change_date_column"], None if low is None else F.lit(low).cast(kind), F.lit(high).cast(kind))
            if low is None and t["phase"] != "BASELINE":
                store.update(table, phase="BASELINE", baseline_boundary=high)
        self._enter("EXTRACT")
        if t["chunk_column"] and low is None and t["load_type"] == "INCREMENTAL":
            # A killed baseline keeps the chunks that it has published.
            finished = store.read("tasks").where((F.col("table_id") == table) & F.col("status").isin("PUBLISHED", "SPLIT") & F.col("chunk_no").isNotNull())
            done = {(r[0], r[1], r[2]) for r in finished.select("window_from", "window_to", "status").collect()}
            for no, bounds in enumerate(chunks(source, t["chunk_column"], t["chunk_size"])):
                if no and self.runner._closed(t["last_duration_seconds"]):
                    return self._leave("SKIPPED")
                self._chunk(source, no, bounds, f"chunk={no:05d}", done, no == 0)
        else:
            self._tried(source, None, (low, high), "")
        self._enter("MARKER")
        after = {"marker": high} if t["load_type"] == "INCREMENTAL" else {}
        now = self.runner.clock()
        return self._leave("SUCCEEDED", **after, phase="INCREMENTAL", baseline_boundary=None, column_hash=found, last_run=self.run_id, last_success_at=now, last_duration_seconds=int((now - self.began).total_seconds()), consecutive_failures=0)

    def _marked(self) -> str | None:
        """The low mark.  A window that a killed run published, but did not mark, counts as marked."""
        low = self.t["marker"]
        if low is None:
            return None
        same = (F.col("table_id") == self.table) & (F.col("status") == "PUBLISHED") & F.col("chunk_no").isNull() & (F.col("window_from") == low)
        found = self.store.read("tasks").where(same).orderBy(F.desc("published_at")).select("window_to").limit(1).collect()
        return found[0][0] if found else low

    def _chunk(self, source: DataFrame, no: int, bounds: tuple, folder: str, done: set, first: bool) -> None:
        """One range, in halves if it is too large for the resources or was halved before."""
        names = tuple(map(str, bounds))
        if (*names, "PUBLISHED") in done:
            return
        if (*names, "SPLIT") not in done:
            try:
                return self._tried(chunk(source, self.t["chunk_column"], *bounds, first=first), no, names, folder)
            except Exception as e:  # which errors ask for smaller chunks is the policy's decision
                if decide(self.runner.fault(e)) != "smaller_chunks" or middle(*bounds) is None:
                    raise
                self._log("EXTRACT", "WARNING", f"smaller chunks after {type(e).__name__}: {e}")
                # Noted, so that a later run finds the halves that were published.
                self._record(no, 1, names, "SPLIT", self.runner.clock(), target=folder)
        half = middle(*bounds)
        self._chunk(source, no, (bounds[0], half), f"{folder}a", done, first)
        self._chunk(source, no, (half, bounds[1]), f"{folder}b", done, False)

    def _tried(self, part: DataFrame, no: int | None, bounds: tuple, folder: str) -> None:
        """Extract one window; transient faults are tried again, as each try replaces its folder."""
        for attempt in range(1, MAX_ATTEMPTS + 1):
            start = self.runner.clock()
            try:
                return self._extract(part, no, bounds, folder, attempt, start)
            except Exception as e:  # which errors end the table is the policy's decision
                action = decide(self.runner.fault(e), attempt)
                if action != "retry":
                    if action != "smaller_chunks" or no is None:
                        self._record(no, attempt, bounds, "FAILED", start, error=f"{type(e).__name__}: {e}"[:500])
                    raise
                self._log(self.step, "RETRY", f"{type(e).__name__}: {e}")
                self.runner.wait(attempt)
        return None

    def _record(self, no: int | None, attempt: int, bounds: tuple, status: str, start: datetime, **more: object) -> None:
        now = self.runner.clock()
        low, high = (None if b is None else str(b) for b in bounds)
        row = {"task_id": f"{self.run_id}/{self.table}/{no if no is not None else '-'}/{low}/{high}", "batch_run_id": self.run_id, "table_id": self.table, "chunk_no": no, "attempt": attempt, "window_from": low, "window_to": high, "status": status}
        self.store.add("tasks", [row | {"start_at": start, "end_at": now, "duration_seconds": int((now - start).total_seconds())} | more])

    def _extract(self, part: DataFrame, no: int | None, bounds: tuple, chunk_folder: str, attempt: int, start: datetime) -> None:
        t = self.t
        folder = run_folder(self.runner.root, t["source_schema"], t["source_table"], t["load_type"], self.run_id) + (f"/{chunk_folder}" if chunk_folder else "")
        written = export(part, folder, t["max_file_size_mb"])
        self._enter("VERIFY")
        spark = part.sparkSession
        files = [{"path": r["url"], "row_count": r["record_count"], "byte_size": r["content_length"]} for r in manifest(spark.read.schema(part.toDF(*(c.lower() for c in part.columns)).schema).parquet(folder)).collect()]
        counted = sum(f["row_count"] for f in files)
        if counted != written:
            raise ReconcileError(f"{written} rows written, {counted} in the files of {folder}")
        self._enter("PUBLISH")
        self._record(no, attempt, bounds, "PUBLISHED", start, rows_extracted=written, source_rows=written, file_count=len(files), bytes_written=sum(f["byte_size"] for f in files), target=folder, published_at=self.runner.clock(), files=files)
