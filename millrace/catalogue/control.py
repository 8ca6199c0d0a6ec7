"""Extraction, operational queries and the status report."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..control import extract, ops, report
from ..control.tables import ControlStore, clear_stale_locks, ready_files
from ..settings import resolve
from ..sources.files import pending_per_token
from ..workspace import scratch
from .registry import Tables, query

LOW, HIGH = "1996-01-01", "1996-06-01"


def _stamp(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '{LOW}' AND o_orderdate <= TIMESTAMP '{HIGH}'")
def extract_incremental_window(t: Tables) -> DataFrame:
    return extract.window(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", _stamp(LOW), _stamp(HIGH))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= (SELECT MAX(o_orderdate) FROM orders)")
def extract_chunked_baseline(t: Tables) -> DataFrame:
    """The chunks of a baseline, put together again, are the whole."""
    orders = t.orders.select("o_orderkey", "o_orderdate")
    bounded = extract.window(orders, "o_orderdate", None, extract.high_mark(orders, "o_orderdate"))
    out = None
    for no, (lo, hi) in enumerate(extract.chunks(bounded, "o_orderdate", "1 year")):
        part = extract.chunk(bounded, "o_orderdate", lo, hi, first=no == 0)
        out = part if out is None else out.union(part)
    return out


def _run(t: Tables) -> ControlStore:
    store = ControlStore(t.spark, scratch(t.spark, "control"))
    store.register([
        {"table_id": 1, "source_schema": "sales", "source_table": "orders", "in_scope": True, "change_date_column": "o_orderdate", "chunk_column": "o_orderdate", "chunk_size": "3 year", "priority": 10},
        {"table_id": 2, "source_schema": "sales", "source_table": "nation", "in_scope": True, "load_type": "FULL_REFRESH", "priority": 20},
        {"table_id": 3, "source_schema": "sales", "source_table": "customer", "in_scope": True, "change_date_column": "c_custkey", "marker_type": "number", "priority": 30},
        {"table_id": 4, "source_schema": "sales", "source_table": "scratchpad"},
    ])
    extract.Runner(store, lambda name: getattr(t, name.split(".")[1]), scratch(t.spark, "extract"), lambda: datetime(2024, 1, 2, 3, 4, 5), slots=3).run()
    return store


@query("SELECT 'customer' AS source_table, COUNT(*) AS rows FROM customer UNION ALL SELECT 'nation', COUNT(*) FROM nation UNION ALL SELECT 'orders', COUNT(*) FROM orders")
def extract_reconcile(t: Tables) -> DataFrame:
    store = _run(t)
    return ready_files(store.read("files"), store.read("config")).groupBy("source_table").agg(F.sum("row_count").alias("rows"))


@query("""WITH part(source_table, load_type, chunk, n) AS (SELECT 'customer', 'incremental', '', COUNT(*) FROM customer UNION ALL SELECT 'nation', 'full_refresh', '', COUNT(*) FROM nation
UNION ALL SELECT 'orders', 'incremental', lpad(CAST(date_sub('year', lo, o_orderdate) // 3 AS VARCHAR), 5, '0'), COUNT(*) FROM orders, (SELECT MIN(o_orderdate) AS lo FROM orders) GROUP BY 3)
SELECT 'sales' AS source_schema, source_table, load_type, '20240102_030405' AS run_id, chunk, CAST(n AS BIGINT) AS row_count, TIMESTAMP '2024-01-02 03:04:05' AS published_at FROM part""")
def downstream_ready_files(t: Tables) -> DataFrame:
    """What a consumer finds: rows by folder, read off the published paths."""
    store = _run(t)
    ready = ready_files(store.read("files"), store.read("config"), datetime(2024, 1, 1))
    of = lambda name, pattern: F.regexp_extract("path", f"{name}=({pattern})", 1).alias(name)
    return ready.groupBy("source_schema", "source_table", of("load_type", "[a-z_]+"), of("run_id", "[0-9_]+"), of("chunk", "[0-9]+"), "published_at").agg(F.sum("row_count").alias("row_count"))


#: A control plane made of the test tables, in SQL that both engines read alike: a table of the extraction for each
#: nation, ten runs, and what each extracted (customers of the nation, by the last digit of their key).
FIXTURE = {
    "config": "SELECT n_nationkey + 1 AS table_id, lower(r_name) AS source_schema, lower(n_name) AS source_table, n_nationkey % 5 <> 4 AS in_scope, n_nationkey % 7 <> 6 AS enabled, 10 * (n_regionkey + 1) AS priority FROM nation JOIN region ON r_regionkey = n_regionkey",
    "state": "SELECT n_nationkey + 1 AS table_id, CASE n_nationkey % 4 WHEN 0 THEN 'INCREMENTAL' WHEN 1 THEN 'BASELINE' WHEN 2 THEN 'PENDING' ELSE 'HELD' END AS phase, CASE WHEN n_nationkey % 6 < 5 THEN 1000 + 77 * n_nationkey END AS est_size_mb, n_nationkey % 3 AS consecutive_failures, md5(n_name) AS column_hash, TIMESTAMP '2024-01-01 00:00:00' AS last_success_at FROM nation",
    "tasks": "SELECT n_nationkey + 1 AS table_id, d AS day, CASE WHEN n_nationkey % 5 = 0 THEN 0 END AS chunk_no, 1 + n_nationkey % 3 AS attempt, CASE WHEN (n_nationkey + d) % 9 = 1 THEN 'FAILED' ELSE 'PUBLISHED' END AS status, CASE WHEN n_nationkey % 8 = 3 AND d = 10 THEN 0 ELSE n END AS rows_extracted FROM (SELECT c_nationkey AS n_nationkey, c_custkey % 10 + 1 AS d, 10 + COUNT(*) AS n FROM customer GROUP BY 1, 2) x",
}
DAY_OF = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * day"


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({FIXTURE[n]})" for n in names) + " "


def _control_plane(t: Tables) -> ControlStore:
    """The fixture in a store: 25 tables, ten runs and 250 tasks, whatever the size of the test tables."""
    spark = t.views("nation", "region", "customer")
    store = ControlStore(spark, scratch(spark, "control"))
    rows = {k: [r.asDict() for r in spark.sql(v).collect()] for k, v in FIXTURE.items()}
    store.register([r | {"load_type": "FULL_REFRESH"} for r in rows["config"]])
    store.add("state", [store.state(r["table_id"]) | r for r in rows["state"]])
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    for d in sorted({r["day"] for r in rows["tasks"]}):
        of_day = [r for r in rows["tasks"] if r["day"] == d]
        failed = sum(r["status"] == "FAILED" for r in of_day)
        store.add("runs", [{"batch_run_id": f"r{d:02d}", "run_type": "SCHEDULED", "start_at": at(d), "status": "RUNNING"}])
        store.add("tasks", [
            {"task_id": f"r{d:02d}/{r['table_id']}", "batch_run_id": f"r{d:02d}", "table_id": r["table_id"], "chunk_no": r["chunk_no"], "attempt": r["attempt"], "window_from": f"{d - 1:02d}", "window_to": f"{d:02d}",
             "status": r["status"], "rows_extracted": r["rows_extracted"], "source_rows": r["rows_extracted"], "start_at": at(d), "error": "lost" if r["status"] == "FAILED" else None} for r in of_day
        ])
        kinds = {"FAILED": [("EXTRACT", "START"), ("EXTRACT", "ERROR")], "PUBLISHED": [("EXTRACT", "START"), ("EXTRACT", "END"), ("MARKER", "START"), ("MARKER", "END")]}
        store.add("events", [{"event_id": f"r{d:02d}/{r['table_id']}/{i}", "batch_run_id": f"r{d:02d}", "table_id": r["table_id"], "step": s, "kind": k, "at": at(d) + timedelta(seconds=i)} for r in of_day for i, (s, k) in enumerate(kinds[r["status"]])])
        store.add("runs", [{"batch_run_id": f"r{d:02d}", "run_type": "SCHEDULED", "start_at": at(d), "end_at": at(d) + timedelta(hours=1), "status": "PARTIAL" if failed else "COMPLETE", "succeeded": len(of_day) - failed, "failed": failed, "skipped": 0, "held": 0}])
    for name in ("tasks", "events"):
        store.compact(name)
    return store


@query(_with("config", "state") + """, scoped AS (SELECT phase, est_size_mb FROM state JOIN config USING (table_id) WHERE in_scope)
SELECT phase, COUNT(*) AS tables, CAST(ROUND(SUM(est_size_mb) / 1024.0, 1) AS DOUBLE) AS gb_estimated, CAST(ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM scoped), 1) AS DOUBLE) AS pct_of_tables FROM scoped GROUP BY phase""")
def ops_progress(t: Tables) -> DataFrame:
    return ops.progress(_control_plane(t))


@query(_with("config", "state") + """SELECT source_schema, source_table, phase, priority, CAST(ROUND(est_size_mb / 1024.0, 1) AS DOUBLE) AS gb_estimated, consecutive_failures
FROM state JOIN config USING (table_id) WHERE in_scope AND enabled AND phase IN ('PENDING', 'BASELINE')""")
def ops_outstanding(t: Tables) -> DataFrame:
    return ops.outstanding(_control_plane(t))


@query(_with("tasks") + f"""SELECT 'r' || lpad(CAST(day AS VARCHAR), 2, '0') AS batch_run_id, 'SCHEDULED' AS run_type, CASE WHEN COUNT(*) FILTER (status = 'FAILED') > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
{DAY_OF} AS start_at, {DAY_OF} + INTERVAL 1 HOUR AS end_at, CAST(COUNT(*) FILTER (status <> 'FAILED') AS INTEGER) AS tables_succeeded, CAST(COUNT(*) FILTER (status = 'FAILED') AS INTEGER) AS tables_failed, 0 AS tables_skipped
FROM tasks GROUP BY day ORDER BY day DESC LIMIT 7""")
def ops_last_runs(t: Tables) -> DataFrame:
    return ops.last_runs(_control_plane(t))


@query(_with("config", "tasks") + """SELECT source_schema, source_table, CAST(chunk_no AS INTEGER) AS chunk_no, attempt, '09' AS window_from, '10' AS window_to, rows_extracted, rows_extracted AS source_rows, 'lost' AS error
FROM tasks JOIN config USING (table_id) WHERE status = 'FAILED' AND day = (SELECT MAX(day) FROM tasks)""")
def ops_failures(t: Tables) -> DataFrame:
    return ops.failures(_control_plane(t))


@query(_with("config", "tasks") + f""", steps AS (SELECT * FROM (VALUES ('FAILED', 0, 'EXTRACT', 'START'), ('FAILED', 1, 'EXTRACT', 'ERROR'), ('PUBLISHED', 0, 'EXTRACT', 'START'), ('PUBLISHED', 1, 'EXTRACT', 'END'), ('PUBLISHED', 2, 'MARKER', 'START'), ('PUBLISHED', 3, 'MARKER', 'END')) v(status, i, step, kind))
SELECT {DAY_OF} + INTERVAL 1 SECOND * i AS event_at, step, kind, CAST(NULL AS VARCHAR) AS message FROM tasks JOIN config USING (table_id) JOIN steps USING (status) WHERE source_schema = 'europe' AND source_table = 'france' ORDER BY event_at DESC LIMIT 50""")
def ops_where_did_it_stop(t: Tables) -> DataFrame:
    return ops.where_it_stopped(_control_plane(t), "europe", "france")


@query(_with("config", "tasks") + """, history AS (SELECT table_id, list(rows_extracted ORDER BY day DESC) AS n FROM tasks WHERE status = 'PUBLISHED' AND chunk_no IS NULL GROUP BY table_id)
SELECT source_schema, source_table, n[1] AS latest_rows, ROUND(list_avg(n[2:8]), 0) AS prior_7_avg FROM history JOIN config USING (table_id) WHERE n[1] < 0.2 * list_avg(n[2:8])""")
def ops_anomaly(t: Tables) -> DataFrame:
    return ops.anomalies(_control_plane(t))


@query(_with("config", "state") + "SELECT source_schema, source_table, column_hash, last_success_at FROM state JOIN config USING (table_id) WHERE phase = 'HELD'")
def ops_held(t: Tables) -> DataFrame:
    return ops.held(_control_plane(t))


@query("SELECT * FROM (SELECT DISTINCT CAST(10 + s_nationkey AS INTEGER) AS tb FROM supplier) s, (VALUES (300), (750), (1500)) r(gb_per_hour), LATERAL (SELECT CAST(ROUND(tb * 1024.0 / gb_per_hour, 0) AS BIGINT) AS hours) h")
def baseline_hours_projection(t: Tables) -> DataFrame:
    return ops.hours_of_baseline(t.supplier.select((F.col("s_nationkey") + 10).cast("int").alias("tb")).distinct(), [300, 750, 1500])


#: The report's fixtures: catalogue and job engine.
JOBS = [("Job_A", "P1", ""), ("Job_B", "P1", "late"), ("Job_C", "P2", ""), ("Job_D", "P2", ""), ("Job_E", "P3", None), ("Job_F", "P3", ""), ("Job_G", "P3", "")]
FOUND = [
    ("Job_A", "RUN OK (1)", "2026-06-18 02:03:00", "2026-06-18 04:11:00", "feed_20260617.dat"), ("Job_B", "RUN OK with warnings (2)", "2026-06-18 03:00:00", "2026-06-18 05:42:00", None),
    ("Job_C", "RUNNING (0)", "2026-06-18 04:34:00", None, None), ("Job_D", "ABORTED (3)", "2026-06-18 05:02:00", None, None), ("Job_E", "COMPILED (12)", "2026-06-18 05:30:00", None, None),
    ("Job_F", "NOT RUNNING (21)", "2026-06-18 06:15:00", None, None), ("Job_G", "UNKNOWN (-1)", None, None, None),
]
def _found(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(FOUND, "job string, status_text string, started string, ended string, landed string")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("""SELECT * FROM (VALUES (0, 'Job A', 'P1', 'Completed', '#98FB98', '02:03', '04:11', '20260617', '—'), (1, 'Job B', 'P1', 'Completed', '#98FB98', '03:00', '05:42', '20260618', 'late'),
(2, 'Job C', 'P2', 'In Progress', '#98FB98', '04:34', '---', '20260618', '—'), (3, 'Job D', 'P2', 'Aborted', '#FFA07A', '05:02', '---', '20260618', '—'), (4, 'Job E', 'P3', 'Compile Issue', '#F4FA58', '---', '---', '20260618', '—'),
(5, 'Job F', 'P3', 'Yet to Start', '#98FB98', '---', '---', '20260618', '—'), (6, 'Job G', 'P3', 'Unknown', 'orange', '---', '---', 'N/A', '—')) v(ordinal, job, project, label, colour, started_at, ended_at, processing_date, note)""")
def job_status_report(t: Tables) -> DataFrame:
    jobs = t.spark.createDataFrame([(*r, i) for i, r in enumerate(JOBS)], "job string, project string, info string, ordinal int")
    return report.job_report(jobs, _found(t))


#: A token for each order priority, named in the file of each pending order; the job of the third was aborted.
TOKEN_OF = "concat('TOK_', substring(o_orderpriority, 1, 1))"


@query(f"""WITH tokens AS (SELECT DISTINCT {TOKEN_OF} AS token, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS ordinal FROM orders UNION SELECT 'TOK_9', 9),
waiting AS (SELECT {TOKEN_OF} AS token, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT ordinal, concat('Source ', ordinal) AS job, concat('P', ordinal % 2) AS project, CASE WHEN ordinal = 3 THEN 'Aborted' WHEN COALESCE(n, 0) > 0 THEN 'Yet to Run' ELSE 'Completed - no pending batches' END AS label,
CASE WHEN ordinal = 3 THEN '#FFA07A' ELSE '#98FB98' END AS colour, COALESCE(n, 0) AS pending, '—' AS note FROM tokens LEFT JOIN waiting USING (token)""")
def pending_batches(t: Tables) -> DataFrame:
    """Files that wait are counted by the token in their name."""
    spark = t.views("orders")
    tokens = spark.sql(f"SELECT DISTINCT {TOKEN_OF} AS token, CAST(substring(o_orderpriority, 1, 1) AS INT) AS ordinal FROM orders UNION SELECT 'TOK_9', 9")
    tokens = tokens.selectExpr("token", "ordinal", "concat('Source_', ordinal) AS job", "concat('P', ordinal % 2) AS project", "'' AS info")
    found = tokens.select("job", F.when(F.col("ordinal") == 3, "ABORTED (3)").otherwise("RUN OK (1)").alias("status_text"))
    names = spark.sql(f"SELECT concat('/in/TOK_/', o_orderkey, '_', {TOKEN_OF}, '_x.TOK') AS path FROM orders WHERE o_orderstatus = 'P'")
    return report.token_report(tokens, found, pending_per_token(tokens.select("token"), names))


@query("""SELECT * FROM (VALUES ('Job A', 'P1', 'Completed', '02:03', '04:11')) v(job, project, label, started_at, ended_at)""")
def job_report_of_one(t: Tables) -> DataFrame:
    jobs = t.spark.createDataFrame([(*r, i) for i, r in enumerate(JOBS)], "job string, project string, info string, ordinal int")
    return report.job_report(jobs, _found(t), only="Job_A").select("job", "project", "label", "started_at", "ended_at")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01 04:00:00' THEN NULL ELSE o_clerk END AS locked_by, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01 04:00:00' THEN NULL ELSE o_orderdate END AS locked_at
FROM (SELECT o_orderkey, concat('run_', o_custkey) AS o_clerk, o_orderdate FROM orders)""")
def stale_locks_cleared(t: Tables) -> DataFrame:
    locks = t.orders.select("o_orderkey", F.concat(F.lit("run_"), "o_custkey").alias("locked_by"), F.col("o_orderdate").cast("timestamp_ntz").alias("locked_at"))
    return clear_stale_locks(locks, datetime(1996, 1, 1, 10))


@query("SELECT * FROM (VALUES ('batch_size', '2000', 'env var PIPELINE_BATCH_SIZE'), ('dry_run', 'True', 'flag --dry-run'), ('target', 'prod_db', 'environments.prod')) v(setting, value, came_from)")
def settings_resolution(t: Tables) -> DataFrame:
    found = resolve({"batch_size": 500, "dry_run": False, "target": "dev_db"}, {"prod": {"target": "prod_db"}}, "prod", {"PIPELINE_BATCH_SIZE": "2000"}, {"dry_run": True})
    return t.spark.createDataFrame(found.rows(), "setting string, value string, came_from string")
