"""Hand-checked values of small fixtures, and properties of plans and operators."""

import json
from datetime import date, datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import settings as st
from millrace.control import extract, report
from millrace.control.tables import ConstraintError, ControlStore, check_config, clear_stale_locks, ready_files
from millrace.operators import aggregates, joins, layout, merge, windows
from millrace.plans import inspect, pruning
from millrace.sources import files, generators
from millrace.streaming import evolution, ingest

SALES = [("North", "Ana", 1, 100), ("North", "Ben", 2, 100), ("North", "Cy", 3, 60), ("South", "Dee", 1, 200), ("South", "Eli", 2, 50)]


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, "region string, rep string, sale_day int, amount int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_totals_and_frames(sales):
    assert rows(sales.groupBy("region").agg(F.sum("amount"))) == [("North", 260), ("South", 250)]
    run = sales.select("rep", F.sum("amount").over(windows.frame(["region"], "sale_day")))
    assert rows(run) == [("Ana", 100), ("Ben", 200), ("Cy", 260), ("Dee", 200), ("Eli", 250)]
    peers = sales.where("region = 'North'").select("rep", F.sum("amount").over(windows.frame(["region"], F.desc("amount"))))
    assert rows(peers) == [("Ana", 200), ("Ben", 200), ("Cy", 260)]
    whole = sales.select("rep", F.sum("amount").over(windows.frame(["region"], "sale_day", "whole")))
    assert dict(rows(whole))["Ana"] == 260
    assert whole.count() == sales.count()


def test_ranks_on_ties(sales):
    north = windows.rank_family(sales.where("region = 'North'"), ["region"], [F.desc("amount")]).orderBy("row_number")
    assert [(r.row_number, r["rank"], r.dense_rank) for r in north.collect()] == [(1, 1, 1), (2, 1, 1), (3, 3, 2)]


def test_qualify(spark):
    s = spark.createDataFrame([("North", "Ana", 100), ("North", "Ben", 90), ("North", "Cy", 60), ("South", "Dee", 200), ("South", "Eli", 50)], "region string, rep string, amount int")
    best = windows.qualify(s, F.row_number().over(Window.partitionBy("region").orderBy(F.desc("amount"))) == 1)
    assert rows(best) == [("North", "Ana", 100), ("South", "Dee", 200)] and best.columns == s.columns
    assert [r.rep for r in windows.above_group_average(s, ["region"], "amount").orderBy("rep").collect()] == ["Ana", "Ben", "Dee"]
    s.createOrReplaceTempView("s")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM s WHERE ROW_NUMBER() OVER (ORDER BY amount) = 1").collect()


def test_latest_needs_and_uses_tie_breaker(spark):
    t = lambda d: datetime(2024, *d)
    u = spark.createDataFrame(
        [(1, t((1, 1, 9)), 1, "new"), (1, t((1, 5, 9)), 2, "active"), (1, t((3, 1, 9)), 3, "churned"), (2, t((1, 1, 9)), 1, "new"), (2, t((2, 1, 9)), 2, "active"), (2, t((2, 1, 9)), 3, "suspended"), (3, None, 9, "never"), (3, t((1, 1, 9)), 1, "seen")],
        "customer_id int, updated_at timestamp_ntz, version int, status string",
    )
    latest = windows.latest_per_key(u, ["customer_id"], "updated_at", "version")
    assert [(r.customer_id, r.status, r.version) for r in latest.orderBy("customer_id").collect()] == [(1, "churned", 3), (2, "suspended", 3), (3, "seen", 1)]
    assert "WindowGroupLimit" in {n.name for n in inspect.nodes(latest)}
    with pytest.raises(ValueError):
        windows.latest_per_key(u, ["customer_id"], "updated_at", [])


def customers(spark, data):
    return spark.createDataFrame([(i, n, None if b is None else Decimal(b), date(2024, 1, d)) for i, n, b, d in data], "customer_id int, full_name string, balance decimal(12,2), updated_at date")


DIM = [(1, "Ann", "1200.00", 1), (2, "Bob", "850.50", 1), (3, "Cat", "2400.00", 1)]
STG = [(2, "Bob", "900.75", 2), (3, "Cat", "2400.00", 1), (4, "Dan", "500.00", 2)]


def test_merge_is_idempotent(spark):
    dim, stg = customers(spark, DIM), customers(spark, STG)
    once = merge.merge(dim, stg, ["customer_id"])
    assert {r.customer_id: str(r.balance) for r in once.collect()} == {1: "1200.00", 2: "900.75", 3: "2400.00", 4: "500.00"}
    assert joins.same_rows(merge.merge(once, stg, ["customer_id"]), once)
    assert aggregates.fingerprint(once).first() == aggregates.fingerprint(merge.merge(once, stg, ["customer_id"])).first()


def test_merge_guards_and_nulls(spark):
    dim = customers(spark, DIM)
    twice = customers(spark, [(2, "Bob", "900.75", 2), (2, "Bob", "999.99", 3)])
    with pytest.raises(merge.AmbiguousMergeError):
        merge.merge(dim, twice, ["customer_id"])
    assert {str(r.balance) for r in merge.merge(dim, twice, ["customer_id"], dedupe_by=("updated_at", "balance")).where("customer_id = 2").collect()} == {"999.99"}
    narrowed = merge.merge(dim, twice, ["customer_id"], matched=F.col("updated_at") == date(2024, 1, 3))
    assert narrowed.count() == 3 and narrowed.where("balance = 999.99").count() == 1
    wiped = merge.merge(dim, customers(spark, [(2, None, None, 2), (None, "Nil", "1.00", 2)]), ["customer_id"])
    assert wiped.where("customer_id = 2 AND balance IS NULL AND full_name IS NULL").count() == 1
    assert wiped.where("customer_id IS NULL").count() == 1
    new_twice = customers(spark, [(9, "X", "1.00", 2), (9, "Y", "2.00", 2)])
    with pytest.raises(merge.AmbiguousMergeError):
        merge.merge(dim, new_twice, ["customer_id"])
    assert merge.merge(dim, new_twice, ["customer_id"], on_duplicate_insert="allow").where("customer_id = 9").count() == 2


def test_merge_branches(spark):
    dim, stg = customers(spark, DIM), customers(spark, STG)
    assert rows(merge.merge(dim, stg, ["customer_id"], delete_when=F.col("balance") < 1000).select("customer_id")) == [(1,), (3,), (4,)]
    assert rows(merge.merge(dim, stg, ["customer_id"], not_matched_by_source="delete").select("customer_id")) == [(2,), (3,), (4,)]
    assert rows(merge.merge(dim, stg, ["customer_id"], columns=["updated_at"]).where("customer_id = 2").select("balance")) == [(Decimal("850.50"),)]
    assert merge.merge(dim, stg, ["customer_id"], insert=False).count() == 3


def test_snapshot_replay(spark, tmp_path):
    table = merge.SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.commit(spark.range(3).toDF("id"), "v1")
    assert not table.commit(spark.range(9).toDF("id"), "v1") and table.read().count() == 3
    assert table.commit(spark.range(5).toDF("id"), "v2") and table.read().count() == 5 and table.version() == "v2"


def test_salting(spark):
    orders, people = generators.skewed_orders(spark, 20_000, customers=40)
    plain = orders.join(people, "customer_id")
    assert joins.busiest(orders, ["customer_id"]).first()[0] == 16_000
    hot = joins.hot_keys(orders, "customer_id", 1000)
    assert [r.customer_id for r in hot.collect()] == ["ACME_CORP"]
    for salted in (joins.salted_join(orders, people, "customer_id"), joins.conditional_salted_join(orders, people, "customer_id", 1000), joins.conditional_salted_join(orders, people, "customer_id", 1000, seed=3)):
        assert joins.same_rows(plain.select(*salted.columns), salted)
    load = joins.busiest(orders.withColumn("s", F.col("order_id") % 16), ["customer_id", "s"]).first()[0]
    assert load == 1000
    with pytest.raises(ValueError):
        joins.salted_join(orders, people, "customer_id", how="full")


def test_salting_repeats_are_not_broadcast(spark):
    orders, people = generators.skewed_orders(spark, 20_000, customers=40)
    for how in ("inner", "left"):
        salted = joins.salted_join(orders, people, "customer_id", how=how)
        assert len(salted.collect()) == 20_000  # collected, so that the plan is the one that ran
        assert "SortMergeJoin" in inspect.joins_and_exchanges(salted) and not inspect.broadcasts(salted)


def test_salting_full_counts(spark):
    orders, people = generators.skewed_orders(spark, 2_000_000)
    assert people.count() == 4001 and joins.busiest(orders, ["customer_id"]).first()[0] == 1_600_000
    assert joins.busiest(orders.withColumn("s", F.col("order_id") % 16), ["customer_id", "s"]).first()[0] == 100_000
    copies = people.withColumn("h", F.col("customer_id") == "ACME_CORP").agg(F.sum(F.when(F.col("h"), 16).otherwise(1)), F.count("*") * 16).first()
    assert tuple(copies) == (4016, 64016)


def test_join_strategies(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact, dim = generators.fact_and_dimension(spark, 2_000_000, 200)
        merged, sent = fact.join(dim.hint("merge"), "dim_id"), joins.guarded_join(fact, dim, ["dim_id"])
        assert (inspect.shuffles(merged), inspect.broadcasts(merged)) == (2, 0)
        assert (inspect.shuffles(sent), inspect.broadcasts(sent)) == (0, 1)
        assert merged.count() == sent.count() == 2_000_000
        assert joins.choose_join(dim, limit=10) == "merge"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_narrow_and_wide(spark):
    from millrace.catalogue import QUERIES

    found = {r.operation: r.kind for r in QUERIES["narrow_wide_report"].run(spark, "/root/testdata/sf0.001").collect()}
    assert [k for k, v in found.items() if v == "narrow"] == ["filter", "select", "withColumn", "union", "coalesce"] and len(found) == 10


def test_generated_orders(spark):
    g = generators.sample_orders(spark)
    assert dict(rows(g.groupBy("country").agg(F.sum("amount")))) == {"AU": 9_990_000, "DE": 10_030_000, "IN": 10_050_000, "UK": 10_010_000, "US": 9_970_000}
    one = g.agg(F.count_if(F.col("score") > 100), F.round(F.avg("amount"), 2), F.min("amount"), F.max("amount"), F.count_distinct("customer_id")).first()
    assert tuple(one) == (49_500, 500.5, 1, 1000, 500)


def test_pruning(spark, tmp_path):
    part, flat = str(tmp_path / "p"), str(tmp_path / "f")
    events = generators.daily_events(spark, 50_000)
    layout.write_partitioned(events, part, "dt")
    layout.write_flat(events, flat)
    day = files.read_partitioned(spark, part).where("dt = '2024-01-05'")
    assert day.count() == spark.read.parquet(flat).where("dt = '2024-01-05'").count() == 5000
    assert "dt" in inspect.scan_filters(day)["PartitionFilters"] and "string" not in inspect.scan_filters(day.select("id"))["ReadSchema"]
    assert "EqualTo(dt" in inspect.scan_filters(spark.read.parquet(flat).where("dt = '2024-01-05'"))["PushedFilters"]
    size = pruning.bytes_by_layout(spark.read.parquet(flat), files.read_partitioned(spark, part), "dt", "2024-01-05")
    assert size["partitioned"] < 0.3 * size["flat"]
    assert files.total_bytes(files.listing(spark, part, "*.parquet")) > 0


def test_clustering(spark, tmp_path):
    d = spark.range(16_000).select("id", (F.col("id") * 7919 % 16_000).alias("k"))
    d.repartition(16, "id").write.parquet(str(tmp_path / "a"))
    layout.write_clustered(d, str(tmp_path / "b"), "k", 16)
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert tuple(pruning.clustering_depth(a, "k").first()) == (16, 16.0) and pruning.clustering_depth(b, "k").first()[1] == 1.0
    assert pruning.pruning_report(a, "k", 8000).first().pct == 100.0 and pruning.pruning_report(b, "k", 8000).first().scanned == 1
    assert pruning.pruning_report(b, "k", 8000, wrapped=True).first().scanned == 16
    assert inspect.wrapped_columns("to_char(event_date) = '2024'", ["event_date"]) == ["event_date"] and not inspect.wrapped_columns("event_date = '2024'", ["event_date"])


def drop(folder: Path, name: str, lines: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(x) + "\n" for x in lines))


SUBURB = "sale_id long, suburb string, price long"


def test_incremental_ingest(spark, tmp_path):
    land, target, check = tmp_path / "land", str(tmp_path / "bronze"), str(tmp_path / "check")
    sale = lambda i: {"sale_id": i, "suburb": "Ryde", "price": i * 100}
    seen, totals = [], []
    for name, ids in (("day1.json", [1, 2]), ("day2.json", [3]), ("day3.json", [4, 5]), (None, []), ("day1.json", [1, 2, 6])):
        if name:
            drop(land, name, [sale(i) for i in ids])
        seen.append(ingest.ingest(spark, str(land), target, check, SUBURB))
        totals.append(ingest.total_rows(spark, target))
    assert seen == [2, 1, 2, 0, 0] and totals == [2, 3, 5, 5, 5]
    assert ingest.processed_files(spark, check).select("path").distinct().count() == 3
    assert ingest.total_rows(spark, str(tmp_path / "none")) == 0


def test_journal_reads_overwritten_files(spark, tmp_path):
    import os

    land, got = tmp_path / "land", []
    drop(land, "a.json", [{"x": 1}])
    journal = ingest.Journal(spark, str(tmp_path / "journal"))
    take = lambda found: got.extend(r.path for r in found.collect())
    assert journal.run(str(land), take) == 1 and journal.run(str(land), take) == 0
    drop(land, "a.json", [{"x": 2}])
    os.utime(land / "a.json", (2_000_000_000, 2_000_000_000))
    assert journal.run(str(land), take) == 1 and len(got) == 2

    def broken(found):
        raise OSError("half way")

    drop(land, "b.json", [{"x": 3}])
    with pytest.raises(OSError):
        journal.run(str(land), broken)
    assert journal.run(str(land), take) == 1 and journal.run(str(land), take) == 0


def test_foreach_batch_upsert(spark, tmp_path):
    land, table = tmp_path / "land", merge.SnapshotTable(spark, str(tmp_path / "silver"))
    handle = ingest.upsert_batches(table, ["sale_id"], "price", "suburb")
    drop(land, "a.json", [{"sale_id": 1, "suburb": "Ryde", "price": 5}, {"sale_id": 1, "suburb": "Ryde", "price": 7}])
    ingest.ingest_each(spark, str(land), str(tmp_path / "check"), SUBURB, handle)
    drop(land, "b.json", [{"sale_id": 1, "suburb": "Epping", "price": 9}, {"sale_id": 2, "suburb": "Ryde", "price": 1}])
    ingest.ingest_each(spark, str(land), str(tmp_path / "check"), SUBURB, handle)
    assert rows(table.read()) == [(1, "Epping", 9), (2, "Ryde", 1)]
    handle(spark.createDataFrame([(9, "X", 1)], SUBURB), 1)  # replayed batch
    assert table.read().count() == 2


def test_partitioned_upsert_rewrites_what_it_touches(spark, tmp_path):
    land, table = tmp_path / "land", merge.PartitionedTable(spark, str(tmp_path / "silver"), ["sale_id"], parts=8)
    handle = ingest.upsert_batches(table, ["sale_id"], "price", "suburb")
    drop(land, "a.json", [{"sale_id": i, "suburb": "Ryde", "price": i} for i in range(40)] + [{"sale_id": 3, "suburb": "Ryde", "price": 99}, {"suburb": "X", "price": 1}])
    ingest.ingest_each(spark, str(land), str(tmp_path / "check"), SUBURB, handle)
    before = table._current()
    drop(land, "b.json", [{"sale_id": 5, "suburb": "Epping", "price": 1000}])
    ingest.ingest_each(spark, str(land), str(tmp_path / "check"), SUBURB, handle)
    after = table._current()
    assert len(before) == 8 and sum(before[p] != after[p] for p in before) == 1
    want = {i: ("Ryde", i) for i in range(40)} | {3: ("Ryde", 99), 5: ("Epping", 1000), None: ("X", 1)}
    assert {r.sale_id: (r.suburb, r.price) for r in table.read().collect()} == want and table.read().count() == 41
    handle(spark.createDataFrame([(9, "X", 1)], SUBURB), 1)  # replayed batch
    assert table.vacuum() == 1 and table.read().count() == 41


def test_snapshots_keep_two_versions(spark, tmp_path):
    table = merge.SnapshotTable(spark, str(tmp_path / "t"))
    for i in range(4):
        table.commit(spark.range(i + 1).toDF("x"), f"v{i}")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["v2", "v3"] and table.read().count() == 4


def test_watch_hands_arrivals_over(spark, tmp_path):
    land, got = tmp_path / "land", []
    land.mkdir()
    query = ingest.watch(spark, str(land), str(tmp_path / "check"), "x long", lambda batch, i: got.extend(r.x for r in batch.collect()), every="100 milliseconds")
    try:
        drop(land, "a.json", [{"x": 1}, {"x": 2}])
        query.processAllAvailable()
        drop(land, "b.json", [{"x": 3}])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(got) == [1, 2, 3]


def test_schema_evolution(spark, tmp_path):
    land, store = tmp_path / "land", evolution.SchemaStore(spark, str(tmp_path / "schemas"))
    drop(land, "a.json", [{"id": 1}])
    assert evolution.track(spark, store, [str(land / "a.json")]).names == ["id"]
    drop(land, "b.json", [{"id": 2, "agent": "Z"}])
    with pytest.raises(evolution.UnknownFieldError):
        evolution.track(spark, store, [str(land / "b.json")])
    assert evolution.track(spark, store, [str(land / "b.json")]).names == ["id", "agent"]
    drop(land, "c.json", [{"id": 3, "extra": 1}])
    assert evolution.track(spark, store, [str(land / "c.json")], mode="rescue").names == ["id", "agent"]


def test_rescued(spark, tmp_path):
    lines = ['{"sale_id": 1, "price": 10}', '{"sale_id": 2, "price": "ten", "Suburb": "Ryde"}', "not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "r"))
    schema = spark.createDataFrame([], "sale_id long, price long").schema
    got = [tuple(r) for r in evolution.rescued(spark.read.text(str(tmp_path / "r")).select("value", "_metadata"), schema).orderBy(F.col("sale_id").asc_nulls_last()).collect()]
    assert got[0] == (1, 10, None)
    second = json.loads(got[1][2])
    assert got[1][:2] == (2, None) and second.pop("_file_path").startswith("file:") and second == {"price": "ten", "Suburb": "Ryde"}
    assert got[2][:2] == (None, None) and json.loads(got[2][2])["_line"] == "not json"


def test_auto_load(spark, tmp_path):
    land = tmp_path / "land"
    run = lambda mode="addNewColumns": evolution.auto_load(spark, str(land), str(tmp_path / "t"), str(tmp_path / "check"), str(tmp_path / "schemas"), mode)
    drop(land, "a.json", [{"id": 1, "price": 5}, {"id": 2, "price": 6}])
    left = lambda **more: [r.path.rsplit("/", 1)[1] for r in evolution.unread(spark, str(land), str(tmp_path / "check"), **more).collect()]
    assert left() == ["a.json"] and run() == 2 and left() == [] and run() == 0
    drop(land, "b.json", [{"id": 3, "price": "six", "agent": "Z"}])
    assert left() == ["b.json"]
    notices = spark.createDataFrame([(f"file://{land}/{n}.json",) for n in "ab"], "path string")
    assert left(notices=notices) == ["b.json"]
    with pytest.raises(evolution.UnknownFieldError):
        run()
    assert run() == 1
    drop(land, "c.json", [{"id": 4, "extra": 1}])
    assert run("rescue") == 1
    got = {r.id: r for r in layout.read_evolving(spark, str(tmp_path / "t")).collect()}
    assert got[3].agent == "Z" and got[3].price is None and json.loads(got[3]["_rescued_data"])["price"] == "six"
    assert json.loads(got[4]["_rescued_data"])["extra"] == "1" and got[1]["_rescued_data"] is None


def test_events_and_polls(spark, tmp_path):
    event = {"detail": {"bucket": {"name": "b"}, "object": {"key": "incoming/x.json"}}}
    assert ingest.path_of_event(event, "b", "incoming/") == "s3://b/incoming/x.json" and ingest.path_of_event(event, "b", "other/") is None
    drop(tmp_path / "in", "x.json", [{"listing_id": "L1", "price": "100"}])
    assert ingest.ingest_object(spark, str(tmp_path / "in" / "x.json"), str(tmp_path / "out"), {"price": "long"}) == 1
    assert dict(spark.read.parquet(str(tmp_path / "out")).dtypes)["price"] == "bigint"
    looks = iter([[], [], [], ["f"]])
    assert ingest.poll(lambda: next(looks), lambda found: None, lambda: None, 4) == 3


CONFIG = [{"table_id": 1, "source_schema": "s", "source_table": "orders", "in_scope": True, "change_date_column": "ts", "chunk_column": "id", "chunk_size": "40", "priority": 1}, {"table_id": 2, "source_schema": "s", "source_table": "codes", "in_scope": True, "load_type": "FULL_REFRESH"}, {"table_id": 3, "source_schema": "s", "source_table": "parked", "in_scope": True, "enabled": False, "change_date_column": "ts"}]


class Broken(RuntimeError):
    pass


def test_extraction_survives_faults(spark, tmp_path):
    data = {"n": 100}
    tables = {"s.orders": lambda: spark.range(data["n"]).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts")), "s.codes": lambda: spark.range(5).toDF("code")}
    store = ControlStore(spark, str(tmp_path / "control"))
    store.register(CONFIG)
    now = [datetime(2024, 5, 1)]
    fail = {"at": None}

    def hook(step, table):
        if table == 1 and step == fail["at"]:
            raise Broken(step)

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    def run():
        return extract.Runner(store, lambda n: tables[n](), str(tmp_path / "out"), clock, slots=2, fail=hook).run("CATCHUP")

    published = lambda: ready_files(store.read("files"), store.read("config")).where("source_table = 'orders'").agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
    marker = lambda: next(r["marker"] for r in store.rows("state") if r["table_id"] == 1)
    fail["at"] = "PUBLISH"
    first = run()
    assert first["FAILED"] == 1 and first["SUCCEEDED"] == 1 and first["status"] == "PARTIAL" and published() == 0 and marker() is None
    data["n"] = 120  # rows that come between do not enter the bounded baseline
    fail["at"] = "MARKER"
    run()
    assert published() == 100 and marker() is None
    fail["at"] = None
    done = run()
    assert done["SUCCEEDED"] == 2 and published() == 100 and marker() is not None  # published chunks are kept
    run()
    assert published() == 120
    assert run()["SKIPPED"] == 1 and published() == 120
    tables["s.orders"] = lambda: spark.range(120).select("id", F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.lit(1).alias("new"))
    assert run()["HELD"] == 1 and next(r["phase"] for r in store.rows("state") if r["table_id"] == 1) == "HELD"


def test_retries_disabling_and_mass_failure(spark, tmp_path):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.register([{"table_id": i, "source_schema": "s", "source_table": f"t{i}", "in_scope": True, "load_type": "FULL_REFRESH"} for i in range(1, 8)])
    tries, waits, now = [], [], [datetime(2024, 5, 1)]

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    def run(hook):
        return extract.Runner(store, lambda n: spark.range(2), str(tmp_path / "out"), clock, slots=1, fail=hook, wait=waits.append).run("CATCHUP")

    def flaky(step, table):
        if step == "VERIFY" and table == 1:
            tries.append(table)
            if len(tries) < 3:
                raise TimeoutError("slow store")

    assert run(flaky)["SUCCEEDED"] == 7 and waits == [1, 2]
    assert [x["attempt"] for x in store.rows("tasks") if x["table_id"] == 1] == [3] and sum(e["kind"] == "RETRY" for e in store.rows("events")) == 2

    def broken(step, table):
        if step == "VERIFY":
            raise Broken(step)

    first = run(broken)
    assert first["FAILED"] == extract.MASS_LEAST and first["SKIPPED"] == 3 and first["status"] == "FAILED"
    run(broken), run(broken)
    assert {r["table_id"] for r in store.rows("config") if not r["enabled"]} == {1, 2, 3, 4}


def test_control_rules(spark):
    with pytest.raises(ConstraintError):
        check_config([{"table_id": 1, "source_schema": "s", "source_table": "t", "in_scope": True, "load_type": "INCREMENTAL", "change_date_column": None}])
    with pytest.raises(ConstraintError):
        check_config([{"table_id": 1, "source_schema": "s", "source_table": "t", "in_scope": False, "load_type": "WEEKLY", "change_date_column": None}])
    s = spark.createDataFrame([(1, "r", datetime(2024, 1, 1, 0)), (2, "r", datetime(2024, 1, 1, 9))], "table_id int, locked_by string, locked_at timestamp_ntz")
    assert rows(clear_stale_locks(s, datetime(2024, 1, 1, 10)).select("table_id", "locked_by")) == [(1, None), (2, "r")]
    assert extract.decide("transient") == "retry" and extract.decide("transient", attempt=3) == "fail" and extract.decide("resource") == "smaller_chunks"
    assert extract.decide("count_mismatch") == "fail" and extract.decide("schema_drift") == "hold" and extract.decide("transient", consecutive=3) == "disable" and extract.decide("transient", failed_share=0.9) == "stop_run"


def test_chunks_cover(spark):
    d = spark.range(95).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"))
    parts = [extract.chunk(d, "k", lo, hi, first=i == 0) for i, (lo, hi) in enumerate(extract.chunks(d, "k", "20"))]
    assert sum(p.count() for p in parts) == 95 and len(parts) == 5


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    assert layout.export(spark.range(100).repartition(3).toDF("ID"), path) == 100
    doc = layout.manifest_document(spark.read.parquet(path)).first()
    assert doc.total == 100 and sum(e.meta.record_count for e in doc.entries) == 100 and all(e.meta.content_length > 0 for e in doc.entries)


def test_text_and_evolving_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "a int, b string, c string")
    layout.write_lines(d.coalesce(1), str(tmp_path / "t"), " | ")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1 |  | x", "2 | b | y"]
    layout.write_csv(d, str(tmp_path / "c"), "\t")
    assert files.read_csv(spark, str(tmp_path / "c"), "a int, b string, c string", sep="\t").count() == 2
    layout.append_evolving(d.select("a"), str(tmp_path / "e"))
    layout.append_evolving(d, str(tmp_path / "e"))
    assert layout.read_evolving(spark, str(tmp_path / "e")).columns == ["a", "b", "c"] and layout.read_evolving(spark, str(tmp_path / "e")).count() == 4


def test_plan_and_views(spark, tmp_path):
    from millrace.control.tables import create_views
    from millrace.sql import set_variable

    store = ControlStore(spark, str(tmp_path / "control"))
    store.register(CONFIG)
    runner = extract.Runner(store, lambda n: spark.range(3).select("id", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts")), str(tmp_path / "out"), lambda: datetime(2024, 5, 1))
    assert [(p["table_id"], p["load_type"], p["high"]) for p in runner.plan()] == [(1, "INCREMENTAL", "2024-01-01 00:00:00"), (2, "FULL_REFRESH", None)]
    assert store.rows("runs") == [] and not (tmp_path / "out").exists()
    create_views(store)
    set_variable(spark, "low", "2")
    assert spark.sql("SELECT * FROM md_config WHERE table_id >= low").count() == 2 and spark.table("files_ready_for_load").count() == 0


def test_catalogue_file_and_listing(spark, tmp_path):
    (tmp_path / "c.cfg").write_text("# id|job\n\n1|Job_A\n# x\n2|Job_B\n")
    assert [r.job for r in files.read_catalogue(spark, str(tmp_path / "c.cfg"), ["id", "job"]).orderBy("ordinal").collect()] == ["Job_A", "Job_B"]
    for n in ("a_TOK_Y_1.TOK", "b_TOK_Y_2.TOK", "c_TOK_Z.TOK"):
        (tmp_path / n).write_text("x")
    found = files.pending_per_token(spark.createDataFrame([("TOK_X",), ("TOK_Y",), ("TOK_Z",)], "token string"), files.listing(spark, str(tmp_path), "*.TOK"))
    assert dict(rows(found)) == {"TOK_X": 0, "TOK_Y": 2, "TOK_Z": 1}
    assert files.newest(files.listing(spark, str(tmp_path), "*.TOK"), "tok_z").first()[0].endswith("c_TOK_Z.TOK")


def test_report_page(spark):
    df = spark.createDataFrame([(1, "<b>", "Completed", "#98FB98")], "ordinal int, job string, label string, colour string")
    sent = []
    page = report.html_page("Jobs & more", {"t": df}, {"ok": "#98FB98"}, sent.append)
    assert "&lt;b&gt;" in page and "#98FB98" in page and sent == [page]
    t = spark.createDataFrame([("Job start time=2026-01-01 02:03:04\nJob end time: \nJob start time=x",)], "t string")
    assert t.select(report.labelled(F.col("t"), "Job start time"), report.labelled(F.col("t"), "Job end time")).first()[0] == "2026-01-01 02:03:04"


def test_settings():
    base, envs = {"batch_size": 500, "dry_run": False, "target": "dev"}, {"prod": {"target": "prod"}}
    got = st.resolve(base, envs, "prod", {"PIPELINE_BATCH_SIZE": "2000", "PIPELINE_DRY_RUN": "TRUE"}, {"target": None, "batch_size": 9})
    assert got.values == {"batch_size": 9, "dry_run": True, "target": "prod"}
    assert got.origin == {"batch_size": "flag --batch-size", "dry_run": "env var PIPELINE_DRY_RUN", "target": "environments.prod"}
    assert st.resolve(base, envs, "nowhere", {}).values == base
    flags = st.parser(base).parse_args(["--batch-size", "7"])
    assert flags.batch_size == 7 and flags.dry_run is None and flags.target is None
    assert st.coerce("-5") == -5 and st.coerce("x1") == "x1" and st.mask("s") == "****" and st.mask("") == "(not set)"
    with pytest.raises(KeyError):
        st.secret("NOPE", {})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_export_adapters(spark, tmp_path):
    from millrace.operators import exports

    sql = "SELECT * FROM s.t WHERE d > '2024-01-01'"
    texts = {k: exports.StatementExport(spark, k, "role", print).statement(sql, "s3://b/run_id=1/", 64) for k in exports.STATEMENTS}
    assert texts["redshift"].startswith("UNLOAD ('SELECT * FROM s.t WHERE d > ''2024-01-01''')") and "MAXFILESIZE 64 MB" in texts["redshift"] and "CLEANPATH" in texts["redshift"]
    assert "MAX_FILE_SIZE = 67108864" in texts["snowflake"] and "overwrite = true" in texts["bigquery"] and texts["synapse"].endswith(sql)
    folder = str(tmp_path / "run")
    own = exports.SparkExport(lambda q: spark.range(30).toDF("ID"))
    assert own.run(sql, folder) == 30
    sent = []

    def engine(statement):
        sent.append(statement)
        spark.range(7).write.mode("overwrite").parquet(folder)

    assert exports.StatementExport(spark, "snowflake", "lake", engine).run(sql, folder) == 7 and len(sent) == 1


def test_export_keeps_files_under_a_size(spark, tmp_path):
    wide = spark.range(3000, numPartitions=1).select(F.concat_ws("", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(12))).alias("x"))
    assert layout.export(wide, str(tmp_path / "w"), max_file_size_mb=1) == 3000
    sizes = [r.length for r in files.listing(spark, str(tmp_path / "w"), "*.parquet").collect()]
    assert len(sizes) > 1 and max(sizes) <= 1024**2 and spark.read.parquet(str(tmp_path / "w")).count() == 3000


def test_grid(spark):
    d = spark.createDataFrame([("a", 5), ("bcd", None), ("e", 12345)], "name string, n int")
    assert report.grid(d, 2) == "name  n\n----  -\na     5\nbcd\n..."
    assert report.grid(d.orderBy("n")).splitlines()[2:] == ["bcd", "a         5", "e     12345"]


def test_tables_in_the_warehouse(spark):
    layout.create_table_as(spark.range(5).withColumn("p", F.col("id") % 2), "scratch_db.numbers", ("p",))
    layout.create_table_as(spark.range(3).withColumn("p", F.col("id") % 2), "scratch_db.numbers", ("p",))
    try:
        assert spark.sql("SELECT COUNT(*) FROM scratch_db.numbers WHERE p = 0").first()[0] == 2
        with pytest.raises(AnalysisException):
            layout.create_table_as(spark.range(1), "scratch_db.numbers", replace=False)
    finally:
        layout.drop_table(spark, "scratch_db.numbers")
        spark.sql("DROP DATABASE scratch_db CASCADE")
    layout.drop_table(spark, "numbers_that_never_were")


def test_overlap_json_arrays_and_required_settings(spark, tmp_path):
    from millrace.session import require

    d = "k int, v string, at int"
    target, late = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], d), spark.createDataFrame([(1, "A", 2), (2, "old", 4), (3, "c", 1)], d)
    assert rows(extract.with_overlap(target, late, ["k"], "at", "v")) == [(1, "A", 2), (2, "b", 5), (3, "c", 1)]
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert rows(files.read_json(spark, str(tmp_path / "a.json"), "x long", array=True)) == [(1,), (2,)]
    require({"a": 0, "b": "x"}, "a", "b")
    with pytest.raises(KeyError, match="b, c"):
        require({"a": 1, "b": ""}, "a", "b", "c")


def test_jdbc_in_parts(spark):
    url = "jdbc:derby:memory:millrace;create=true"
    spark.range(100).select("id", (F.col("id") * 2).alias("twice")).write.jdbc(url, "numbers", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = files.read_jdbc(spark, url, "numbers", "id", 0, 100, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("twice")).first()[0] == 9900


def test_events_say_where_a_run_stopped(spark, tmp_path):
    from millrace.control import ops

    store = ControlStore(spark, str(tmp_path / "control"))
    store.register([{"table_id": 1, "source_schema": "s", "source_table": "t", "in_scope": True, "load_type": "FULL_REFRESH"}])
    now = [datetime(2024, 5, 1)]

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    def killed(step, table):
        if step == "VERIFY":
            raise KeyboardInterrupt  # no handler of the run sees it, as with a killed process

    with pytest.raises(KeyboardInterrupt):
        extract.Runner(store, lambda n: spark.range(3), str(tmp_path / "out"), clock, fail=killed).run()
    last = ops.where_it_stopped(store, "s", "t").first()
    assert (last.step, last.kind) == ("VERIFY", "START") and store.read("files").count() == 0
    now[0] += timedelta(hours=7)  # the lock is stale
    assert extract.Runner(store, lambda n: spark.range(3), str(tmp_path / "out"), clock).run()["SUCCEEDED"] == 1
    kinds = [(r.step, r.kind) for r in ops.where_it_stopped(store, "s", "t").collect()][:16]
    assert kinds[::-1] == [(s, k) for s in ("SELECT", "LOCK", "SCHEMA", "BOUNDS", "EXTRACT", "VERIFY", "PUBLISH", "MARKER") for k in ("START", "END")]


def test_frequency_of_runs(spark, tmp_path):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.register([{"table_id": i, "source_schema": "s", "source_table": f"t{i}", "in_scope": True, "load_type": "FULL_REFRESH", "run_frequency": f} for i, f in enumerate(("ALWAYS", "HOURLY", "DAILY", "WEEKLY", "MONTHLY"), 1)])
    seen = []
    for at in (datetime(2024, 5, 1, 8), datetime(2024, 5, 1, 8, 30), datetime(2024, 5, 1, 9), datetime(2024, 5, 2), datetime(2024, 5, 6), datetime(2024, 6, 1)):
        seen.append(extract.Runner(store, lambda n: spark.range(1), str(tmp_path / "out"), lambda at=at: at, slots=1).run()["SUCCEEDED"])
    assert seen == [5, 1, 2, 3, 4, 5]  # May 6th begins a week and June 1st a month, in another week
    with pytest.raises(ConstraintError):
        store.register([{"table_id": 9, "source_schema": "s", "source_table": "x", "run_frequency": "SOMETIMES"}])


def test_smaller_chunks_after_a_resource_fault(spark, tmp_path):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.register([{"table_id": 1, "source_schema": "s", "source_table": "t", "in_scope": True, "change_date_column": "ts", "chunk_column": "id", "chunk_size": "64"}])
    data = spark.range(100).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"))
    now, stop = [datetime(2024, 5, 1)], {"after": None, "n": 0}

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    sizes = []

    def verify(step, table):
        if step == "VERIFY":
            written = max((p for p in (tmp_path / "out").rglob("chunk=*") if p.is_dir()), key=lambda p: p.stat().st_mtime_ns)
            n = spark.read.parquet(str(written)).count()
            sizes.append(n)
            if n > 20:
                raise MemoryError("too large")
            stop["n"] += 1
            if stop["n"] == stop["after"]:
                raise Broken("half way")

    run = lambda: extract.Runner(store, lambda n: data, str(tmp_path / "out"), clock, slots=1, fail=verify).run()
    stop["after"] = 3
    assert run()["FAILED"] == 1
    assert run()["SUCCEEDED"] == 1
    tasks = store.rows("tasks")
    done = [(int(t["window_from"]), int(t["window_to"])) for t in tasks if t["status"] == "PUBLISHED"]
    assert sorted(done) == [(0, 16), (16, 32), (32, 48), (48, 64), (64, 80), (80, 96), (96, 128)] or sum(b - a for a, b in done) == 128
    assert store.read("files").agg(F.sum("row_count")).first()[0] == 100 and sizes.count(64) == 1


def test_a_window_that_was_published_is_not_published_again(spark, tmp_path):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.register([{"table_id": 1, "source_schema": "s", "source_table": "t", "in_scope": True, "change_date_column": "ts", "run_frequency": "ALWAYS"}])
    n, now, broken = [10], [datetime(2024, 5, 1)], [None]

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    def hook(step, table):
        if step == broken[0]:
            raise Broken(step)

    data = lambda name: spark.range(n[0]).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"))
    run = lambda: extract.Runner(store, data, str(tmp_path / "out"), clock, slots=1, fail=hook).run()
    run()
    n[0], broken[0] = 15, "MARKER"
    assert run()["FAILED"] == 1
    n[0], broken[0] = 20, None
    assert run()["SUCCEEDED"] == 1
    assert store.read("files").agg(F.sum("row_count")).first()[0] == 20


def test_logs_constraints_and_compaction(spark, tmp_path):
    store = ControlStore(spark, str(tmp_path / "control"))
    store.register([{"table_id": 1, "source_schema": "s", "source_table": "t"}])
    at = datetime(2024, 5, 1, 1, 2, 3, 456789)
    store.add("runs", [{"batch_run_id": "r1", "start_at": at, "status": "RUNNING"}])
    event = {"event_id": "e1", "batch_run_id": "r1", "table_id": 1, "step": "LOCK", "kind": "START", "at": at}
    task = {"task_id": "t1", "batch_run_id": "r1", "table_id": 1, "attempt": 1, "status": "PUBLISHED", "start_at": at}
    for name, row in (("runs", {"batch_run_id": "r2", "start_at": at, "status": "LOST"}), ("runs", {"batch_run_id": None, "start_at": at, "status": "RUNNING"}), ("events", event | {"step": "NAP"}), ("events", event | {"kind": "MAYBE"}), ("events", event | {"table_id": 7}), ("events", event | {"batch_run_id": "r9"}), ("tasks", task | {"attempt": 0}), ("tasks", task | {"status": "DONE"}), ("tasks", task | {"files": [{"path": None, "row_count": 1}]})):
        with pytest.raises(ConstraintError):
            store.add(name, [row])
    store.add("events", [event])
    store.add("tasks", [task | {"published_at": at, "files": [{"path": "p", "row_count": 3, "byte_size": 9}]}])
    before = {k: store.rows(k) for k in ("config", "state", "runs", "tasks", "files", "events")}
    assert before["events"] == [event | {"message": None}] and before["files"] == [{"task_id": "t1", "table_id": 1, "path": "p", "row_count": 3, "byte_size": 9, "published_at": at}]
    for _ in range(3):
        for name in ("config", "state", "runs", "tasks", "events"):
            store.compact(name)
        assert {k: store.rows(k) for k in before} == before
    assert not list((tmp_path / "control" / "events" / "log").glob("*.json"))
    store.add("events", [event | {"event_id": "e2"}])
    assert store.read("events").count() == 2 and ControlStore(spark, str(tmp_path / "control")).state(1)["phase"] == "PENDING"
