"""Layouts, pruning and incremental ingestion; tables on the way lie in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.merge import SnapshotTable
from ..plans import inspect, pruning
from ..sources.files import read_catalogue, read_csv, read_json, read_partitioned
from ..streaming import evolution, ingest
from ..workspace import scratch
from .registry import Tables, query

DAY = "2024-01-05"
DAY_SQL = f"SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS dt FROM events WHERE CAST(ts AS DATE) = DATE '{DAY}'"


def _daily(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("dt"))


@query(DAY_SQL)
def partition_pruned_read(t: Tables) -> DataFrame:
    path = scratch(t.spark, "daily")
    layout.write_partitioned(_daily(t), path, "dt")
    return read_partitioned(t.spark, path).where(F.col("dt") == DAY)


@query(DAY_SQL)
def flat_read(t: Tables) -> DataFrame:
    path = scratch(t.spark, "flat")
    layout.write_flat(_daily(t), path)
    return t.spark.read.parquet(path).where(F.col("dt") == DAY)


@query()
def bytes_read_report(t: Tables) -> DataFrame:
    flat, parts = scratch(t.spark, "flat"), scratch(t.spark, "daily")
    layout.write_flat(_daily(t), flat)
    layout.write_partitioned(_daily(t), parts, "dt")
    found = pruning.bytes_by_layout(t.spark.read.parquet(flat), read_partitioned(t.spark, parts), "dt", DAY)
    filters = inspect.scan_filters(read_partitioned(t.spark, parts).where(F.col("dt") == DAY))
    return t.spark.createDataFrame([(k, v, filters["PartitionFilters"] if k == "partitioned" else "") for k, v in found.items()], "layout string, bytes long, partition_filters string")


def _two(t: Tables) -> dict[str, DataFrame]:
    scattered, sorted_ = scratch(t.spark, "scattered"), scratch(t.spark, "sorted")
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    orders.repartition(16, "o_orderkey").write.parquet(scattered)
    layout.write_clustered(orders, sorted_, "o_orderdate", 16)
    return {"scattered": t.spark.read.parquet(scattered), "clustered": t.spark.read.parquet(sorted_)}


@query()
def clustering_depth(t: Tables) -> DataFrame:
    rows = [(k, *pruning.clustering_depth(d, "o_orderdate").first()) for k, d in _two(t).items()]
    return t.spark.createDataFrame(rows, "layout string, n_files long, average_depth double")


@query()
def pruning_report(t: Tables) -> DataFrame:
    out = None
    for name, d in _two(t).items():
        for wrapped in (False, True):
            day = d.agg(F.min("o_orderdate")).first()[0]
            one = pruning.pruning_report(d, "o_orderdate", day, wrapped).withColumns({"layout": F.lit(name), "wrapped": F.lit(wrapped)})
            out = one if out is None else out.unionByName(one)
    return out


EVENT_SCHEMA = "event_id long, user_id long, event_type string"


@query("SELECT event_id, user_id, event_type FROM events")
def ingest_incremental(t: Tables) -> DataFrame:
    """Files that land in two rounds are each read once."""
    landing, target, checkpoint = (scratch(t.spark, n) for n in ("landing", "bronze", "checkpoint"))
    events = t.events.select("event_id", "user_id", "event_type")
    for k in (0, 1):
        events.where(F.col("event_id") % 2 == k).write.mode("append").json(landing)
        ingest.ingest(t.spark, landing, target, checkpoint, EVENT_SCHEMA)
    ingest.ingest(t.spark, landing, target, checkpoint, EVENT_SCHEMA)
    return t.spark.read.parquet(target)


@query("SELECT o_custkey, MAX(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def ingest_foreachbatch_upsert(t: Tables) -> DataFrame:
    """Each round's orders update their customer's row."""
    landing, checkpoint = scratch(t.spark, "landing"), scratch(t.spark, "checkpoint")
    table = SnapshotTable(t.spark, scratch(t.spark, "silver"))
    orders, middle = t.orders.select("o_custkey", "o_orderkey"), t.orders.agg(F.percentile("o_orderkey", 0.5)).first()[0]
    for part in (orders.where(F.col("o_orderkey") <= middle), orders.where(F.col("o_orderkey") > middle)):
        part.write.mode("append").json(landing)
        ingest.ingest_each(t.spark, landing, checkpoint, "o_custkey long, o_orderkey long", ingest.upsert_batches(table, ["o_custkey"], "o_orderkey", "o_orderkey"))
    return table.read()


@query("""SELECT o_orderkey AS sale_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS price, CASE o_orderkey % 3 WHEN 0 THEN concat('{"price":"n/a ', o_custkey, '","_file_path":""}') WHEN 1 THEN concat('{"Suburb":"', o_orderstatus, '","_file_path":""}') END AS _rescued_data FROM orders
UNION ALL SELECT NULL, NULL, concat('{"_line":"not json ', n_nationkey, '","_file_path":""}') FROM nation""")
def ingest_rescued(t: Tables) -> DataFrame:
    """A third of the lines hold a price that is no number, a third a field that is not in the schema; some are no JSON."""
    path = scratch(t.spark, "rescue")
    line = "concat('{\"sale_id\": ', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat(', \"price\": \"n/a ', o_custkey, '\"}') WHEN 1 THEN concat(', \"price\": ', o_custkey, ', \"Suburb\": \"', o_orderstatus, '\"}') ELSE concat(', \"price\": ', o_custkey, '}') END)"
    t.orders.selectExpr(f"{line} AS value").union(t.nation.selectExpr("concat('not json ', n_nationkey)")).write.text(path)
    schema = t.spark.createDataFrame([], "sale_id long, price long").schema
    found = evolution.rescued(t.spark.read.text(path).select("value", "_metadata"), schema)
    return found.withColumn(evolution.RESCUED, F.regexp_replace(evolution.RESCUED, r'"_file_path":"[^"]*"', '"_file_path":""'))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS record_count, 4 AS files, TRUE AS bytes_add_up, 'o_orderkey:bigint,o_custkey:bigint' AS columns FROM orders")
def export_manifest(t: Tables) -> DataFrame:
    """A run folder's manifest: rows by file, bytes by file and in all, and the schema."""
    path = scratch(t.spark, "export")
    layout.export(t.orders.select("o_orderkey", "o_custkey").repartition(4, "o_orderkey"), path)
    doc = layout.manifest_document(t.spark.read.parquet(path))
    elements = F.array_join(F.transform("schema.elements", lambda e: F.concat_ws(":", e["name"], e["type"])), ",")
    bytes_ = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["meta"]["content_length"])
    return doc.select(F.col("total").alias("record_count"), F.size("entries").alias("files"), (bytes_ == F.col("meta.content_length")).alias("bytes_add_up"), elements.alias("columns"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t: Tables) -> DataFrame:
    """Separated text written and read with the schema fixed up front."""
    path = scratch(t.spark, "csv")
    layout.write_csv(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, "\t")
    return read_csv(t.spark, path, t.nation.select("n_nationkey", "n_name", "n_regionkey").schema, sep="\t")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def catalogue_round_trip(t: Tables) -> DataFrame:
    """A separated list without a header, its comments and blank lines skipped."""
    path = scratch(t.spark, "list")
    layout.write_lines(t.nation.select("n_nationkey", "n_name"), path, "|")
    t.spark.createDataFrame([("# a comment",), ("",)], "value string").write.mode("append").text(path)
    return read_catalogue(t.spark, path, ["id", "name"]).drop("ordinal")


@query("SELECT r_regionkey, r_name FROM region")
def json_array_read(t: Tables) -> DataFrame:
    """A file that holds one JSON array."""
    path = scratch(t.spark, "array")
    rows = t.region.agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))  # five rows
    rows.coalesce(1).write.text(path)
    return read_json(t.spark, path, t.region.select("r_regionkey", "r_name").schema, array=True)
