"""Join queries: strategies, salting, anti-joins and lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as j
from ..plans import inspect
from .registry import Tables, query

#: Four of five orders belong to customer 1.
SKEW = "CAST(CASE WHEN o_orderkey % 5 < 4 THEN 1 ELSE o_custkey END AS BIGINT)"
SKEW_SQL = f"(SELECT o_orderkey, {SKEW} AS c_custkey FROM orders)"
SKEW_JOIN = f"SELECT o_orderkey, c_custkey, c_mktsegment FROM {SKEW_SQL} JOIN customer USING (c_custkey)"
PART_JOIN = "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey"


def _skewed(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.orders.select("o_orderkey", F.expr(SKEW).alias("c_custkey")), t.customer.select("c_custkey", "c_mktsegment")


def _above(t: Tables) -> int:
    return max(1, t.orders.count() // 20)


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'homes' WHEN 'MACHINERY' THEN 'tools' ELSE '' END AS line FROM customer""")
def lookup_left_join_default(t: Tables) -> DataFrame:
    lines = t.spark.createDataFrame([("BUILDING", "homes"), ("MACHINERY", "tools")], "c_mktsegment string, line string")
    return j.lookup(t.customer.select("c_custkey", "c_mktsegment"), lines, ["c_mktsegment"], {"line": ""}).select("c_custkey", "line")


@query(PART_JOIN)
def join_broadcast(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    parts = t.part.select(F.col("p_partkey").alias("k"), "p_brand")
    return j.guarded_join(lines, parts, ["k"]).select("l_orderkey", "l_linenumber", F.col("k").alias("l_partkey"), "p_brand")


@query(PART_JOIN)
def join_sort_merge(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    parts = t.part.select(F.col("p_partkey").alias("k"), "p_brand")
    return lines.join(parts.hint("merge"), "k").select("l_orderkey", "l_linenumber", F.col("k").alias("l_partkey"), "p_brand")


@query("""SELECT l_orderkey, l_suppkey, n FROM (SELECT l_orderkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') USING (l_orderkey, l_suppkey)""")
def join_using_two_keys(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_suppkey"]
    counts = t.lineitem.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(t.lineitem.where("l_returnflag = 'R'").select(*keys).distinct(), keys)


@query("SELECT o_orderkey, o_orderpriority FROM orders JOIN (SELECT DISTINCT o_orderpriority FROM orders) USING (o_orderpriority)")
def join_self_dimension(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderpriority")
    return o.join(o.select("o_orderpriority").distinct(), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query(f"SELECT c_custkey, COUNT(*) AS n FROM {SKEW_SQL} GROUP BY 1 HAVING COUNT(*) > (SELECT greatest(1, COUNT(*) // 20) FROM orders)")
def skewed_keys(t: Tables) -> DataFrame:
    return j.hot_keys(_skewed(t)[0], "c_custkey", _above(t)).withColumnRenamed("count", "n")


@query(SKEW_JOIN)
def join_salted(t: Tables) -> DataFrame:
    return j.salted_join(*_skewed(t), "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")


@query(SKEW_JOIN)
def join_salted_conditional(t: Tables) -> DataFrame:
    return j.conditional_salted_join(*_skewed(t), "c_custkey", _above(t)).select("o_orderkey", "c_custkey", "c_mktsegment")


@query(f"SELECT (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {SKEW_SQL} GROUP BY c_custkey)) AS plain, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {SKEW_SQL} GROUP BY c_custkey, o_orderkey % 16)) AS salted")
def salted_task_load(t: Tables) -> DataFrame:
    orders = _skewed(t)[0].withColumn("salt", F.col("o_orderkey") % 16)
    loads = orders.groupBy("c_custkey", "salt").count()
    by_key = loads.groupBy("c_custkey").agg(F.sum("count").alias("n"), F.max("count").alias("m"))
    return by_key.agg(F.max("n").alias("plain"), F.max("m").alias("salted"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def anti_join_not_in(t: Tables) -> DataFrame:
    return j.not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.where(F.col("o_totalprice") > 150000).select("o_custkey"))


#: Keys with nulls on either side.
NULLED = "(SELECT o_orderkey, NULLIF(o_custkey % 50, 7) AS k FROM orders)"


@query(f"""SELECT 'null on the left' AS keys, COUNT(*) AS n FROM {NULLED} WHERE k NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'null in the list', COUNT(*) FROM {NULLED} WHERE k NOT IN (SELECT NULLIF(n_nationkey, 3) FROM nation) UNION ALL SELECT 'empty list', COUNT(*) FROM {NULLED} WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)""")
def anti_join_null_aware(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("k"))
    nations = t.nation.select(F.col("n_nationkey").cast("long").alias("k"))
    lists = {"null on the left": nations, "null in the list": nations.select(F.nullif("k", F.lit(3)).alias("k")), "empty list": nations.where("k < 0")}
    out = None
    for name, keys in lists.items():
        one = j.not_in(rows, "k", keys).agg(F.count("*").alias("n")).select(F.lit(name).alias("keys"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT COUNT(*) = 0 AS same, (SELECT COUNT(*) = 0 FROM ((SELECT o_custkey FROM orders) EXCEPT ALL (SELECT DISTINCT o_custkey FROM orders))) AS same_without_repeats
FROM ((SELECT o_custkey FROM orders) EXCEPT ALL (SELECT o_custkey FROM orders ORDER BY o_orderkey DESC))""")
def same_rows_of_two_results(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey")
    shuffled = t.orders.orderBy(F.desc("o_orderkey")).select("o_custkey")
    return t.spark.createDataFrame([(j.same_rows(o, shuffled), j.same_rows(o, o.distinct()))], "same boolean, same_without_repeats boolean")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT MAX(o_orderdate) FROM orders)")
def scalar_subquery_max(t: Tables) -> DataFrame:
    return t.views("orders").sql("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT MAX(o_orderdate) FROM orders)")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def vanished_keys(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return j.vanished(t.customer.select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("SELECT c_mktsegment, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_membership(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_mktsegment", "c_custkey").join(keys, "c_custkey", "left_semi")


@query()
def join_plan_report(t: Tables) -> DataFrame:
    lines, parts = t.lineitem.withColumnRenamed("l_partkey", "p_partkey"), t.part
    rows = [(k, inspect.shuffles(d), inspect.broadcasts(d), ", ".join(inspect.joins_and_exchanges(d))) for k, d in (("merge", lines.join(parts.hint("merge"), "p_partkey")), ("broadcast", j.guarded_join(lines, parts, ["p_partkey"])))]
    return t.spark.createDataFrame(rows, "strategy string, shuffles int, broadcasts int, nodes string")


@query("""SELECT * FROM (VALUES ('filter', 'narrow', 0), ('select', 'narrow', 0), ('withColumn', 'narrow', 0), ('union', 'narrow', 0), ('coalesce', 'narrow', 0), ('groupBy', 'wide', 1), ('distinct', 'wide', 1),
('orderBy', 'wide', 1), ('join', 'wide', 2), ('repartition', 'wide', 1)) v(operation, kind, shuffles)""")
def narrow_wide_report(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    cases = {
        "filter": o.where(F.col("o_totalprice") > 100), "select": o.select("o_orderkey"), "withColumn": o.withColumn("gst", F.col("o_totalprice") * 0.1),
        "union": o.union(o), "coalesce": o.coalesce(2), "groupBy": o.groupBy("o_orderpriority").count(), "distinct": o.select("o_orderpriority").distinct(),
        "orderBy": o.orderBy("o_totalprice"), "join": o.join(o.select("o_orderpriority").distinct().hint("merge"), "o_orderpriority"), "repartition": o.repartition(8),
    }
    return t.spark.createDataFrame(inspect.classify(cases), "operation string, kind string, shuffles int")
