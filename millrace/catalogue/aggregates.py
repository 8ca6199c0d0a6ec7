"""Filters, projections, aggregations, sorting and set operations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..sources import generators
from .registry import Tables, query


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


@query("SELECT o_orderkey, o_totalprice, o_totalprice * 0.1 AS gst FROM orders WHERE o_totalprice > 100000")
def filter_project_high_value(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 0.1).alias("gst"))


@query("SELECT l_linestatus, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS returned FROM lineitem GROUP BY 1")
def conditional_sum_by_flag(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.sum(F.when(F.col("l_returnflag") == "R", money("l_extendedprice"))).cast("double").alias("returned"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def group_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY ALL")
def group_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(money("l_extendedprice")).cast("double").alias("price"))


@query("SELECT COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n, COUNT(*) AS total FROM orders")
def filtered_count(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_totalprice") > 100000).alias("n"), F.count("*").alias("total"))


@query("""SELECT o_orderpriority, CAST(ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 2) AS DOUBLE) AS mean, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most
FROM orders GROUP BY 1""")
def avg_min_max(t: Tables) -> DataFrame:
    mean = F.round(F.sum(money("o_totalprice")).cast("double") / F.count("*"), 2)
    return t.orders.groupBy("o_orderpriority").agg(mean.alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment").distinct()


@query("SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_count(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT o_custkey, MIN(o_orderkey) AS first_seen FROM orders GROUP BY 1 ORDER BY 2")
def first_seen_customers(t: Tables) -> DataFrame:
    return a.first_seen(t.orders, ["o_custkey"], "o_orderkey").orderBy("first_seen")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def whole_row_dedup(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'high' ELSE 'low' END AS band FROM orders")
def value_band(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") >= 100000, "high").otherwise("low").alias("band"))


@query("""SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size BETWEEN 5 AND 30 AND p_name IS NOT NULL AND p_type NOT IN ('none')""")
def isin_between_null_filters(t: Tables) -> DataFrame:
    p = t.part.where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & F.col("p_size").between(5, 30) & F.col("p_name").isNotNull() & ~F.col("p_type").isin("none"))
    return p.select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def union_all(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus")
    f = o.where("o_orderstatus = 'F'")
    return f.union(o.where("o_orderstatus <> 'F'")).union(f)


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem")
def union_by_name(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_orderkey AS k", "o_orderstatus AS s").unionByName(t.lineitem.selectExpr("l_linestatus AS s", "l_orderkey AS k"))


@query("WITH c AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, MAX(n) AS busiest FROM c GROUP BY 1")
def cte_two_level_agg(t: Tables) -> DataFrame:
    return t.views("orders").sql("WITH c AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, MAX(n) AS busiest FROM c GROUP BY 1")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def topk_limit_nulls_last(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(50)


@query("SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2")
def order_by_alias_and_ordinal(t: Tables) -> DataFrame:
    return t.views("orders").sql("SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2")


@query("""SELECT COUNT(*) AS n_rows, substr(md5(string_agg(line, chr(10) ORDER BY line)), 1, 12) AS digest FROM
(SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation)""")
def table_fingerprint(t: Tables) -> DataFrame:
    return a.fingerprint(t.nation, ordered=True)


@query("""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT o_orderdate) AS n_values, MIN(o_orderdate) AS oldest, MAX(o_orderdate) AS newest, COUNT(*) FILTER (WHERE o_orderdate IS NULL) AS n_null,
(SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderdate)) / COUNT(*) AS top_share FROM orders""")
def change_date_profile(t: Tables) -> DataFrame:
    return a.change_date_profile(t.orders, "o_orderdate")


@query("""WITH g AS (SELECT i, ['US', 'UK', 'IN', 'AU', 'DE'][i % 5 + 1] AS country, i * 37 % 1000 + 1 AS amount, i * 13 % 200 AS score FROM range(1, 100001) t(i))
SELECT country, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS total, COUNT(*) FILTER (WHERE score > 100) AS above, MIN(amount) AS least, MAX(amount) AS most FROM g GROUP BY 1""")
def generated_orders_summary(t: Tables) -> DataFrame:
    g = generators.sample_orders(t.spark).groupBy("country")
    return g.agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.count_if(F.col("score") > 100).alias("above"), F.min("amount").alias("least"), F.max("amount").alias("most"))


@query("SELECT r_name, x AS step, r_regionkey * 10 + x AS code FROM region, unnest(range(0, 4)) u(x)")
def explode_sequence(t: Tables) -> DataFrame:
    return t.region.select("r_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("step"), "r_regionkey").select("r_name", "step", (F.col("r_regionkey") * 10 + F.col("step")).alias("code"))


@query("SELECT l_shipdate, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-02-01' GROUP BY 1")
def half_open_window(t: Tables) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    part = t.lineitem.where((F.col("l_shipdate") > day("1996-01-01")) & (F.col("l_shipdate") <= day("1996-02-01")))
    return part.groupBy("l_shipdate").agg(F.sum(money("l_quantity")).cast("double").alias("quantity"))


@query("SELECT o_orderstatus, o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WHERE o_totalprice > 50000")
def window_after_where(t: Tables) -> DataFrame:
    kept = t.orders.where(F.col("o_totalprice") > 50000)
    return kept.select("o_orderstatus", "o_orderkey", F.count("*").over(Window.partitionBy("o_orderstatus")).alias("n"))
