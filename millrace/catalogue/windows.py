"""Window queries: latest rows, ranks, frames and post-window filters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import windows as w
from ..operators.joins import guarded_join
from .registry import Tables, query


def _money() -> Column:
    return F.col("o_totalprice").cast("decimal(18,2)")


@query("""
SELECT o_custkey, c_name, n_name, r_name, o_orderkey, o_orderdate, o_totalprice FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1""")
def latest_order_per_customer(t: Tables) -> DataFrame:
    latest = w.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey")
    places = guarded_join(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    people = guarded_join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), places, ["c_nationkey"])
    return latest.join(people, "o_custkey").select("o_custkey", "c_name", "n_name", "r_name", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1")
def latest_event_per_user(t: Tables) -> DataFrame:
    return w.latest_per_key(t.events, ["user_id"], "ts", "event_id")


@query("""
SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER s AS row_number, RANK() OVER d AS rank, DENSE_RANK() OVER d AS dense_rank FROM orders
WINDOW d AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST), s AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)""")
def dedup_rank_comparison(t: Tables) -> DataFrame:
    by_date = [F.col("o_orderdate").desc_nulls_last()]
    ranks = w.rank_family(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], by_date)
    return ranks.withColumn("row_number", F.row_number().over(w.frame(["o_custkey"], [*by_date, F.col("o_orderkey").desc()])).cast("long")).drop("o_orderdate")


@query("""
SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER s AS row_number, RANK() OVER s AS rank, DENSE_RANK() OVER s AS dense_rank FROM orders
WINDOW s AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)""")
def rank_converges_with_tiebreak(t: Tables) -> DataFrame:
    return w.rank_family(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top3_orders_per_customer(t: Tables) -> DataFrame:
    return w.top_n(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= 3")
def top3_distinct_price_bands(t: Tables) -> DataFrame:
    return w.top_n(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], F.col("p_size").desc(), 3, distinct_values=True)


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
QUALIFY CAST(c_acctbal AS DECIMAL(18,2)) > AVG(CAST(c_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY c_mktsegment)""")
def above_segment_average(t: Tables) -> DataFrame:
    return w.above_group_average(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], F.col("c_acctbal").cast("decimal(18,2)"))


@query("""
SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS customer_total,
g.total AS group_total FROM orders JOIN (SELECT o_custkey AS k, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) g ON g.k = o_custkey""")
def group_total_vs_partition_total(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", _money().alias("price"))
    groups = orders.groupBy("o_custkey").agg(F.sum("price").cast("double").alias("group_total"))
    windowed = orders.withColumn("customer_total", F.sum("price").over(w.frame(["o_custkey"])).cast("double"))
    return windowed.join(groups, "o_custkey").select("o_orderkey", "o_custkey", "customer_total", "group_total")


def _running(kind: str, t: Tables) -> DataFrame:
    order = "o_orderdate" if kind != "rows" else [F.col("o_orderdate"), F.col("o_orderkey")]
    return t.orders.select("o_orderkey", "o_custkey", F.sum(_money()).over(w.frame(["o_custkey"], order, kind)).cast("double").alias("total"))


@query("SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DOUBLE) AS total FROM orders")
def running_total_default_frame(t: Tables) -> DataFrame:
    return _running("default", t)


@query("""SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total FROM orders""")
def running_total_rows_frame(t: Tables) -> DataFrame:
    return _running("rows", t)


@query("""SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) AS total FROM orders""")
def whole_partition_frame_ordered(t: Tables) -> DataFrame:
    return _running("whole", t)


@query("""SELECT o_orderkey, LAG(o_orderkey) OVER s AS previous_order, LEAD(o_orderkey) OVER s AS next_order FROM orders
WINDOW s AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead_order_gap(t: Tables) -> DataFrame:
    over = w.frame(["o_custkey"], ["o_orderdate", "o_orderkey"])
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(over).alias("previous_order"), F.lead("o_orderkey").over(over).alias("next_order"))


@query("""SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER s AS first_order, LAST_VALUE(o_orderkey) OVER s AS last_order, NTH_VALUE(o_orderkey, 2) OVER s AS second_order FROM orders
WINDOW s AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_last_nth_explicit_frame(t: Tables) -> DataFrame:
    over = w.frame(["o_custkey"], ["o_orderdate", "o_orderkey"]).rowsBetween(-(2**63), 2**63 - 1)
    return t.orders.select("o_orderkey", F.first_value("o_orderkey").over(over).alias("first_order"), F.last_value("o_orderkey").over(over).alias("last_order"), F.nth_value("o_orderkey", 2).over(over).alias("second_order"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def derived_table_filter(t: Tables) -> DataFrame:
    return t.views("orders").sql("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")


@query("""SELECT o_orderstatus, COUNT(*) AS n, CAST(ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS DOUBLE) AS pct FROM orders GROUP BY o_orderstatus""")
def share_of_total(t: Tables) -> DataFrame:
    return w.share_of_total(t.orders, ["o_orderstatus"])


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM d)
SELECT event_type, MAX(CASE WHEN rn = 1 THEN n END) AS latest, AVG(CASE WHEN rn BETWEEN 2 AND 8 THEN n END) AS prior_avg FROM r GROUP BY event_type
HAVING MAX(CASE WHEN rn = 1 THEN n END) < 1.2 * NULLIF(AVG(CASE WHEN rn BETWEEN 2 AND 8 THEN n END), 0)""")
def having_anomaly(t: Tables) -> DataFrame:
    from ..operators.aggregates import latest_against_history

    daily = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return latest_against_history(daily, ["event_type"], F.col("day").desc(), "n", below=1.2)


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def ext_tumbling_events(t: Tables) -> DataFrame:
    # An extension: the event-time window is not among the reproduced behaviours.
    grouped = t.events.groupBy("event_type", F.window(F.col("ts"), "1 day").alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, MIN(ts) AS opened, COUNT(*) AS n FROM s GROUP BY user_id, no""")
def ext_session_events(t: Tables) -> DataFrame:
    # An extension, as above.
    grouped = t.events.groupBy("user_id", F.session_window(F.col("ts"), "6 hours").alias("w"))
    return grouped.agg(F.min("ts").alias("opened"), F.count("*").alias("n")).select("user_id", "opened", "n")
