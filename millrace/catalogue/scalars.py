"""Scalar functions by family."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables, query


@query("""SELECT p_partkey, p_brand || '/' || p_type AS joined, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, printf('%04d', p_size) AS printed, split_part(p_type, ' ', 1) AS first_word,
substr(p_name, 1, 5) AS head, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, replace(p_type, ' ', '_') AS replaced, regexp_extract(p_brand, '#(\\d+)', 1) AS captured,
lower(trim(p_name)) AS normal, p_name ILIKE '%PART%' AS liked, 's3://' || 'bucket' || '/' || p_partkey AS path FROM part""")
def scalar_string(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return t.part.select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.lpad(key, 8, "0").alias("padded"), F.format_string("%04d", "p_size").alias("printed"),
        F.split("p_type", " ")[0].alias("first_word"), F.substring("p_name", 1, 5).alias("head"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
        F.replace(F.col("p_type"), F.lit(" "), F.lit("_")).alias("replaced"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("captured"), F.lower(F.trim("p_name")).alias("normal"),
        F.col("p_name").ilike("%PART%").alias("liked"), F.format_string("s3://%s/%s", F.lit("bucket"), key).alias("path"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS week_on, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderdate - INTERVAL 6 HOURS AS earlier,
strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""")
def scalar_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_add(d.cast("date"), 7).alias("week_on"), F.date_format(d, "yyyy-MM-dd").alias("day"), F.year(d).cast("long").alias("y"), (d - F.expr("INTERVAL '6' HOUR")).alias("earlier"),
        F.date_format(d, "yyyyMMdd_HHmmss").alias("run_id"), F.trunc(d.cast("date"), "month").alias("month"),
    )


@query("""SELECT o_orderkey, o_orderkey % 7 AS remainder, ((o_custkey - 500) % 7 + 7) % 7 AS positive, abs(o_custkey - 500) AS distance, o_orderkey // 3 AS thirds, ROUND(o_totalprice / 1024.0, 1) AS rounded FROM orders""")
def scalar_math(t: Tables) -> DataFrame:
    away = F.col("o_custkey") - 500
    return t.orders.select("o_orderkey", (F.col("o_orderkey") % 7).alias("remainder"), F.pmod(away, F.lit(7)).alias("positive"), F.abs(away).alias("distance"), F.expr("o_orderkey div 3").alias("thirds"), F.round(F.col("o_totalprice") / 1024.0, 1).alias("rounded"))


@query("SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256, substr(md5(c_name), 1, 12) AS short FROM customer")
def scalar_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("md5"), F.sha1(F.col("c_name").cast("binary")).alias("sha1"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha256"), F.substring(F.md5(F.col("c_name").cast("binary")), 1, 12).alias("short"))


@query("""SELECT c_custkey, NULLIF(c_nationkey, 0) AS nation, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '-') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS band,
TRY_CAST(c_name AS INTEGER) AS dirty FROM customer""")
def scalar_null(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("nation"), F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("-")).alias("segment"),
        F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") > 5000, "rich").otherwise("plain").alias("band"), F.col("c_name").try_cast("int").alias("dirty"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_value(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_path_value(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
