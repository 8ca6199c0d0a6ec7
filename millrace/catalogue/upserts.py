"""Upsert queries; the SQL is a full outer join, as plain tables have no MERGE."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import duplicated_keys, merge
from .registry import Tables, query

#: A delta: changed balances, nulls, and new customers.
DELTA_SQL = """(SELECT c_custkey, c_name, CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 11 = 0)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changed = target.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 21 == 0, None).otherwise(F.col("c_acctbal") + 1))
    return target, changed.unionByName(target.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


def merged(where: str = "TRUE", delta: str = DELTA_SQL) -> str:
    return f"""SELECT COALESCE(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name,
CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal FROM customer t FULL OUTER JOIN {delta} s ON t.c_custkey = s.c_custkey WHERE {where}"""


@query(merged())
def merge_upsert(t: Tables) -> DataFrame:
    return merge(*_sides(t), ["c_custkey"])


@query(merged())
def merge_twice(t: Tables) -> DataFrame:
    target, delta = _sides(t)
    return merge(merge(target, delta, ["c_custkey"]), delta, ["c_custkey"])


@query(merged("NOT (t.c_custkey IS NOT NULL AND s.c_custkey IS NOT NULL AND COALESCE(s.c_acctbal < 0, FALSE))"))
def merge_delete(t: Tables) -> DataFrame:
    return merge(*_sides(t), ["c_custkey"], delete_when=F.col("c_acctbal") < 0)


@query(merged("s.c_custkey IS NOT NULL"))
def merge_not_matched_by_source(t: Tables) -> DataFrame:
    return merge(*_sides(t), ["c_custkey"], not_matched_by_source="delete")


@query(merged("TRUE", """(SELECT c_custkey, c_name, c_acctbal + v AS c_acctbal FROM customer, (VALUES (1), (2)) x(v) WHERE c_custkey % 5 = 0 AND v = 2)"""))
def merge_after_dedup(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    twice = target.where("c_custkey % 5 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("c_acctbal", F.col("c_acctbal") + F.col("v"))
    return merge(target, twice, ["c_custkey"], dedupe_by=("v", "c_name"))


@query(merged("TRUE", "(SELECT c_custkey, c_name, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 5 = 0 AND c_acctbal > 0)"))
def merge_matched_condition(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    source = target.where("c_custkey % 5 = 0").withColumn("ok", F.col("c_acctbal") > 0).withColumn("c_acctbal", F.col("c_acctbal") * 2)
    return merge(target, source, ["c_custkey"], matched=F.col("ok"))


@query("""SELECT t.c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE 'gone' END AS c_name, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE 0.0 END AS c_acctbal
FROM customer t LEFT JOIN (SELECT c_custkey, concat(c_name, '!') AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0) s ON t.c_custkey = s.c_custkey""")
def merge_update_not_matched_by_source(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    source = target.where("c_custkey % 5 = 0").withColumn("c_name", F.concat("c_name", F.lit("!")))
    return merge(target, source, ["c_custkey"], not_matched_by_source={"c_name": F.lit("gone"), "c_acctbal": F.lit(0.0)})


@query("SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicated_merge_keys(t: Tables) -> DataFrame:
    """Keys that an upsert would find twice."""
    return duplicated_keys(t.lineitem.select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])
