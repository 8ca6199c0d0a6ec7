"""Generated relations: pure functions of a row index.

Fixed values: the column names, formulas, keys and counts of ``fact_and_dimension``,
``skewed_orders``, ``daily_events`` and ``sample_orders`` are those of FIXTURES.md,
part B, as the golden figures of the tests depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, n: int, start: int = 0, parts: int | None = None) -> DataFrame:
    return spark.range(start, start + n, numPartitions=parts) if parts else spark.range(start, start + n)


def fact_and_dimension(spark: SparkSession, n: int, keys: int) -> tuple[DataFrame, DataFrame]:
    fact = rows(spark, n).select(F.col("id").alias("order_id"), (F.col("id") % keys).alias("dim_id"))
    dim = rows(spark, keys).select(F.col("id").alias("dim_id"), F.concat(F.lit("region_"), F.col("id").cast("string")).alias("region"))
    return fact, dim


def skewed_orders(spark: SparkSession, n: int, hot_share: float = 0.8, customers: int = 4000, hot: str = "ACME_CORP") -> tuple[DataFrame, DataFrame]:
    """Orders of which ``hot_share`` belong to one customer, and the customers."""
    cut = int(n * hot_share)
    other = F.concat(F.lit("cust_"), F.lpad(((F.col("id") - cut) % customers + 1).cast("string"), 5, "0"))
    orders = rows(spark, n).select(F.col("id").alias("order_id"), F.when(F.col("id") < cut, hot).otherwise(other).alias("customer_id"), (F.col("id") % 500 + 1).alias("amount"))
    people = orders.select("customer_id").distinct().withColumn("segment", F.when(F.col("customer_id") == hot, "WHOLESALE").otherwise("RETAIL"))
    return orders, people


def daily_events(spark: SparkSession, n: int, days: int = 10, first: str = "2024-01-01") -> DataFrame:
    day = F.date_format(F.date_add(F.lit(first).cast("date"), (F.col("id") % days).cast("int")), "yyyy-MM-dd")
    return rows(spark, n).select("id", day.alias("dt"), F.concat(F.lit("r"), (F.col("id") % 4).cast("string")).alias("region"), (F.col("id") * 7 % 1000).cast("double").alias("amount"))


def sample_orders(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """Orders with a date, country, customer, product, amount and score, all from the index 1..n."""
    i = F.col("id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    return rows(spark, n, 1).select(
        i.cast("int").alias("order_id"), F.format_string("2024-%02d-%02d", i % 12 + 1, i % 28 + 1).alias("order_date"), pick(["US", "UK", "IN", "AU", "DE"]).alias("country"),
        F.format_string("cust_%04d", i % 500 + 1).alias("customer_id"), pick(["widget", "gadget", "gizmo", "doohickey"]).alias("product"),
        (i * 37 % 1000 + 1).alias("amount"), (i * 13 % 200).alias("score"),
    )
