"""Panels drawn from the star-schema tables: targets from orders, external series from lineitem.

Amounts are summed as DECIMAL so that totals do not depend on the order of addition.
Only the needed columns are selected, which prunes the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def segment_sales(spark: SparkSession, sf_dir: str, freq: str = "m") -> DataFrame:
    """Order value per customer segment and bucket."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ds = cal.bucket(F.col("o_orderdate").cast("date"), freq)
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_mktsegment").alias("id"), ds.alias("ds"))
        .agg(exact_sum("o_totalprice").alias("y"))
    )


def customer_sales(spark: SparkSession, sf_dir: str, freq: str = "m") -> DataFrame:
    """Order value per customer and bucket: a wide, sparse panel."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    ds = cal.bucket(F.col("o_orderdate").cast("date"), freq)
    return o.groupBy(F.col("o_custkey").cast("string").alias("id"), ds.alias("ds")).agg(
        exact_sum("o_totalprice").alias("y")
    )


def brand_quantity(spark: SparkSession, sf_dir: str, freq: str = "m") -> DataFrame:
    """Shipped quantity per brand and bucket: the external series."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ds = cal.bucket(F.col("l_shipdate").cast("date"), freq)
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .groupBy(F.col("p_brand").alias("id"), ds.alias("ds"))
        .agg(exact_sum("l_quantity").alias("x"))
    )


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value per type: a short history."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return e.groupBy(F.col("event_type").alias("id"), F.col("ts").cast("date").alias("ds")).agg(
        exact_sum("value").alias("y")
    )
