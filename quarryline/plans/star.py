"""A star schema of integers derived from the test tables, and its flagship query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import profit
from quarryline.operators import aggregates, joins
from quarryline.sources import table

# The region code and manufacturer codes that the flagship query asks for.
REGION, MANUFACTURERS = 1, (0, 1)


def _yyyymmdd(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def lineorder(spark: SparkSession, sf_dir: str, suppliers: DataFrame | None = None, parts: DataFrame | None = None, customers: DataFrame | None = None) -> DataFrame:
    """A row for each order line; money in whole cents.

    Suppliers (``s_suppkey``) and parts (``p_partkey``) keep only the lines that match, before lines meet orders;
    customers (``c_custkey`` and more) join orders before those meet the lines, and their other columns are added.
    """
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    order = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    item = table(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    if suppliers is not None:
        line = joins.semi(line, suppliers, "l_suppkey", "s_suppkey")
    if parts is not None:
        line = joins.semi(line, parts, "l_partkey", "p_partkey")
    added = []
    if customers is not None:
        order = order.join(customers.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
        added = [c for c in customers.columns if c != "c_custkey"]
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(item, line.l_partkey == item.p_partkey)
    return joined.select(
        _yyyymmdd(F.col("o_orderdate")).alias("lo_orderdate"),
        F.col("o_custkey").alias("lo_custkey"),
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        F.floor(F.round(F.col("l_extendedprice") * 100) * (100 - F.round(F.col("l_discount") * 100)) / 100).cast("bigint").alias("lo_revenue"),
        F.floor(F.round(F.col("p_retailprice") * 100) * 6 / 10).cast("bigint").alias("lo_supplycost"),
        *added,
    )


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_regionkey").alias("s_region"), F.col("s_nationkey").alias("s_nation"))


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_regionkey").alias("c_region"), F.col("c_nationkey").alias("c_nation"))


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five brands make a manufacturer."""
    return table(spark, sf_dir, "part", "p_partkey", "p_brand").select("p_partkey", F.floor((F.substring("p_brand", 7, 10).cast("int") - 1) / 5).cast("int").alias("p_mfgr"))


def date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = table(spark, sf_dir, "orders", "o_orderdate").select(_yyyymmdd(F.col("o_orderdate")).alias("d_datekey"), F.year("o_orderdate").alias("d_year"))
    return day.distinct()


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that match all four dimensions.

    Supplier and part only decide whether a line stays: semi-joins on the fact, below its join with orders.
    The customer adds its nation to the orders that it filters.  A line's day is one of the date dimension,
    which holds all order days, so its year is taken from the day itself.
    """
    suppliers = supplier(spark, sf_dir).where(F.col("s_region") == REGION)
    parts = part(spark, sf_dir).where(F.col("p_mfgr").isin(*MANUFACTURERS))
    customers = customer(spark, sf_dir).where(F.col("c_region") == REGION).select("c_custkey", "c_nation")
    return lineorder(spark, sf_dir, suppliers, parts, customers).withColumn("d_year", F.floor(F.col("lo_orderdate") / 10000).cast("int"))


def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit by year and nation of the customer."""
    return aggregates.sum_by(star_join(spark, sf_dir), ["d_year", "c_nation"], profit(F.col("lo_revenue"), F.col("lo_supplycost")), "profit")
