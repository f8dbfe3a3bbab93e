"""Sums by key in one or two stated phases, counts, duplicates and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import hash_int32, partition_of


def sum_by(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """SUM by one or more keys; Spark adds up partially before it shuffles."""
    return df.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(name))


def partial_sums(df: DataFrame, worker: Column, key: str, value: Column) -> DataFrame:
    """Sums of each worker and key: a stated first phase, which also splits a hot key."""
    return df.groupBy(worker.alias("worker"), key).agg(F.sum(value).cast("bigint").alias("partial"))


def merge_sums(partials: DataFrame, key: str, name: str) -> DataFrame:
    """The second phase: partial sums of a key become one."""
    return partials.groupBy(key).agg(F.sum("partial").cast("bigint").alias(name))


def lookup(groups: DataFrame, **key: object) -> DataFrame:
    """One group; the predicate moves below the aggregation to the scan."""
    for c, v in key.items():
        groups = groups.where(F.col(c) == v)
    return groups


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows less distinct values."""
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - F.when(F.col(column).isNull(), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicate_rows(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Every repeat of a value after its first row in the given order."""
    return df.withColumn("repeat", F.row_number().over(Window.partitionBy(column).orderBy(*order)).cast("bigint")).where("repeat > 1")


def partition_histogram(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys in each of the 64 hash partitions."""
    return df.select(key).distinct().groupBy(partition_of(hash_int32(F.col(key))).alias("part")).agg(F.count("*").alias("keys"))


def bucket_counts(df: DataFrame, key: str, mask: int) -> DataFrame:
    """Rows chained in each bucket of a join table."""
    return df.groupBy(hash_int32(F.col(key)).bitwiseAND(mask).alias("bucket")).agg(F.count("*").alias("chain"))
