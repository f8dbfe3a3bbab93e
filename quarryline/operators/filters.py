"""Scans with predicates, and the deterministic order of a two-pass compaction."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def less_than(df: DataFrame, columns: list[str], bound: float) -> DataFrame:
    """Rows whose named columns are all below the bound."""
    return df.where(reduce(and_, [F.col(c) < bound for c in columns]))


def equal_to(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows that equal every entry; no entries keep all rows."""
    return df.where(reduce(and_, [F.col(c) == v for c, v in wanted.items()], F.lit(True)))


def one_of(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def key_value(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"))


def worker_counts(df: DataFrame, worker: Column, predicate: Column) -> DataFrame:
    """First pass of a compaction: survivors of each worker, zero included."""
    return df.groupBy(worker.alias("worker")).agg(F.count_if(predicate).alias("cnt"))


def exclusive_scan(counts: DataFrame) -> DataFrame:
    """Exclusive prefix sums over workers.

    The window has one partition, so its input must be aggregated: one row a
    worker, not one a row of the table.
    """
    before = Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("worker", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).cast("bigint").alias("excl"))


def compaction_position(df: DataFrame, worker: Column, order: Column, predicate: Column) -> DataFrame:
    """Where each survivor lands: its worker's offset plus its rank there.

    Ranks are taken inside a worker, so the sort is spread over workers; only
    the table of offsets, a row a worker, passes through one task.
    """
    offsets = exclusive_scan(worker_counts(df, worker, predicate)).select(F.col("worker").alias("_w"), "excl")
    ranked = df.where(predicate).withColumn("_w", worker).withColumn("_r", F.row_number().over(Window.partitionBy("_w").orderBy(order)) - 1)
    return ranked.join(offsets, "_w").withColumn("position", (F.col("excl") + F.col("_r")).cast("bigint")).withColumnRenamed("_w", "worker").drop("_r", "excl")


def group_rank(df: DataFrame, row_id: Column, predicate: Column, width: int = 32) -> DataFrame:
    """Rank of each survivor among the survivors of its run of ``width`` ids."""
    run = F.floor(row_id / width)
    return df.where(predicate).withColumn("lane_rank", (F.row_number().over(Window.partitionBy(run).orderBy(row_id)) - 1).cast("bigint"))
