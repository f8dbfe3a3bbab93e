"""Means, minima and distinct values of benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import bytes_parse


def mean_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean by keys; groups with a null key or a null mean go."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name)).dropna()


def best_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The smallest value by keys; groups with a null key go."""
    return df.groupBy(*keys).agg(F.min(value).alias(name)).dropna(subset=keys)


def order_labels(df: DataFrame, column: str) -> DataFrame:
    """Labels with their position: byte labels by their size, others after them by text.

    The window has one partition: its input is the distinct labels of a report.
    """
    order = Window.orderBy(F.asc_nulls_last(bytes_parse(F.col(column))), F.col(column))
    return df.withColumn("position", F.row_number().over(order).cast("bigint"))


def order_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """An aggregated report's rows with their position by key; one partition, for a row a key."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
