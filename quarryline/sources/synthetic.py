"""Deterministic integers for benchmarks: the same rows at any parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_columns(spark: SparkSession, rows: int, columns: int = 1, bound: int = 10_000, seed: int = 10) -> DataFrame:
    """``c0 .. c{k-1}``: uniform in [0, bound); every column repeats c0."""
    value = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bound)).cast("int")
    return spark.range(rows).select("id", value.alias("c0")).select("id", *[F.col("c0").alias(f"c{i}") for i in range(columns)])


def random_between(lower: int, upper: int, seed: int | None = None):
    """A uniform integer in [lower, upper) for each row."""
    return (F.floor(F.rand(seed) * (upper - lower)) + lower).cast("bigint")
