"""Bag concatenation and parameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession


def concatenate(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; repeats stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parameter_grid(spark: SparkSession, **lists: list) -> DataFrame:
    """Every combination of literal lists, which the caller bounds."""
    return spark.createDataFrame([tuple(x) for x in product(*lists.values())], list(lists))
