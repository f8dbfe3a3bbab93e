"""Equi-joins of a fact table with filtered dimensions.

No side is forced to be broadcast: Spark broadcasts a side whose size is under
``spark.sql.autoBroadcastJoinThreshold``, before the run by its statistics and
during it by what the shuffle measured, and sorts and merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str) -> DataFrame:
    """Rows of the fact that have a match; the dimension adds no columns."""
    return fact.join(dimension.select(F.col(dimension_key).alias(fact_key)), fact_key, "left_semi")


def unique_build(build: DataFrame, key: str, payload: str) -> DataFrame:
    """One row a key: the smallest payload, where a probe would take any first match."""
    return build.groupBy(key).agg(F.min(payload).alias(payload))


def first_match(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, payload: str) -> DataFrame:
    """Each probe row once, with the smallest payload of its key; unmatched rows go."""
    side = unique_build(build, build_key, payload)
    return probe.join(side.withColumnRenamed(build_key, probe_key), probe_key)
