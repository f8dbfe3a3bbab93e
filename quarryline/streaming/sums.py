"""The two-phase sum kept up to date over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_sum(stream: DataFrame, keys: list[str], value: Column, name: str, event_time: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """SUM by keys of a stream.

    Without ``event_time`` the state holds one row a key and results come in
    complete or update mode.  With it, ``keys`` should include a window of that
    column; the watermark then lets Spark drop the state of closed windows.
    """
    stream = stream.withWatermark(event_time, lateness) if event_time else stream
    return stream.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(name))
