"""The Spark session that tests and the benchmark use.

A cluster brings its own session; nothing here overrides what it has set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with adaptive execution on and UTC as its time zone."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": "quarryline",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    return SparkSession.builder.config(map=conf).getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which executors share; a temporary one on a local session without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quarryline-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
