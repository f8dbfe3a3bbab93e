"""Benchmark reports as CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.schema import REPORT


def read_report(spark: SparkSession, path: str, schema: T.StructType = REPORT) -> DataFrame:
    """A CSV read by a stated schema: no pass to infer types.  Lines that repeat the header are none of its rows."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    lines = spark.read.text(path).where(F.col("value") != ",".join(schema.names))
    return lines.select(F.from_csv("value", ddl).alias("r")).select("r.*")


def append_report(df: DataFrame, path: str) -> None:
    """Appends rows.  A header comes before the first rows of a new report, and never again."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.text(path)
    df.select(F.to_csv(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)
