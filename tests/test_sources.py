"""Round trips through the sources and sinks, and the streaming sum."""

import pytest
from pyspark.sql import functions as F

from quarryline.schema import REPORT
from quarryline.sources import append_report, read_raw_columns, read_report, uniform_columns, write_raw_columns
from quarryline.streaming import streaming_sum


def test_raw_columns_round_trip(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id", "cast(id * 7 % 1009 - 500 as int) as lo_revenue", "cast(-id as int) as lo_supplycost").repartition(5)
    assert write_raw_columns(rows, str(tmp_path), "id", ["lo_revenue", "lo_supplycost"]) == 10_000
    got = read_raw_columns(spark, str(tmp_path), ["lo_revenue", "lo_supplycost"], rows_per_split=777)
    assert got.rdd.getNumPartitions() == 13
    assert got.exceptAll(rows.drop("id")).count() == 0 and rows.drop("id").exceptAll(got).count() == 0
    one = read_raw_columns(spark, str(tmp_path), ["lo_supplycost"])
    assert one.columns == ["lo_supplycost"] and one.agg(F.min("lo_supplycost")).first()[0] == -9999


def test_missing_and_uneven_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_raw_columns(spark, str(tmp_path), ["d_year"])
    (tmp_path / "DDATE0").write_bytes(b"\0" * 8)
    (tmp_path / "DDATE4").write_bytes(b"\0" * 12)
    with pytest.raises(Exception, match="different numbers of rows"):
        read_raw_columns(spark, str(tmp_path), ["d_datekey", "d_year"]).count()


def test_reports_are_appended(spark, tmp_path):
    row = spark.createDataFrame([("WarpLevel", 1, 1024, 4000, 8, 64, 1.5, 0)], REPORT)
    for _ in range(3):
        append_report(row, str(tmp_path / "r"))
    assert read_report(spark, str(tmp_path / "r")).collect() == row.collect() * 3


def test_synthetic_columns_repeat_at_any_parallelism(spark):
    a, b = uniform_columns(spark, 5000, 3), uniform_columns(spark, 5000, 3).repartition(3)
    assert a.exceptAll(b).count() == 0
    low, high, same = a.agg(F.min("c0"), F.max("c0"), F.sum((F.col("c0") != F.col("c2")).cast("int"))).first()
    assert 0 <= low < 100 and 9900 < high < 10_000 and same == 0


def test_streaming_sum_equals_batch(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 7 as k", "id as v")
    rows.where("v < 400").write.parquet(str(tmp_path / "in"))
    rows.where("v >= 400").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k bigint, v bigint").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    query = streaming_sum(stream, ["k"], F.col("v"), "s").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = {r.k: r.s for r in rows.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    assert {r.k: r.s for r in spark.table("sums").collect()} == want


def test_streaming_windows_close(spark, tmp_path):
    rows = spark.range(100).selectExpr("timestamp_seconds(id * 60) as ts", "1 as v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v int").parquet(str(tmp_path / "in"))
    sums = streaming_sum(stream, [F.window("ts", "10 minutes").alias("w")], F.col("v"), "s", "ts", "1 minute")
    query = sums.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows").collect()
    assert got and all(r.s == 10 for r in got)


def test_a_report_has_one_header(spark, tmp_path):
    row = spark.createDataFrame([("WarpLevel", 1, 1024, 4000, 8, 64, 1.5, 0)], REPORT)
    for _ in range(2):
        append_report(row.repartition(3), str(tmp_path / "r"))
    lines = [x for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()]
    assert sum(x.startswith("Kernel type") for x in lines) == 1 and len(lines) == 3
