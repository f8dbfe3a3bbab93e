"""Operators on literal rows: duplicates, collisions, extremes, nulls."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import bytes_humanize, bytes_parse, combine_hashes, hash_int32, next_pow2, profit, round_up, table_size
from quarryline.operators import aggregates, joins, report, sets
from quarryline.schema import column_file, rows_at


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def mix32(key):
    """The finalising mix in plain integers, shifts keeping the sign."""

    def signed(v):
        return v - (1 << 32) if v >= 1 << 31 else v

    x = key & 0xFFFFFFFF
    x = (x ^ (signed(x) >> 16)) & 0xFFFFFFFF
    x = x * 0x85EBCA6B & 0xFFFFFFFF
    x = (x ^ (signed(x) >> 13)) & 0xFFFFFFFF
    x = x * 0xC2B2AE35 & 0xFFFFFFFF
    return (x ^ (signed(x) >> 16)) & 0xFFFFFFFF


def test_hashes_equal_a_plain_version(spark):
    keys = [0, 1, -1, 7, -7, 2**31 - 1, -(2**31), 123456789, -987654321, *range(-300, 300, 7)]
    rows = spark.createDataFrame([(k,) for k in keys], "k int").select("k", hash_int32(F.col("k")).alias("h"), combine_hashes(hash_int32(F.col("k")), hash_int32(F.lit(5))).alias("c")).collect()
    for r in rows:
        a, b = mix32(r.k), mix32(5)
        assert r.h == a and r.c == (a ^ (b + 0x9E3779B9 + (a << 6) + (a >> 2))) & 0xFFFFFFFF


def test_first_match_takes_the_smallest_payload(spark):
    build = spark.createDataFrame([(1, 9), (1, 3), (2, 5), (None, 1)], "k int, p int")
    probe = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "key int, x string")
    assert sorted((r.key, r.x, r.p) for r in joins.first_match(probe, build, "key", "k", "p").collect()) == [(1, "a", 3), (1, "b", 3)]


def test_semi_join_counts_each_probe_row_once(spark):
    """Duplicate build keys: a key's sum is count times key, not count squared."""
    t = spark.createDataFrame([(k,) for k in (1, 1, 1, 2, 2, 9)], "k bigint")
    kept = t.where("k < 8")
    got = aggregates.sum_by(joins.semi(kept, kept.withColumnRenamed("k", "b"), "k", "b"), ["k"], F.col("k"), "s")
    assert {r.k: r.s for r in got.collect()} == {1: 3, 2: 4}


def test_groups_that_share_a_hash_partition_stay_apart(spark):
    keys = [k for k in range(40_000) if mix32(k) & 63 == 5]
    t = spark.createDataFrame([(k,) for k in keys * 3], "k bigint")
    two = aggregates.merge_sums(aggregates.partial_sums(t, F.pmod("k", F.lit(7)), "k", F.col("k")), "k", "s")
    assert {r.k: r.s for r in two.collect()} == {k: 3 * k for k in keys}
    assert [(r.part, r["keys"]) for r in aggregates.partition_histogram(t, "k").collect()] == [(5, len(keys))]


def test_extremes_are_widened(spark):
    assert one(spark, profit(F.lit(-(2**31)).cast("int"), F.lit(2**31 - 1).cast("int"))) == -(2**32) + 1


@pytest.mark.parametrize(("value", "text"), [(0, "0 B"), (999, "999 B"), (1000, "1 KB"), (2500, "2 KB"), (3500, "4 KB"), (400_000_000, "400 MB"), (7 * 10**9, "7 GB"), (10**12, None)])
def test_bytes(spark, value, text):
    assert one(spark, bytes_humanize(F.lit(value))) == text
    if text:
        n, unit = text.split()
        assert one(spark, bytes_parse(F.lit(text))) == int(n) * 1000 ** ["B", "KB", "MB", "GB"].index(unit)


def test_sizes(spark):
    for n, power in ((0, 0), (1, 1), (2, 2), (3, 4), (1 << 40, 1 << 40), ((1 << 40) + 1, 1 << 41)):
        assert one(spark, next_pow2(F.lit(n))) == power
    assert [one(spark, table_size(F.lit(n))) for n in (0, 1, 4, 7)] == [1, 1, 8, 8]
    assert [one(spark, round_up(F.lit(n))) for n in (0, 1, 32, 33)] == [0, 32, 32, 64]


def test_reports_drop_null_keys(spark):
    t = spark.createDataFrame([("a", 1, 4.0), ("a", 1, 2.0), ("a", None, 1.0), (None, 2, 1.0), ("b", 1, None)], "k string, x int, t double")
    assert [tuple(r) for r in report.mean_by(t, ["k", "x"], "t", "m").collect()] == [("a", 1, 3.0)]
    assert sorted(map(tuple, report.best_by(t, ["k", "x"], "t", "m").collect()), key=repr) == [("a", 1, 2.0), ("b", 1, None)]


def test_duplicates(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (1, 4), (None, 5), (None, 6)], "x int, i int")
    assert aggregates.duplicate_count(t, "x").first().duplicates == 6 - 2
    assert sorted((r.i, r.repeat) for r in aggregates.duplicate_rows(t.where("x = 1"), "x", ["i"]).collect()) == [(2, 2), (4, 3)]


def test_bags_and_grids(spark):
    t = spark.createDataFrame([(1,), (1,)], "x int")
    assert sets.concatenate(t, t, t).count() == 6
    assert sets.parameter_grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_schema_lookups():
    assert column_file("lo_revenue") == "LINEORDER12" and column_file("d_year") == "DDATE4"
    with pytest.raises(ValueError, match="x_none"):
        column_file("x_none")
    with pytest.raises(ValueError, match="7"):
        rows_at(7)
