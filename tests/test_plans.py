"""The shape of plans: what is pushed down, broadcast, and shuffled."""

import re

from pyspark.sql import functions as F

from quarryline.operators import aggregates, filters, joins
from quarryline.plans import star
from quarryline.plans.catalogue import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_query_uses_semi_joins_and_partial_sums(spark, sf):
    text = plan(star.q41(spark, sf))
    assert len(re.findall(r"BroadcastHashJoin[^\n]*LeftSemi", text)) == 2
    assert "partial_sum" in text and "EqualTo(n_regionkey,1)" in text and "CartesianProduct" not in text
    # The only exchanges that are no broadcast: the distinct dates and the groups.
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 3


def test_scan_reads_only_its_columns(spark, sf):
    text = plan(QUERIES["scan_columns"](spark, sf))
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["filter_conjunction"](spark, sf))
    assert "LessThan(l_quantity,40.0)" in text and "LessThan(l_linenumber" in text
    assert "Exchange" not in text


def test_large_sides_are_not_broadcast(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(100).withColumnRenamed("id", "k2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(joins.semi(a, b, "k", "k2"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compaction_spreads_its_sort(spark, sf):
    text = plan(QUERIES["compaction_position"](spark, sf))
    # The window over rows is partitioned; only the table of workers is in one task.
    assert re.search(r"row_number\(\) windowspecdefinition\(_w", text)


def test_no_python_in_the_catalogue(spark, sf):
    for name, f in QUERIES.items():
        assert not re.search("Python|Pandas|Arrow", plan(f(spark, sf))), name


def test_point_lookup_is_pushed_below_the_sum(spark, sf):
    text = plan(QUERIES["agg_point_lookup"](spark, sf))
    assert "EqualTo(l_suppkey,7)" in text


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k bigint, v bigint")
    assert aggregates.sum_by(none, ["k"], F.col("v"), "s").collect() == []
    assert [r.duplicates for r in aggregates.duplicate_count(none, "k").collect()] == [0]
    assert filters.exclusive_scan(filters.worker_counts(none, F.col("k"), F.col("v") > 0)).collect() == []
    assert joins.first_match(none, none.withColumnsRenamed({"k": "k2", "v": "v2"}), "k", "k2", "v2").collect() == []


def test_semi_joins_are_below_the_join_with_orders(spark, sf):
    """Broadcast or not, lines are cut down by supplier and part before they meet orders."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = star.star_join(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = tree.splitlines()
    semi = [depth(x) for x in lines if "LeftSemi" in x]
    orders = next(depth(x) for x in lines if "Join Inner, (l_orderkey" in x or "= o_orderkey" in x)
    assert len(semi) == 2 and min(semi) > orders
