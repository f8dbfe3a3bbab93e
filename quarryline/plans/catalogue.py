"""Every registered query, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import bytes_humanize, bytes_parse, column_file_name, combine_hashes, hash_int32, next_pow2, partition_of, profit, round_up, slot_of, table_size
from quarryline.operators import aggregates, filters, joins, report, sets
from quarryline.plans import star
from quarryline.schema import rows_at
from quarryline.session import scratch_folder
from quarryline.sources import append_report, read_raw_columns, read_report, table, uniform_columns, write_raw_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DAY = "cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int)"
LINEORDER_SQL = f"""select {_DAY} as lo_orderdate, o_custkey as lo_custkey, l_partkey as lo_partkey, l_suppkey as lo_suppkey,
  cast(floor(round(l_extendedprice * 100) * (100 - round(l_discount * 100)) / 100) as bigint) as lo_revenue,
  cast(floor(round(p_retailprice * 100) * 6 / 10) as bigint) as lo_supplycost
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""
SUPPLIER_SQL = "select s_suppkey, n_regionkey as s_region, s_nationkey as s_nation from supplier join nation on s_nationkey = n_nationkey"
CUSTOMER_SQL = "select c_custkey, n_regionkey as c_region, c_nationkey as c_nation from customer join nation on c_nationkey = n_nationkey"
PART_SQL = "select p_partkey, cast(floor((cast(substring(p_brand, 7) as int) - 1) / 5) as int) as p_mfgr from part"
DATE_SQL = f"select distinct {_DAY} as d_datekey, cast(year(o_orderdate) as int) as d_year from orders"
STAR_SQL = f"""with lo as ({LINEORDER_SQL}), s as ({SUPPLIER_SQL}), c as ({CUSTOMER_SQL}), p as ({PART_SQL}), d as ({DATE_SQL}),
j as (select lo.*, c_nation, d_year from lo join s on lo_suppkey = s_suppkey join c on lo_custkey = c_custkey join p on lo_partkey = p_partkey join d on lo_orderdate = d_datekey
  where s_region = 1 and c_region = 1 and p_mfgr in (0, 1))"""


def _hash_sql(x: str) -> str:
    """The finalising mix as one scalar expression of nested selects."""
    signed = "(case when {v} >= 2147483648 then {v} - 4294967296 else {v} end)"
    step = "(select xor({v}, (({s}) >> {n}) & 4294967295) & 4294967295 from (select {e} as {v}))"
    a = step.format(v="h1", s=signed.format(v="h1"), n=16, e=f"(cast({x} as bigint) & 4294967295)")
    b = step.format(v="h2", s=signed.format(v="h2"), n=13, e=f"cast((cast({a} as hugeint) * 2246822507) % 4294967296 as bigint)")
    return step.format(v="h3", s=signed.format(v="h3"), n=16, e=f"cast((cast({b} as hugeint) * 3266489909) % 4294967296 as bigint)")


def query(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


# Star query


@query("ssb_q41", f"{STAR_SQL} select d_year, c_nation, cast(sum(lo_revenue - lo_supplycost) as bigint) as profit from j group by d_year, c_nation")
def _(spark, d):
    return star.q41(spark, d)


@query("star_join_rows", f"{STAR_SQL} select lo_orderdate, lo_custkey, lo_partkey, lo_suppkey, c_nation, d_year, lo_revenue - lo_supplycost as profit from j")
def _(spark, d):
    return star.star_join(spark, d).select("lo_orderdate", "lo_custkey", "lo_partkey", "lo_suppkey", "c_nation", "d_year", profit(F.col("lo_revenue"), F.col("lo_supplycost")).alias("profit"))


@query("expr_profit", f"with lo as ({LINEORDER_SQL}) select lo_partkey, lo_revenue - lo_supplycost as profit from lo")
def _(spark, d):
    return star.lineorder(spark, d).select("lo_partkey", profit(F.col("lo_revenue"), F.col("lo_supplycost")).alias("profit"))


# Scans, projections, filters


@query("scan_columns", "select p_partkey, p_size from part")
def _(spark, d):
    return table(spark, d, "part", "p_partkey", "p_size")


@query("project_key_value", "select c_custkey as key, cast(c_nationkey as bigint) as value from customer")
def _(spark, d):
    return filters.key_value(table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey").cast("bigint"))


@query("filter_lt", "select l_orderkey, l_quantity from lineitem where l_quantity < 40")
def _(spark, d):
    return filters.less_than(table(spark, d, "lineitem"), ["l_quantity"], 40).select("l_orderkey", "l_quantity")


@query("filter_conjunction", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 40 and l_linenumber < 6 and round(l_discount * 100) < 8")
def _(spark, d):
    return table(spark, d, "lineitem").where((F.col("l_quantity") < 40) & (F.col("l_linenumber") < 6) & (F.round(F.col("l_discount") * 100) < 8)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_eq", f"select * from ({SUPPLIER_SQL}) where s_region = 1")
def _(spark, d):
    return filters.equal_to(star.supplier(spark, d), {"s_region": 1})


@query("filter_in", f"select * from ({PART_SQL}) where p_mfgr in (0, 1)")
def _(spark, d):
    return filters.one_of(star.part(spark, d), "p_mfgr", [0, 1])


@query("count_filtered", "select count(*) filter (where l_quantity < 40) as n from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem", "l_quantity").agg(F.count_if(F.col("l_quantity") < 40).alias("n"))


# Compaction and prefix sums

WORKERS_SQL = "select event_id % 64 as worker, count(*) filter (where value < 80) as cnt from events group by 1"
SCAN_SQL = f"select worker, cnt, cast(coalesce(sum(cnt) over (order by worker rows between unbounded preceding and 1 preceding), 0) as bigint) as excl from ({WORKERS_SQL})"


def _worker():
    return F.pmod(F.col("event_id"), F.lit(64).cast("bigint"))


@query("worker_counts", WORKERS_SQL)
def _(spark, d):
    return filters.worker_counts(table(spark, d, "events", "event_id", "value"), _worker(), F.col("value") < 80)


@query("exclusive_scan", SCAN_SQL)
def _(spark, d):
    return filters.exclusive_scan(filters.worker_counts(table(spark, d, "events", "event_id", "value"), _worker(), F.col("value") < 80))


@query("exclusive_scan_total", f"select cast(max(excl + cnt) as bigint) as total from ({SCAN_SQL})")
def _(spark, d):
    counts = filters.worker_counts(table(spark, d, "events", "event_id", "value"), _worker(), F.col("value") < 80)
    return filters.exclusive_scan(counts).agg(F.max(F.col("excl") + F.col("cnt")).alias("total"))


@query("compaction_position", "select event_id, worker, row_number() over (order by worker, event_id) - 1 as position from (select event_id, event_id % 64 as worker from events where value < 80)")
def _(spark, d):
    return filters.compaction_position(table(spark, d, "events", "event_id", "value"), _worker(), F.col("event_id"), F.col("value") < 80).select("event_id", "worker", "position")


@query("warp_rank", "select event_id, row_number() over (partition by event_id // 32 order by event_id) - 1 as lane_rank from events where value < 80")
def _(spark, d):
    return filters.group_rank(table(spark, d, "events", "event_id", "value"), F.col("event_id"), F.col("value") < 80).select("event_id", "lane_rank")


# Joins


@query("join_semi", f"with lo as ({LINEORDER_SQL}), s as ({SUPPLIER_SQL}) select lo_orderdate, lo_custkey, lo_partkey, lo_suppkey, lo_revenue, lo_supplycost from lo where lo_suppkey in (select s_suppkey from s where s_region = 1)")
def _(spark, d):
    lines = star.lineorder(spark, d, suppliers=star.supplier(spark, d).where("s_region = 1"))
    return lines.select("lo_orderdate", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_revenue", "lo_supplycost")


@query("join_first_match", "select c_custkey, c_nationkey, o_orderkey from customer join (select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1) on c_custkey = o_custkey")
def _(spark, d):
    return joins.first_match(table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "orders", "o_custkey", "o_orderkey"), "c_custkey", "o_custkey", "o_orderkey")


# Aggregations


@query("agg_sum_single", "select l_partkey, cast(sum(l_partkey) as bigint) as total from lineitem where l_quantity < 40 and l_partkey in (select l_partkey from lineitem where l_quantity < 40) group by 1")
def _(spark, d):
    kept = filters.less_than(table(spark, d, "lineitem", "l_partkey", "l_quantity"), ["l_quantity"], 40).select("l_partkey")
    return aggregates.sum_by(joins.semi(kept, kept.distinct(), "l_partkey", "l_partkey"), ["l_partkey"], F.col("l_partkey"), "total")


@query("agg_sum_composite", f"with lo as ({LINEORDER_SQL}) select lo_suppkey, lo_orderdate // 10000 as lo_year, cast(sum(lo_revenue - lo_supplycost) as bigint) as profit from lo group by 1, 2")
def _(spark, d):
    lines = star.lineorder(spark, d).withColumn("lo_year", F.floor(F.col("lo_orderdate") / 10000).cast("int"))
    return aggregates.sum_by(lines, ["lo_suppkey", "lo_year"], profit(F.col("lo_revenue"), F.col("lo_supplycost")), "profit")


@query("agg_partial_final", "select user_id, cast(sum(event_id) as bigint) as total from events group by 1")
def _(spark, d):
    return aggregates.merge_sums(aggregates.partial_sums(table(spark, d, "events", "event_id", "user_id"), _worker(), "user_id", F.col("event_id")), "user_id", "total")


@query("agg_point_lookup", f"with lo as ({LINEORDER_SQL}) select lo_suppkey, cast(sum(lo_revenue) as bigint) as revenue from lo where lo_suppkey = 7 group by 1")
def _(spark, d):
    return aggregates.lookup(aggregates.sum_by(star.lineorder(spark, d), ["lo_suppkey"], F.col("lo_revenue"), "revenue"), lo_suppkey=7)


@query("duplicate_count", "select cast(count(*) - count(distinct l_partkey) as bigint) as duplicates from lineitem")
def _(spark, d):
    return aggregates.duplicate_count(table(spark, d, "lineitem", "l_partkey"), "l_partkey")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("duplicate_rows", f"select l_partkey, l_orderkey, repeat from (select *, row_number() over (partition by l_partkey order by {', '.join(_LINE_ORDER)}) as repeat from lineitem) where repeat > 1")
def _(spark, d):
    return aggregates.duplicate_rows(table(spark, d, "lineitem"), "l_partkey", _LINE_ORDER).select("l_partkey", "l_orderkey", "repeat")


@query("hash_partition_histogram", f"select ({_hash_sql('p_partkey')}) & 63 as part, count(*) as keys from (select distinct p_partkey from part) group by 1")
def _(spark, d):
    return aggregates.partition_histogram(table(spark, d, "part", "p_partkey"), "p_partkey")


@query("hash_bucket_counts", f"select ({_hash_sql('o_custkey')}) & 1023 as bucket, count(*) as chain from orders group by 1")
def _(spark, d):
    return aggregates.bucket_counts(table(spark, d, "orders", "o_custkey"), "o_custkey", 1023)


# Scalar expressions


@query("hash_int32", f"select p_partkey, {_hash_sql('p_partkey')} as h, {_hash_sql('-p_partkey')} as h_neg from part")
def _(spark, d):
    return table(spark, d, "part", "p_partkey").select("p_partkey", hash_int32(F.col("p_partkey")).alias("h"), hash_int32(-F.col("p_partkey")).alias("h_neg"))


@query("combine_hashes", f"select p_partkey, xor(a, (b + 2654435769 + (a << 6) + (a >> 2)) & 4294967295) & 4294967295 as h from (select p_partkey, {_hash_sql('p_partkey')} as a, {_hash_sql('p_size')} as b from part)")
def _(spark, d):
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", combine_hashes(hash_int32(F.col("p_partkey")), hash_int32(F.col("p_size"))).alias("h"))


@query("hash_slots", f"select p_partkey, h & 63 as part, (h >> 6) & 1023 as slot from (select p_partkey, {_hash_sql('p_partkey')} as h from part)")
def _(spark, d):
    h = hash_int32(F.col("p_partkey"))
    return table(spark, d, "part", "p_partkey").select("p_partkey", partition_of(h).alias("part"), slot_of(h, 1023).alias("slot"))


@query("next_pow2", "select p_partkey, cast(pow(2, ceil(log2(p_partkey))) as bigint) as pow2, cast(greatest(pow(2, ceil(log2(greatest((p_partkey * 5) >> 2, 1)))), 1) as bigint) as slots from part where p_partkey > 0")
def _(spark, d):
    return table(spark, d, "part", "p_partkey").where("p_partkey > 0").select("p_partkey", next_pow2(F.col("p_partkey")).alias("pow2"), table_size(F.col("p_partkey")).alias("slots"))


@query("round_up_32", "select p_partkey, ((p_partkey + 31) // 32) * 32 as rounded from part")
def _(spark, d):
    return table(spark, d, "part", "p_partkey").select("p_partkey", round_up(F.col("p_partkey")).alias("rounded"))


# Bags and grids


@query("union_all", "select l_orderkey, l_quantity from lineitem where l_quantity < 10 union all select l_orderkey, l_quantity from lineitem where l_quantity < 20")
def _(spark, d):
    line = table(spark, d, "lineitem", "l_orderkey", "l_quantity")
    return sets.concatenate(line.where("l_quantity < 10"), line.where("l_quantity < 20"))


# The parameter lists of the filter sweep.
GRID = {"allocator": ["ON", "OFF"], "init": [1024], "cols": [1, 2, 5], "num_rows": [1000, 10000, 1000000, 10000000, 100000000], "blocks": [1, 8, 32, 128], "threads": [64, 128, 256]}


@query("param_grid", "select * from " + " cross join ".join(f"(select unnest({v!r}{'' if k == 'allocator' else '::bigint[]'}) as {k})" for k, v in GRID.items()))
def _(spark, d):
    return sets.parameter_grid(spark, **GRID)


# Reports over a frame shaped like a benchmark's CSV, derived from events

REPORT_SQL = """select event_type as kernel, user_id % 3 as cols, (user_id % 4) * 64 as threads,
  cast(power(10, event_id % 9) as bigint) * (event_id % 7 + 1) as bytes, cast(round(value * 100) as bigint) as time from events"""
HUMAN_SQL = "case when {b} < 1000 then cast(cast(round_even({b}, 0) as bigint) as varchar) || ' B' when {b} / 1e3 < 1000 then cast(cast(round_even({b} / 1e3, 0) as bigint) as varchar) || ' KB' when {b} / 1e6 < 1000 then cast(cast(round_even({b} / 1e6, 0) as bigint) as varchar) || ' MB' when {b} / 1e9 < 1000 then cast(cast(round_even({b} / 1e9, 0) as bigint) as varchar) || ' GB' end"
PARSE_SQL = "cast(split_part({t}, ' ', 1) as bigint) * case split_part({t}, ' ', 2) when 'B' then 1 when 'KB' then 1000 when 'MB' then 1000000 when 'GB' then 1000000000 end"


def _report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    return e.select(
        F.col("event_type").alias("kernel"),
        (F.col("user_id") % 3).alias("cols"),
        ((F.col("user_id") % 4) * 64).alias("threads"),
        (F.pow(F.lit(10.0), F.col("event_id") % 9).cast("bigint") * (F.col("event_id") % 7 + 1)).alias("bytes"),
        F.round(F.col("value") * 100).cast("bigint").alias("time"),
    )


@query("bytes_humanize", f"select bytes, {HUMAN_SQL.format(b='bytes')} as human from ({REPORT_SQL})")
def _(spark, d):
    return _report(spark, d).select("bytes", bytes_humanize(F.col("bytes")).alias("human"))


@query("bytes_parse", f"select human, {PARSE_SQL.format(t='human')} as parsed from (select {HUMAN_SQL.format(b='bytes')} as human from ({REPORT_SQL}))")
def _(spark, d):
    return _report(spark, d).select(bytes_humanize(F.col("bytes")).alias("human")).select("human", bytes_parse(F.col("human")).alias("parsed"))


@query("report_mean", f"select kernel, cols, threads, cast(floor(avg(time)) as bigint) as mean_time from ({REPORT_SQL}) where kernel = 'click' group by all")
def _(spark, d):
    kept = filters.equal_to(_report(spark, d), {"kernel": "click"})
    return report.mean_by(kept, ["kernel", "cols", "threads"], "time", "mean_time").withColumn("mean_time", F.floor("mean_time").cast("bigint"))


@query("report_best", f"select cols, threads, min(time) as best_time from ({REPORT_SQL}) group by all")
def _(spark, d):
    return report.best_by(_report(spark, d), ["cols", "threads"], "time", "best_time")


@query("distinct_values", f"select distinct threads from ({REPORT_SQL})")
def _(spark, d):
    return report.distinct_values(_report(spark, d), "threads")


@query("csv_roundtrip", f"select kernel, cols, threads, bytes, time from ({REPORT_SQL})")
def _(spark, d):
    from pyspark.sql.types import StructType

    frame = _report(spark, d)
    text = frame.select(F.to_csv(F.struct(*frame.columns)).alias("line"))
    schema = StructType([f for f in frame.schema.fields])
    return text.select(F.from_csv("line", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("r")).select("r.*")


@query("csv_report_file", f"select kernel, cols, threads, bytes, time from ({REPORT_SQL})")
def _(spark, d):
    """Through files: two appends to one folder, the header before the first rows only."""
    frame, path = _report(spark, d), scratch_folder(spark, "report")
    first = F.col("cols") == 0
    append_report(frame.where(first), path)
    append_report(frame.where(~first), path)
    return read_report(spark, path, frame.schema)


@query("raw_column_files", "select cast(p_partkey as int) as p_partkey, p_size from part")
def _(spark, d):
    """Through raw files, one a column, written in the order of the key; a load by the raw reader makes them a Parquet table."""
    path = scratch_folder(spark, "raw").removeprefix("file://")
    write_raw_columns(table(spark, d, "part", "p_partkey", "p_size").withColumn("p_partkey", F.col("p_partkey").cast("int")), path, "p_partkey", ["p_partkey", "p_size"])
    loaded = scratch_folder(spark, "loaded")
    read_raw_columns(spark, path, ["p_partkey", "p_size"]).write.parquet(loaded)
    return spark.read.parquet(loaded)


@query("label_order", f"""select label, row_number() over (order by size) as position
  from (select human as label, min({PARSE_SQL.format(t='human')}) as size from (select {HUMAN_SQL.format(b='bytes')} as human from ({REPORT_SQL})) group by human)""")
def _(spark, d):
    labels = report.distinct_values(_report(spark, d).select(bytes_humanize(F.col("bytes")).alias("label")), "label")
    return report.order_labels(labels, "label")


@query("report_key_order", f"select *, row_number() over (order by cols, threads) as position from (select cols, threads, min(time) as best_time from ({REPORT_SQL}) group by all)")
def _(spark, d):
    return report.order_keys(report.best_by(_report(spark, d), ["cols", "threads"], "time", "best_time"), ["cols", "threads"])


@query("synthetic_columns", "select cast(100000 as bigint) as n, cast(100000 as bigint) as repeated, true as in_range, true as spread")
def _(spark, d):
    """Uniform integers below 10000 in columns that repeat the first."""
    c = uniform_columns(spark, 100_000, 3)
    near = lambda share: F.abs(F.avg((F.col("c0") < int(10_000 * share)).cast("double")) - share) < 0.01
    return c.agg(F.count("*").alias("n"), F.count_if((F.col("c0") == F.col("c1")) & (F.col("c0") == F.col("c2"))).alias("repeated"), ((F.min("c0") >= 0) & (F.max("c0") < 10_000)).alias("in_range"), (near(0.2) & near(0.8)).alias("spread"))


_ROWS_SQL = " union all ".join(f"select {f} as scale_factor, '{t}' as star_table, cast({n} as bigint) as n_rows" for f in (1, 10) for t, n in rows_at(f).items())


@query("scale_factor_rows", _ROWS_SQL)
def _(spark, d):
    return spark.createDataFrame([(f, t, n) for f in (1, 10) for t, n in rows_at(f).items()], "scale_factor int, star_table string, n_rows bigint")


_FILES_SQL = "select c as column_name, case c when 'lo_revenue' then 'LINEORDER12' when 'd_year' then 'DDATE4' when 's_region' then 'SUPPLIER5' when 'p_mfgr' then 'PART2' when 'c_nation' then 'CUSTOMER4' when 'c_none' then 'CUSTOMER-1' else '' end as file from (select unnest(['lo_revenue', 'd_year', 's_region', 'p_mfgr', 'c_nation', 'c_none', 'x_none']) as c)"


@query("column_file_name", _FILES_SQL)
def _(spark, d):
    names = spark.createDataFrame([(c,) for c in ("lo_revenue", "d_year", "s_region", "p_mfgr", "c_nation", "c_none", "x_none")], ["column_name"])
    return names.select("column_name", column_file_name(F.col("column_name")).alias("file"))
