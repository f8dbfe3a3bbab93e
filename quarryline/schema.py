"""Static schemas of the star benchmark and how its raw column files are named."""

from __future__ import annotations

from pyspark.sql import types as T

# Table prefixes and column orders of the star benchmark's raw files.
STAR_COLUMNS: dict[str, list[str]] = {
    "LINEORDER": ["lo_orderkey", "lo_linenumber", "lo_custkey", "lo_partkey", "lo_suppkey", "lo_orderdate", "lo_orderpriority", "lo_shippriority", "lo_quantity", "lo_extendedprice", "lo_ordtotalprice", "lo_discount", "lo_revenue", "lo_supplycost", "lo_tax", "lo_commitdate", "lo_shipmode"],
    "PART": ["p_partkey", "p_name", "p_mfgr", "p_category", "p_brand1", "p_color", "p_type", "p_size", "p_container"],
    "SUPPLIER": ["s_suppkey", "s_name", "s_address", "s_city", "s_nation", "s_region", "s_phone"],
    "CUSTOMER": ["c_custkey", "c_name", "c_address", "c_city", "c_nation", "c_region", "c_phone", "c_mktsegment"],
    "DDATE": ["d_datekey", "d_date", "d_dayofweek", "d_month", "d_year", "d_yearmonthnum", "d_yearmonth", "d_daynuminweek", "d_daynuminmonth", "d_daynuminyear", "d_sellingseason", "d_lastdayinweekfl", "d_lastdayinmonthfl", "d_holidayfl", "d_weekdayfl"],
}
# The first letter of a column names its table.
TABLE_OF_LETTER = {"l": "LINEORDER", "p": "PART", "s": "SUPPLIER", "c": "CUSTOMER", "d": "DDATE"}
# Rows of each table by scale factor.
STAR_ROWS: dict[int, dict[str, int]] = {
    1: {"LINEORDER": 6_001_171, "PART": 200_000, "SUPPLIER": 2_000, "CUSTOMER": 30_000, "DDATE": 2_556},
    10: {"LINEORDER": 59_986_214, "PART": 800_000, "SUPPLIER": 20_000, "CUSTOMER": 300_000, "DDATE": 2_556},
    20: {"LINEORDER": 119_994_746, "PART": 1_000_000, "SUPPLIER": 40_000, "CUSTOMER": 600_000, "DDATE": 2_556},
}

KEY_VALUE = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType())])

REPORT = T.StructType([
    T.StructField("Kernel type", T.StringType()),
    T.StructField("Num cols", T.LongType()),
    T.StructField("Init buffer size", T.LongType()),
    T.StructField("Num bytes", T.LongType()),
    T.StructField("Num Blocks", T.LongType()),
    T.StructField("Num threads", T.LongType()),
    T.StructField("Kernel Time", T.DoubleType()),
    T.StructField("Malloc Count", T.LongType()),
])


def rows_at(scale_factor: int) -> dict[str, int]:
    """Row counts at a scale factor; another one is an error that names it."""
    if scale_factor not in STAR_ROWS:
        raise ValueError(f"scale factor {scale_factor} is not one of {sorted(STAR_ROWS)}")
    return STAR_ROWS[scale_factor]


def column_file(column: str) -> str:
    """The raw file that holds a column, such as ``DDATE4`` for ``d_year``."""
    table = TABLE_OF_LETTER.get(column[:1])
    if table is None or column not in STAR_COLUMNS[table]:
        raise ValueError(f"no table of the star schema has a column {column!r}")
    return f"{table}{STAR_COLUMNS[table].index(column)}"
