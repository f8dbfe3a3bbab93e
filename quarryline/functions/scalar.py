"""Arithmetic, sizing and text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.schema import STAR_COLUMNS, TABLE_OF_LETTER

# Decimal byte units, smallest first.
UNITS = ("B", "KB", "MB", "GB")


def profit(revenue: Column, cost: Column) -> Column:
    """Revenue less cost, widened before the subtraction."""
    return revenue.cast("bigint") - cost.cast("bigint")


def next_pow2(value: Column) -> Column:
    """The smallest power of two that is not below value; 0 stays 0."""
    v = value.cast("bigint") - 1
    for shift in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftright(v, shift))
    return v + 1


def table_size(rows: Column) -> Column:
    """Slots of a hash table for that many rows: a power of two, 1.25 times as many, 1 at least."""
    return F.greatest(next_pow2(F.shiftright(rows.cast("bigint") * 5, 2)), F.lit(1).cast("bigint"))


def round_up(value: Column, step: int = 32) -> Column:
    """The next multiple of step."""
    v = value.cast("bigint") + (step - 1)
    return v - F.pmod(v, F.lit(step).cast("bigint"))


def bytes_humanize(value: Column) -> Column:
    """Bytes as a whole number of decimal units, halves to even; null from 1000 GB on."""
    out = F.lit(None).cast("string")
    for i, unit in reversed(list(enumerate(UNITS))):
        scaled = value.cast("double") / float(1000**i)
        out = F.when(scaled < 1000.0, F.concat(F.bround(scaled, 0).cast("bigint").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def bytes_parse(text: Column) -> Column:
    """The inverse: "25 KB" is 25000; an unknown unit gives null."""
    parts = F.split(text, " ")
    factor = reduce(lambda acc, x: acc.when(parts[1] == x[1], F.lit(1000 ** x[0]).cast("bigint")), enumerate(UNITS), F.when(F.lit(False), F.lit(0).cast("bigint")))
    return (parts[0].cast("bigint") * factor).cast("bigint")


def column_file_name(column: Column) -> Column:
    """The raw file of a column's name: table prefix and position, -1 if the table lacks it, "" for an unknown table."""
    out = F.lit("")
    for letter, table in TABLE_OF_LETTER.items():
        at = F.array_position(F.array(*[F.lit(c) for c in STAR_COLUMNS[table]]), column) - 1
        out = F.when(F.substring(column, 1, 1) == letter, F.concat(F.lit(table), at.cast("string"))).otherwise(out)
    return out
