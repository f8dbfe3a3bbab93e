"""Readers and writers."""

from quarryline.sources.csv_report import append_report, read_report
from quarryline.sources.parquet import table, tables
from quarryline.sources.raw_columns import read_raw_columns, write_raw_columns
from quarryline.sources.synthetic import uniform_columns

__all__ = ["append_report", "read_raw_columns", "read_report", "table", "tables", "uniform_columns", "write_raw_columns"]
