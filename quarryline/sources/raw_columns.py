"""Raw column files: one file a column, fixed-width native-endian numbers.

The reader is a Python data source that splits the rows into byte ranges and
hands Arrow batches to Spark, so a task reads the same rows of each wanted
file and no others.  The files must be on a path every executor can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryline.schema import column_file

ROWS_PER_SPLIT = 4 << 20
ROWS_PER_BATCH = 1 << 16
# numpy type and Spark type of each name that a raw column may be stored as.
KINDS = {"int": ("<i4", T.IntegerType()), "bigint": ("<i8", T.LongType())}


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class RawColumnReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.folder, self.split = options["path"], int(options.get("rowsPerSplit", ROWS_PER_SPLIT))
        self.dtypes = [KINDS[f.dataType.simpleString()][0] for f in schema.fields]

    def _file(self, column: str) -> str:
        return os.path.join(self.folder, column_file(column))

    def partitions(self) -> list[RowRange]:
        import numpy as np

        sizes = {c: os.path.getsize(self._file(c)) // np.dtype(d).itemsize for c, d in zip(self.columns, self.dtypes, strict=True)}
        if len(set(sizes.values())) != 1:
            raise ValueError(f"the columns have different numbers of rows: {sizes}")
        rows = next(iter(sizes.values()))
        return [RowRange(i, min(i + self.split, rows)) for i in range(0, rows, self.split)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for first in range(part.first, part.last, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, part.last - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.fromfile(self._file(c), d, n, offset=first * np.dtype(d).itemsize)) for c, d in zip(self.columns, self.dtypes, strict=True)],
                names=self.columns,
            )


class RawColumns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_columns"

    def schema(self) -> T.StructType:
        kind = KINDS[self.options.get("kind", "int")][1]
        return T.StructType([T.StructField(c, kind, False) for c in self.options["columns"].split(",")])

    def reader(self, schema: T.StructType) -> RawColumnReader:
        return RawColumnReader(schema, self.options)


def read_raw_columns(spark: SparkSession, folder: str, columns: list[str], kind: str = "int", rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The named columns as one DataFrame; a missing file is an error."""
    for c in columns:
        if not os.path.exists(path := os.path.join(folder, column_file(c))):
            raise FileNotFoundError(path)
    spark.dataSource.register(RawColumns)
    return spark.read.format("raw_columns").options(columns=",".join(columns), kind=kind, rowsPerSplit=str(rows_per_split)).load(folder)


def write_raw_columns(df: DataFrame, folder: str, order_by: str, columns: list[str], kind: str = "int") -> int:
    """Writes columns as raw files in the order of ``order_by``; returns the rows.

    Rows are sorted by range, each partition is counted, and every task then
    writes at its own offset of the files.  Only one number a partition comes
    to the driver.  Ties of ``order_by`` are ordered by the columns, so a task that runs again writes the same bytes again.
    """
    import numpy as np

    dtype, width = KINDS[kind][0], np.dtype(KINDS[kind][0]).itemsize
    ordered = df.select(order_by, *[F.col(c) for c in columns if c != order_by]).orderBy(order_by, *[c for c in columns if c != order_by]).persist()
    counts = {r.p: r.n for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    os.makedirs(folder, exist_ok=True)
    paths = {c: os.path.join(folder, column_file(c)) for c in columns}
    for path in paths.values():
        with open(path, "wb") as f:
            f.truncate(total * width)

    def write(batches):
        from pyspark import TaskContext

        at = starts.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            for c, path in paths.items():
                with open(path, "r+b") as f:
                    f.seek(at * width)
                    f.write(b.column(c).to_numpy(zero_copy_only=False).astype(dtype).tobytes())
            at += b.num_rows
        yield from ()

    ordered.mapInArrow(write, "done int").count()
    ordered.unpersist()
    return total
