"""What several operators share: folders for written tables and ASCII lower case."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Capital or title-case letters outside A-Z: those that lower() would also change.
OTHER_CAPITALS = r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"

# Deletes the shuffle files of a query when it ends; set while a table is written.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths of the tables written so far, and those of each open ``scratch``.
_WRITTEN: dict[str, None] = {}
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a local session names none, as in tests, a temporary folder is set as
    its checkpoint folder; a cluster that names none is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, frees: Iterable[DataFrame] = (), keep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    This cuts the lineage: later stages survive the loss of any executor, and
    the table is computed once however often it is used.  The shuffles behind
    it are deleted, and so are the written tables ``frees``, which nothing but
    this one may still read; memory that the driver freed goes back to the system.  With ``keep`` it outlives the innermost ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    if before is not None:
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEAN_SHUFFLES, before)
    _WRITTEN[path] = None
    for made in _SCRATCH[-1:] if not keep else _SCRATCH[-2:-1]:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    discard(*frees)
    trim_driver(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        if path := t.__dict__.get("_written"):
            _delete(t.sparkSession, [path])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at its end, but for those to keep."""
    _SCRATCH.append(made := [])
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        _delete(spark, made)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for name in paths:
        if name in _WRITTEN:
            del _WRITTEN[name]
            path = jvm.org.apache.hadoop.fs.Path(name)
            n += path.getFileSystem(conf).delete(path, True)
    return n


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written, once their results are no longer needed."""
    return _delete(spark, list(_WRITTEN))


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles that no plan refers to any longer, which it does when the driver collects garbage."""
    give_back_memory()
    spark._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Returns what the driver's JVM has freed outside its heap to the system; whether it could.

    Planning and compiling many queries leaves hundreds of megabytes of such memory, which
    malloc would keep.  JVMs on Linux have this command from 17.0.9 on; with others nothing happens.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        kind = jvm.java.lang.Class.forName
        names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        kinds, given = gateway.new_array(jvm.java.lang.Class, len(names)), gateway.new_array(jvm.java.lang.Object, len(names))
        for i, name in enumerate(names):
            kinds[i] = kind(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class is not open to reflection, its interface is.
        invoke = kind("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until they differ from all columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def give_back_memory() -> None:
    """Returns freed memory of this Python process to the system: idle workers live on beside the next stage."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.

    ``lower`` does just that unless the text holds another capital letter, and
    is far cheaper than ``translate``; only texts with one take that way.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain | ~text.rlike(OTHER_CAPITALS), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
