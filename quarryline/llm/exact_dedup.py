"""Exact duplicates among texts, by DataFrame operations alone.

Skew-safe combining in three stages.  Rows are keyed by the SHA-256 digest of
the normalised text and a salt drawn from the id:

1. each task combines its own equal texts (the partial side of the first
   aggregation);
2. the groups of one digest and salt meet (its final side);
3. the winners of all salts meet, dealt by digest.

The normalised text itself is a grouping key at every stage, so texts are
compared in full and a digest that two texts shared would not merge them.  A
group of any size sends a row a task and salt at most, and no task sees a
group's rows.

``exact_dedup`` then tells each document what became of its text.  Winners carry
their salt, so documents and winners meet by digest, length, second hash and
salt: a hot group is dealt over as many tasks as there are salts.  The third
stage has seen every text of a digest; if two texts shared digest, length and
second hash, it stops with an error, so the join merges equal contents only.
``survivors`` carries the other columns of the winning row through the three
stages instead: two shuffles of the texts, and no join.

Defined results: a null text counts as empty; a null id loses to any other,
and a group of null ids alone has ``keep_id`` null and all its rows kept (one of
them in ``survivors``); a repeated row (same id, same text) is reported as often
as it occurs, and stays once in ``survivors``; of equal ids and texts that differ
in other columns the greatest row as JSON stays; texts of any length are
read whole and hashed whole; an empty table gives no rows; other columns may
have any name, and ``exact_dedup`` does not read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import ascii_lower

SALTS = 64
_KEY = ["_sha", "_len", "_xx", "_salt"]


def _keyed(docs: DataFrame, id_column: str, text_column: str, normalise: Callable[[Column], Column], salts: int) -> DataFrame:
    text = docs.select(F.col(id_column).alias("_id"), normalise(F.coalesce(F.col(text_column), F.lit(""))).alias("_t"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")
    return text.select("_id", "_t", F.sha2("_t", 256).alias("_sha"), F.length("_t").alias("_len"), F.xxhash64("_t").alias("_xx"), salt.alias("_salt"))


def salted_groups(keyed: DataFrame) -> DataFrame:
    """A row for each digest, salt and text: keys, keep_id and group_size, those of the text over all salts."""
    salted = keyed.groupBy("_sha", "_salt", "_t", "_len", "_xx").agg(F.max("_id").alias("_top"), F.count("*").alias("_n"))
    # At most one row a salt of each text meets here.
    met = salted.repartition("_sha")
    text, key = Window.partitionBy("_sha", "_len", "_xx", "_t"), Window.partitionBy("_sha", "_len", "_xx")
    one = F.min("_t").over(key) == F.max("_t").over(key)
    size = F.when(one, F.sum("_n").over(text)).otherwise(F.raise_error(F.lit("two texts share all hashes")))
    return met.select(*_KEY, F.max("_top").over(text).alias("keep_id"), size.alias("group_size"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] = ascii_lower, salts: int = SALTS) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_column, text_column, normalise, salts)
    many = salted_groups(keyed).where("group_size > 1")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return keyed.drop("_t").join(many, _KEY, "left").select(
        F.col("_id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] = ascii_lower, salts: int = SALTS) -> DataFrame:
    """The documents that stay, one for each distinct text, with all their columns."""
    text, others = F.col(text_column), [F.col(c) for c in docs.columns if c != text_column]
    order = F.struct(F.col(id_column).alias("id"), F.to_json(F.struct(*others)).alias("json"), F.xxhash64(text).alias("xx"))
    rows = docs.select(normalise(F.coalesce(text, F.lit(""))).alias("_t"), text.alias("_own"), F.struct(*others).alias("_row"), order.alias("_order"))
    # The text as it was is sent only where it differs from the normalised one.
    own = F.when(~F.col("_own").eqNullSafe(F.col("_t")), F.col("_own"))
    row = F.struct(F.col("_row").alias("row"), own.alias("own"), F.col("_own").isNull().alias("none"))
    salt = F.pmod(F.xxhash64(F.col("_order")["id"]), F.lit(salts)).cast("int")
    keyed = rows.select(F.sha2("_t", 256).alias("_sha"), salt.alias("_salt"), "_t", row.alias("_best"), "_order")
    best = [F.max_by("_best", "_order").alias("_best"), F.max("_order").alias("_order")]
    salted = keyed.groupBy("_sha", "_salt", "_t").agg(*best)
    last = salted.repartition("_sha").groupBy("_sha", "_t").agg(*best)
    restored = F.when(F.col("_best")["none"], F.lit(None)).otherwise(F.coalesce(F.col("_best")["own"], F.col("_t")))
    at = docs.columns.index(text_column)
    fields = [F.col("_best")["row"][c].alias(c) for c in docs.columns if c != text_column]
    return last.select(*fields[:at], restored.alias(text_column), *fields[at:])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from t group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t.t) as text_sha256 from t join g on t.t = g.t
"""
