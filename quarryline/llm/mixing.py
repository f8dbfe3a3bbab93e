"""Mixing sources to target weights, by Poisson replication.

A source with n documents and target weight w gets the repetition rate
w * total / n.  Each of its documents is repeated a Poisson-distributed number
of times with that mean: a uniform number seeded by the document's id is looked
up in the distribution's cumulative table (inversion).  The draw depends on
nothing but seed, id and rate, so a lost task gives the same copies again.
Copies are exploded and dealt over all partitions by a hash of seed, id and
copy, and sorted by it there: a global shuffle with one exchange.

A rate above ``SPLIT_RATE`` is drawn as a sum of several smaller ones.  Counts
of sources are added up in each task before they are shuffled; the table of
rates has a row a source, and Spark broadcasts it only if its written size is
under the session's threshold.  A source with any share of the rows is split:
the join to rates is by broadcast, or else adaptive execution splits it.

Defined results: a null source is a source of its own; sources without a
target weight are dropped if weights are given; weights are divided by their
sum; null texts are copied like others; a null id draws by the word "null";
repeated rows draw alike; texts of any length are copied whole; an empty table
gives no rows; columns named ``copy`` and ``mix_key`` are replaced (both names are
parameters), all others kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import materialise

SEED = "mix-1"
SPLIT_RATE = 64.0


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, seeded by the parts."""
    return _hex_number(F.concat_ws(":", *parts), 13) / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... far into the tail."""
    last = (F.ceil(rate * 2) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def source_rates(docs: DataFrame, source_column: str, weights: dict[str | None, float] | None, epochs: float) -> DataFrame:
    """A row a source: its rate, parts and cumulative table.

    Without weights, a source's weight is the square root of its size.
    """
    counts = docs.groupBy(F.col(source_column).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        weighted = counts.withColumn("_w", F.sqrt(F.col("_n").cast("double")))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_name string, _w double")
        weighted = counts.join(given, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    weighted = materialise(weighted, "sources")
    rows, sum_of_weights = weighted.agg(F.sum("_n"), F.sum("_w")).first()
    rates = weighted.select("_source", (F.col("_w") / F.lit(sum_of_weights) * F.lit(rows).cast("double") * epochs / F.col("_n")).alias("_rate"))
    parts = F.greatest(F.ceil(F.col("_rate") / SPLIT_RATE), F.lit(1)).cast("int")
    return rates.select("_source", "_rate", parts.alias("_parts"), poisson_table(F.col("_rate") / parts).alias("_table"))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = SEED, id_column: str = "doc_id", source_column: str = "source", copy_column: str = "copy", key_column: str = "mix_key"
) -> DataFrame:
    """Copies of the documents, shuffled: their columns, the number of the copy (from 0) and the key that orders them."""
    columns = [c for c in docs.columns if c not in (copy_column, key_column)]
    rates = materialise(source_rates(docs, source_column, weights, epochs), "rates")
    # The documents' own columns travel in one, so none can clash with those made here.
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("name"), F.col(source_column).alias("own_source"))

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("name"), part.cast("string"))
        return F.size(F.filter("_table", lambda c: c <= u))

    times = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), draw), F.lit(0), lambda a, b: a + b)
    counted = rows.join(rates, F.col("own_source").eqNullSafe(F.col("_source"))).withColumn("times", times).where("times > 0")
    copies = counted.select("row", "name", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    keyed = copies.select("row", "copy", _hex_number(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("name"), F.col("copy").cast("string")), 15).alias("key"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.select(*[F.col("row")[c].alias(c) for c in columns], F.col("copy").alias(copy_column), F.col("key").alias(key_column))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(documents: str = "documents", columns: str = "doc_id, text, lang, source, n_chars, copy, mix_key", seed: str = SEED) -> str:
    """SQL of ``mix`` with its defaults over a table, for rates up to SPLIT_RATE."""
    number = "cast('0x' || substr(md5({}), 1, {}) as bigint)"
    return f"""
with n as (select source, count(*) as n from {documents} group by source),
r as (select source, sqrt(n) / (select sum(sqrt(n)) from n) * (select sum(n) from n) / n as rate from n),
t as (select source, list(c order by k) as tab from (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as c
  from r, range(0, cast(ceil(rate * 2) as bigint) + 41) x(k)) group by source),
d as (select d.*, len(list_filter(tab, lambda c: c <= {number.format(f"concat('{seed}:', coalesce(cast(doc_id as varchar), 'null'), ':0')", 13)} / 4503599627370496.0)) as times
  from {documents} d join t on d.source is not distinct from t.source),
e as (select *, cast(unnest(range(0, times)) as int) as copy from d),
mixed as (select *, {number.format(f"concat('{seed}:order:', coalesce(cast(doc_id as varchar), 'null'), ':', copy)", 15)} as mix_key from e)
select {columns} from mixed
"""


ORACLE = oracle()
