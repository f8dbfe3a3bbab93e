"""A corpus pipeline made of the operators in ``quarryline.llm``.

Documents whose language is not recognised go; of equal texts one stays; of each
group of near copies one stays; sources are mixed to target weights; what
comes out is packed into training sequences.  Every stage but the last returns
the columns of ``documents``; each is written to the shared folder and read
back by the next, so a lost executor costs the stage at hand only.

Defined results: empty tables pass every stage as empty tables; columns beside
``doc_id``, ``text``, ``lang`` and ``source`` may have any name and are handed on
as they are; what each stage does with nulls, ties and repeated rows is said there;
texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup, language_id, mixing, ngram_join, packing
from quarryline.llm.common import forget_shuffles, fresh, materialise, scratch

# Texts without a letter, and those the model gives less than this, are rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; the model learns from the documents it is given.  A null text goes."""
    forget_shuffles(spark)
    lang, score = fresh(docs.columns, "lang_pred", "score")
    model = language_id.fit(language_id.learnable(docs))
    known = language_id.predict(docs, model, lang_column=lang, score_column=score)
    return known.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id.  Null texts count as empty; repeated rows stay once."""
    forget_shuffles(spark)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near copies, one document: that with the smallest id, if any has one.

    Documents are told apart by id and text, so neither a missing nor a repeated id costs another document;
    a row that repeats stays or goes as a whole.  Documents without a word stay.
    """
    forget_shuffles(spark)
    with scratch(spark):
        lost = materialise(ngram_join.copies(docs), "lost", keep=True)
    own_id, own_text, row = fresh(("doc_id", "digest"), "own_id", "own_text", "row")
    rows = docs.select(F.struct(*docs.columns).alias(row), F.col("doc_id").cast("bigint").alias(own_id), ngram_join.text_digest().alias(own_text))
    left = rows.join(lost, F.col(own_id).eqNullSafe(F.col("doc_id")) & (F.col(own_text) == F.col("digest")), "left_anti")
    return left.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source, shuffled; a document may come several times or not at all.  A null source is one of its own."""
    forget_shuffles(spark)
    copy, key = fresh(docs.columns, "copy", "mix_key")
    return mixing.mix(docs, copy_column=copy, key_column=key).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences.  A null text is one end token."""
    forget_shuffles(spark)
    return packing.pack(docs, packing.tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL cannot train or apply the first stage's model; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, frees=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
