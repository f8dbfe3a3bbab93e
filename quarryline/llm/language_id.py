"""The language of a text, by sparse multinomial logistic regression.

Features are character n-grams (one to three characters) of the folded text:
letters in lower case, each run of anything else as one space.  They are hashed
into a fixed number of buckets.  A text's value for a bucket is the share of its
n-grams that fall there times the bucket's inverse document frequency.  The
document frequencies are counted over all documents that may be learnt from.

The weights are trained by follow-the-regularised-leader (FTRL-proximal), whose
L1 part keeps most of them zero and whose L2 part keeps the rest small, on at
most ``rows_per_language`` documents of each language, the ones with the
smallest hash of their id.  A tenth of these are held back from it; on them, one
temperature is fitted by the likelihood, by which all scores are divided.

Prediction reads whole texts, in chunks of bounded size, and adds up weights
n-gram by n-gram.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there was nothing to learn from; a null language is
never learnt from; a document whose id is null is neither learnt from nor held
out; repeated rows are predicted alike; an empty table gives no rows; columns
other than the id, the text and (for learning) the language are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import give_back_memory, materialise, scratch

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ROWS_PER_LANGUAGE = 1000
EPOCHS = 3
CHUNK_CHARS = 1 << 20
SLICE_ROWS = 256
UNKNOWN = "und"


def remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# Features

_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or 0."""
    if not _FOLD:
        letters = (chr(c) for c in range(0x10000))
        _FOLD.append(np.array([ord(x.lower()[0]) if x.isalpha() else 0 for x in letters], np.uint32))
    return _FOLD[0]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts in a row, each text between spaces (0), and where each begins."""
    table = fold_table()
    points = np.frombuffer("\0\0".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    # Letters beyond the basic plane share one symbol.
    chars = table[np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        chars[far] = [1 if chr(p).isalpha() else 0 for p in points[far]]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 2)]) + 1
    # Each text keeps the space before it and one after it; other runs shrink to one.
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0)
    keep[starts] = True
    keep[starts + lengths + 1] = True
    at = np.cumsum(keep) - 1
    return chars[keep], at[starts]


def ngram_buckets(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at each character: rows for one, two and three characters.

    An n-gram that would run into the next text gets the bucket past the end.
    """
    n = len(chars)
    out = np.full((3, n), BUCKETS, np.uint32)
    shift, mix = np.uint32(32 - BUCKET_BITS), np.uint32(2654435761)
    key = chars + np.uint32(1)
    for order in range(3):
        if order:
            key = key[:-1] * np.uint32(0x01000193) + chars[order:] + np.uint32(1)
        if len(key):
            out[order, : len(key)] = (key * mix) >> shift
    ends = np.concatenate([starts[1:], [n]])
    for back in (1, 2):
        at = ends - back
        out[back:, at[at >= 0]] = BUCKETS
    out[:, ends - 1] = BUCKETS
    return out


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about the given size; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time: the texts of a whole batch would be held twice."""
    for b in batches:
        for first in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(first, SLICE_ROWS)


# The model


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray = field(repr=False)  # (buckets + 1, languages), times IDF
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated scores of each text, and whether it has a letter."""
        scores, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for first, part in chunks(texts):
            chars, starts = folded(part)
            buckets = ngram_buckets(chars, starts)
            rows = slice(first, first + len(part))
            letters[rows] = np.maximum.reduceat(chars, starts) > 0
            valid = np.add.reduceat((buckets < BUCKETS).sum(0), starts)
            total = np.zeros((len(part), len(self.languages)))
            for k in range(len(self.languages)):
                w = np.ascontiguousarray(self.weights[:, k])
                total[:, k] = np.add.reduceat(w[buckets[0]] + w[buckets[1]] + w[buckets[2]], starts, dtype=np.float64)
            scores[rows] = total / np.maximum(valid, 1)[:, None] + self.bias
        return scores, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores, letters = self.logits(texts)
        p = softmax(scores / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def counted_rows(texts: list[str]) -> list[tuple[bytes, bytes]]:
    """Buckets of each text and how often each occurs, in two bytes a number; counts of a text with larger ones in four."""
    out = []
    for t in texts:
        chars, starts = folded([t])
        b = ngram_buckets(chars, starts)
        at, n = np.unique(b[b < BUCKETS], return_counts=True)
        out.append((at.astype("<u2").tobytes(), n.astype("<u2" if n.max(initial=0) < 1 << 16 else "<u4").tobytes()))
    return out


def sparse_row(at: bytes, n: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text from what ``counted_rows`` says of it."""
    n = np.frombuffer(n, "<u2" if len(n) == len(at) else "<u4").astype(np.int64)
    at = np.frombuffer(at, "<u2")
    return at, n / max(n.sum(), 1) * idf[at]


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, epochs: int = EPOCHS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net: weights (buckets, labels) and biases."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta * 0.01 + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 0.1)  # the last stands for the bias
            w = weights(at)
            g = softmax(x @ w)
            g[labels[i]] -= 1.0
            grad = x[:, None] * g[None, :]
            sigma = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / alpha
            z[at] += grad - sigma * w
            n[at] += grad**2
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1] * 0.1


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the highest likelihood, among a fine geometric grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each bucket occurs, and how many there are.

    Tasks count on their own; a row a bucket and task is shuffled and one a
    bucket reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            n += len(texts)
            for _, part in chunks(texts):
                chars, starts = folded(part)
                buckets, ends = ngram_buckets(chars, starts), [*starts[1:], len(chars)]
                for a, b in zip(starts, ends, strict=True):
                    seen = np.zeros(BUCKETS + 1, bool)
                    seen[buckets[:, a:b].ravel()] = True
                    df += seen
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["bucket", "n"])
        give_back_memory()

    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] == BUCKETS:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


def smallest_hashes(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """Of each language, at most so many documents: (lang, text, k), smallest hashes k first.

    A language's size says below which hash enough of its documents lie (by six
    standard deviations), so few rows more than are chosen come together in one
    task, whatever share of the rows a language has.  Where too few lie there, as repeated
    rows share a hash, each task sends its own smallest hashes instead.
    """
    key = F.xxhash64("doc_id", "text")
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", "doc_id", key.alias("k"))
    sizes = materialise(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")), "languages")
    enough = rows_per_language + 6 * math.sqrt(rows_per_language)
    place = F.shiftrightunsigned("k", 11) / F.lit(float(1 << 53))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("k", 11), "k", "doc_id")

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.select("lang", "text", "k", F.row_number().over(first).alias("r")).where(F.col("r") <= rows_per_language)

    near = labelled.join(sizes, F.col("lang") == F.col("_lang")).where(place <= enough / F.col("_n"))
    chosen = materialise(smallest(near), "sample")
    found = chosen.groupBy(F.col("lang").alias("_found")).agg(F.count("*").alias("_c"))
    few = sizes.join(found, F.col("_lang") == F.col("_found"), "left").where(F.coalesce("_c", F.lit(0)) < F.least("_n", F.lit(rows_per_language)))
    names = [r["_lang"] for r in few.select("_lang").collect()]
    if names:
        chosen = chosen.where(~F.col("lang").isin(names)).unionByName(smallest(labelled.where(F.col("lang").isin(names))))
    return chosen


def sample_features(sample: DataFrame, idf: np.ndarray) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, k, buckets, values) of each row of (lang, text, k), in a fixed order.

    Features are counted on executors: four bytes for each bucket of a row, at most
    some hundred kilobytes however long its text is, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = counted_rows(b.column(1).to_pylist())
            at, n = (pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), at, n], names=["lang", "k", "at", "n"])
        give_back_memory()

    # As Arrow's bytes, which neither the JVM nor Python takes apart into rows.
    rows = sample.select("lang", "text", "k").mapInArrow(count, "lang string, k bigint, at binary, n binary").toArrow()
    rows = sorted(zip(*[rows[c].to_pylist() for c in ("lang", "k", "at", "n")], strict=True))
    return [(lang, k, *sparse_row(at, n, idf)) for lang, k, at, n in rows]


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """Learns from all rows of columns doc_id, text, lang that it is given."""
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    with scratch(docs.sparkSession):
        rows = sample_features(smallest_hashes(docs, rows_per_language), idf)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    labels = np.array([languages.index(r[0]) for r in rows])
    sparse = [(r[2], r[3]) for r in rows]
    held = np.array([r[1] % 10 == 0 for r in rows]) if len(rows) >= 100 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    w, bias = train_ftrl([sparse[i] for i in train], labels[train], len(languages), epochs)
    scores = np.array([x @ w[at] + bias for at, x in (sparse[i] for i in np.flatnonzero(held))]).reshape(-1, len(languages))
    scaled = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    scaled[:-1] = w * idf[:, None]
    return Model(languages, scaled, bias, fit_temperature(scores, labels[held]))


def predict(docs: DataFrame, model: Model, text_column: str = "text", lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """All columns of docs, then the language and its score, which replace columns of their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [lang_column, score_column]
    taken = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            texts = [t or "" for t in b.column(b.schema.names.index(text_column)).to_pylist()]
            lang, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, *added])
        give_back_memory()

    schema = docs.select(*taken).schema.add(lang_column, "string").add(score_column, "double")
    return docs.select(*taken).mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from: those not held out."""
    return docs.where(remainder(F.col("doc_id")) != 0).select("doc_id", "text", "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(learnable(docs))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
