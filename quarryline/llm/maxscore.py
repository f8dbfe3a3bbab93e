"""Exact top-k search by inner product, with MaxScore.

Vectors are quantised to integers and read as documents whose terms are their
dimensions.  A query's weight on a term and the least and greatest value of the
term in a shard bound what the term can add to a score.  For each query, terms
are ranked by the spread of that bound.  The terms at the bottom whose bounds
together cannot lift a vector from its least possible score to the query's
k-th best score so far are non-essential.

Within a shard, vectors come in blocks.  The essential postings of a block are
traversed first (for many queries at once, as one product of matrices in which
the other terms have weight zero).  Then the non-essential terms are probed in
falling order of their bounds, a few at a time, and only for the pairs that can
still reach the k-th best score; a pair that ties with it stays.  Each shard
yields its own top k of each query, and shards are merged by score.

Scores are integers and exact: products are taken in float32 or float64 while
their sums stay below 2^24 or 2^53, and in int64 beyond that.

Queries are dealt into blocks and vectors into shards by a hash of the id; each
pair of a block and a shard is one task's work, of bounded size.

Defined results: a vector that is null or holds a null or non-finite component
takes no part; shorter vectors count as padded with zeros; rows with the id of
the query are its own and no candidates; a candidate row that repeats (same
id) counts once, by its highest score; null ids take no part; ties go to
the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 2048
BLOCK_ROWS = 2048
BATCH_QUERIES = 128
PROBE_TERMS = 16


def quantise(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component; null where a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fit = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(wide, lambda x: F.floor(x * factor).cast("bigint")))


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    column = column.combine_chunks()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    width = int(max(lengths.max(initial=0), width or 0))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of each query within one shard: rows of (query id, vector id, score)."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, vectors))
    most = int(np.abs(queries).sum(1).max(initial=0)) * int(np.abs(vectors).max(initial=0))
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    if not len(ids):
        return query_ids[:0], ids, np.zeros(0, np.int64)
    low, high = vectors.min(0), vectors.max(0)
    outs = []
    for first in range(0, len(queries), BATCH_QUERIES):
        q, qid = queries[first : first + BATCH_QUERIES], query_ids[first : first + BATCH_QUERIES]
        outs += _search_batch(q, qid, ids, vectors, low, high, k)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _search_batch(q, qid, ids, vectors, low, high, k):
    n, width = q.shape
    least, most = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
    spread = most - least
    by_bound = np.argsort(-spread, axis=1, kind="stable")
    rank = np.empty_like(by_bound)
    np.put_along_axis(rank, by_bound, np.broadcast_to(np.arange(width), (n, width)).copy(), 1)
    # rest[j]: the most that the terms ranked j and after can add.
    ranked_most = np.take_along_axis(most, by_bound, 1)
    ranked_spread = np.take_along_axis(spread, by_bound, 1)
    rest = np.concatenate([np.cumsum(ranked_most[:, ::-1], 1)[:, ::-1], np.zeros((n, 1), q.dtype)], 1)
    slack = np.concatenate([np.cumsum(ranked_spread[:, ::-1], 1)[:, ::-1], np.zeros((n, 1), q.dtype)], 1)
    floor = least.sum(1)
    # The k-th best score so far; none until there are k.
    threshold, known = np.full(n, np.iinfo(np.int64).min // 4 if q.dtype == np.int64 else -np.inf, q.dtype), np.zeros(n, bool)
    best_score, best_id = [np.zeros(0, q.dtype) for _ in range(n)], [np.zeros(0, ids.dtype) for _ in range(n)]
    rows, repeats = np.arange(n), len(np.unique(ids)) < len(ids)
    for at in range(0, len(ids), BLOCK_ROWS):
        block, block_ids = vectors[at : at + BLOCK_ROWS], ids[at : at + BLOCK_ROWS]
        # Non-essential: the longest tail of terms that cannot lift the floor to the threshold.
        short = slack < (threshold - floor)[:, None]
        essential = np.where(known & short.any(1), short.argmax(1), width)
        partial = np.where(rank < essential[:, None], q, 0).astype(q.dtype) @ block.T
        alive = partial + rest[rows, essential][:, None] >= threshold[:, None]
        alive &= block_ids[None, :] != qid[:, None]
        for step in range(int(essential.min()), width, PROBE_TERMS):
            start = np.maximum(essential, step)
            probed = np.where((rank >= start[:, None]) & (rank < step + PROBE_TERMS), q, 0).astype(q.dtype)
            if alive.mean() > 0.1:
                partial += probed @ block.T
            else:
                i, j = np.nonzero(alive)
                partial[i, j] += np.einsum("ij,ij->i", probed[i], block[j])
            done = np.maximum(essential, min(step + PROBE_TERMS, width))
            alive &= partial + rest[rows, done][:, None] >= threshold[:, None]
        for i in np.flatnonzero(alive.any(1)):
            hit = np.flatnonzero(alive[i])
            score, found = np.concatenate([best_score[i], partial[i, hit]]), np.concatenate([best_id[i], block_ids[hit]])
            order = np.lexsort((found, -score))
            score, found = score[order], found[order]
            if repeats:
                keep = np.sort(np.unique(found, return_index=True)[1])
                score, found = score[keep], found[keep]
            best_score[i], best_id[i] = score[:k], found[:k]
            if len(score) >= k:
                threshold[i], known[i] = best_score[i][k - 1], True
    return [(np.full(len(s), x), f, s.astype(np.int64)) for x, s, f in zip(qid, best_score, best_id, strict=True)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best vectors of each query.  Both inputs: columns id (bigint) and v (array<bigint>)."""
    fit = F.col("id").isNotNull() & F.col("v").isNotNull()
    vectors, queries = vectors.where(fit).select("id", "v"), queries.where(fit).select("id", "v").dropDuplicates(["id", "v"])
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    left = queries.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), "id", "v")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), shard.alias("s"), "id", "v")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            qi, vi, sc = search_shard(a["id"].to_numpy(), _matrix(a["v"]), b["id"].to_numpy(), _matrix(b["v"]), k)
        else:
            qi = vi = sc = np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(qi, pa.int64()), "vec_id": pa.array(vi, pa.int64()), "score": pa.array(sc, pa.int64())})

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    # A query id that names several vectors keeps its best score for each candidate.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantise(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where(F.col("id") % 20 == 0), 20)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20
"""
