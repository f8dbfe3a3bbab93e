import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm.maxscore import quantise, search_shard, top_k


def brute(q, v, k):
    out = []
    for i, a in q:
        best = {}
        for j, b in v:
            if j != i:
                s = sum(x * y for x, y in zip(a, b, strict=False))
                best[j] = max(s, best.get(j, s))
        out += [(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 40, 2000, 2**24, 2**28])
def test_search_equals_brute_force(scale):
    rng = np.random.default_rng(scale)
    v = rng.integers(-scale, scale, (5000, 12))
    v[:500] = v[0]
    ids = rng.permutation(5000)
    got = search_shard(ids[:40], v[:40], ids, v, 7)
    for i in range(40):
        s = v @ v[i]
        want = sorted(((-int(x), int(j)) for x, j in zip(s, ids, strict=True) if j != ids[i]))[:7]
        assert sorted((-int(x), int(j)) for q, j, x in zip(*got, strict=True) if q == ids[i]) == want


def test_distributed_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (305, [2.5]), (7, rows[8][1]), (None, [1.0] * 8), (299, rows[299][1])]
    df = spark.createDataFrame(rows, "id bigint, x array<float>").select("id", quantise(F.col("x")).alias("v"))
    kept = [(r.id, r.v) for r in df.collect() if r.id is not None and r.v is not None]
    assert {i for i, _ in kept} == {*range(300), 304, 305}
    queries = df.where("id % 20 = 0")
    got = top_k(df, queries, 20, shard_rows=50, query_rows=4)
    assert sorted(map(tuple, got.collect())) == brute([(i, v) for i, v in kept if i % 20 == 0], kept, 20)


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2])], "id bigint, v array<bigint>")
    assert [tuple(r) for r in top_k(df, df.where("id = 0")).collect()] == [(0, 1, 1, 2)]
    assert top_k(df.where("id > 9"), df.where("id > 9")).collect() == []
