"""The pipeline's stages against a brute-force version of each, on the small documents."""

import hashlib
import math
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from .test_ngram_join import brute as near_brute

from quarryline.llm import language_id, mixing, packing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def draw(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{doc_id}:0".encode()).hexdigest()[:13], 16) / 2**52
    p = c = math.exp(-rate)
    k = 0
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_stage(stages):
    model = language_id.fit(language_id.learnable(stages[0]))
    lang, score = model.predict([r.text or "" for r in stages[0].collect()])
    want = sorted(r.doc_id for r, p, s in zip(stages[0].collect(), lang, score, strict=True) if p != "und" and s >= P.LEAST_SCORE)
    assert sorted(rows(stages[1])) == want and stages[1].columns == stages[0].columns
    assert len(want) > 0.95 * stages[0].count()


def test_exact_stage(stages):
    best = {}
    for i, t in rows(stages[1]).items():
        best[t.translate(LOWER)] = max(i, best.get(t.translate(LOWER), i))
    assert sorted(rows(stages[2])) == sorted(best.values()) and stages[2].columns == stages[0].columns


def test_near_stage(stages):
    want = sorted(c for i, _, c in near_brute(sorted(rows(stages[2]).items())) if c == i)
    assert sorted(rows(stages[3])) == want and stages[3].columns == stages[0].columns


def test_mixing_stage(stages):
    docs = stages[3].collect()
    n = {}
    for r in docs:
        n[r.source] = n.get(r.source, 0) + 1
    weight = sum(math.sqrt(x) for x in n.values())
    want = sorted(r.doc_id for r in docs for _ in range(draw(mixing.SEED, r.doc_id, math.sqrt(n[r.source]) / weight * len(docs) / n[r.source])))
    assert sorted(r.doc_id for r in stages[4].collect()) == want and stages[4].columns == stages[0].columns


def test_packing_stage(stages):
    encode = packing.word_encoder(packing.tokenizer_file())
    want = []
    for r in stages[4].collect():
        ids = encode(r.text) + np.array([1], "<u4").tobytes()
        want += [(r.doc_id, k, zlib.crc32(ids[a : a + 16384])) for k, a in enumerate(range(0, len(ids), 16384))]
    got = stages[5].collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got) == sorted(want)
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(spans) <= 1.02 * sum(r.length for r in got) / 4096 + 1


def test_run_gives_the_last_stage(spark, sf, stages):
    got = P.run(spark, sf)
    assert sorted((r.doc_id, r.piece) for r in got.collect()) == sorted((r.doc_id, r.piece) for r in stages[5].collect())


def test_near_stage_with_missing_and_repeated_ids(spark, sf):
    say = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    near = lambda k: say(k) + " more"
    rows = [
        (5, say(1)), (None, near(1)),  # linked: the one with an id stays
        (None, say(2)),  # alone, without an id
        (None, say(3)), (None, near(3)), (None, near(3) + " again"),  # near copies, all without an id
        (3, say(4)), (7, near(4)), (7, say(5)), (9, near(5)),  # 7 loses in one group and stays in another
        (None, None), (None, ""), (8, say(6)), (8, near(6)),
    ]
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf).collect()
    left = sorted((r.doc_id or 0, r.text or "") for r in got)
    groups = [[(5, say(1))], [(0, say(2))], [(0, say(3)), (0, near(3)), (0, near(3) + " again")], [(3, say(4))], [(7, say(5))], [(0, "")], [(8, say(6)), (8, near(6))]]
    assert [sum(x in g for x in left) for g in groups] == [1, 1, 1, 1, 1, 2, 1] and len(left) == 8
