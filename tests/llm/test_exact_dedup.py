import hashlib
from collections import defaultdict

from quarryline.llm.exact_dedup import exact_dedup, survivors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        n = (t or "").translate(LOWER)
        keep = max((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_cases(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, exact_dedup(edge).collect()), key=repr) == brute(rows)


def test_empty_table(empty):
    assert exact_dedup(empty).collect() == []
    assert survivors(empty).collect() == []


def test_survivors_keep_columns_and_one_row_a_text(edge):
    kept = survivors(edge)
    assert kept.columns == edge.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted({(r.text or "").translate(LOWER) for r in edge.collect()})


def test_one_group_of_many(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    out = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert out[0].keep_id == 4998 and out[0].group_size == 1667 and not out[0].kept and out[4998].kept
    assert sum(r.kept for r in out.values()) == 5000 - 1666
    assert survivors(docs).count() == 5000 - 1666


def test_equal_digests_of_different_texts_stay_apart(spark):
    """Full texts are compared: folding them away must not merge groups."""
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id bigint, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup(docs).collect()} == {1: 2, 2: 2, 3: 3}
