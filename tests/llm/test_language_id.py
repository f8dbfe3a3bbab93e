import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarryline.llm import language_id as L


@pytest.fixture(scope="module")
def predicted(spark, sf):
    rows = L.op10_language_id(spark, sf).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    return rows, truth


def test_one_row_a_document_and_held_out(predicted):
    rows, truth = predicted
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(predicted):
    rows, truth = predicted
    held = [r for r in rows if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert len(held) > 100
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.9


def test_scores_and_unknown(predicted):
    rows, truth = predicted
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or ""))


def test_result_does_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    texts = ["", "a", "  ", "ab cd", "ÉCOLE école", "x" * 50, "12 ab 34", "😀 𝒳y"] * 3
    w = rng.normal(size=(L.BUCKETS + 1, 3)).astype(np.float32)
    w[-1] = 0
    model = L.Model(["a", "b", "c"], w, np.zeros(3))
    together, letters = model.logits(texts)
    for i, t in enumerate(texts):
        alone, one = model.logits([t])
        assert np.allclose(alone[0], together[i], atol=1e-5) and one[0] == letters[i] == any(c.isalpha() for c in t)


def test_features_equal_brute_force():
    for text in ("Ab, c", "été", " x", "", "a--b"):
        chars, starts = L.folded([text, "zz"])
        folded = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
        while "  " in folded:
            folded = folded.replace("  ", " ")
        want = [0 if c == " " else ord(c) for c in (folded if text.strip() else "  ")]
        assert chars[starts[0] : starts[1]].tolist() == want


def test_edge_cases(edge, empty):
    model = L.fit(L.learnable(edge))
    rows = L.predict(edge, model).collect()
    assert len(rows) == edge.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    nothing = L.fit(L.learnable(empty))
    assert nothing.languages == [] and L.predict(empty, model).collect() == []
    assert {r.lang_pred for r in L.predict(edge, nothing).collect()} == {"und"}


def plain_ftrl(rows, labels, n_labels, epochs, alpha, beta, l1, l2, seed):
    """Follow-the-regularised-leader, one weight at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def w(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - math.copysign(l1, z[i, k])) / ((beta * 0.01 + math.sqrt(n[i, k])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x = [*rows[r][0], L.BUCKETS], [*rows[r][1], 0.1]
            own = {(i, k): w(i, k) for i in at for k in range(n_labels)}
            p = L.softmax(np.array([sum(v * own[i, k] for i, v in zip(at, x, strict=True)) for k in range(n_labels)]))
            for i, v in zip(at, x, strict=True):
                for k in range(n_labels):
                    g = v * (p[k] - (k == labels[r]))
                    s = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha
                    z[i, k] += g - s * own[i, k]
                    n[i, k] += g * g
    return w


def test_training_equals_a_plain_version_and_is_sparse():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(40)]
    labels = np.array([int(r[0][0] > 3) + int(r[0][-1] > 27) for r in rows])
    weights, bias = L.train_ftrl(rows, labels, 3, 2, l1=0.3, seed=5)
    w = plain_ftrl(rows, labels, 3, 2, 2.0, 1.0, 0.3, 0.0005, 5)
    assert np.allclose(weights[:30], [[w(i, k) for k in range(3)] for i in range(30)], atol=1e-9)
    assert np.allclose(bias, [0.1 * w(L.BUCKETS, k) for k in range(3)], atol=1e-9)
    assert (weights[30:] == 0).all() and 0 < (weights[:30] == 0).mean() < 1
    assert (L.train_ftrl(rows, labels, 3, 2, l1=0.9, seed=5)[0] == 0).sum() > (weights == 0).sum()


def test_temperature_has_the_highest_likelihood():
    rng = np.random.default_rng(0)
    scores, labels = rng.normal(0, 4, (400, 3)), np.zeros(400, int)
    p = L.softmax(scores / 2.5)
    labels = np.array([rng.choice(3, p=q) for q in p])
    t = L.fit_temperature(scores, labels)
    loss = lambda t: -np.log(L.softmax(scores / t)[np.arange(400), labels]).mean()
    assert 1.8 < t < 3.4 and all(loss(t) <= loss(x) + 1e-9 for x in (t * 0.8, t * 1.25, 1.0, 5.0))


def test_a_language_of_repeated_rows_is_learnt(spark):
    rows = [(1, "der die das und nicht ist", "de")] * 300 + [(i + 2, f"the and of is not {i}", "en") for i in range(60)]
    model = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows_per_language=40)
    assert model.languages == ["de", "en"]


def test_few_texts_of_a_batch_are_held_at_a_time(spark):
    class Counted:
        """As a model of executors, gives each text the number of texts it came with."""

        def __reduce__(self):
            return eval, ("type('Counted', (), {'predict': lambda self, t: (['en'] * len(t), [float(len(t))] * len(t))})()",)

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1500)], "doc_id long, text string").coalesce(1)
    rows = L.predict(docs, Counted()).collect()
    assert [r.doc_id for r in rows] == list(range(1500)) and {r.text for r in rows} == {f"text {i}" for i in range(1500)}
    assert max(r.score for r in rows) <= 256


def test_features_come_to_the_driver_in_four_bytes_a_bucket():
    idf = np.linspace(1, 9, L.BUCKETS)
    texts = ["", "abc", "Zwei Wörter, 3 日本", " ".join(f"word{i}" for i in range(3000)), "a" * 70_000]
    for (at, n), text in zip(L.counted_rows(texts), texts, strict=True):
        b = L.ngram_buckets(*L.folded([text]))
        b = b[b < L.BUCKETS]
        where, times = np.unique(b, return_counts=True)
        got = L.sparse_row(at, n, idf)
        assert (got[0] == where).all() and (got[1] == times / max(len(b), 1) * idf[where]).all()
        assert len(at) + len(n) == (4 if len(text) < 70_000 else 6) * len(where)
