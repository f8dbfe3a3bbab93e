import random

import numpy as np
import pytest

from quarryline.llm import ngram_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n, component) by comparing all pairs of distinct sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=len)
    parent = {k: k for k in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if 4 * len(a) < 3 * len(b):
                break
            inter = len(a & b)
            if 100 * inter >= 75 * (len(a) + len(b) - inter):
                parent[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            r = find(s)
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def check(df):
    got = sorted(map(tuple, J.ngram_join(df).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_documents(documents):
    check(documents)


def test_edge_cases(edge, empty):
    check(edge)
    assert J.ngram_join(empty).collect() == []


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k] = f"z{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("long_from", [3, 1000])
def test_planted_groups(spark, monkeypatch, long_from):
    """Copies, near copies around the threshold, shared passages, and a small flush so that lists cross tasks."""
    monkeypatch.setattr(J, "LONG_FROM", long_from)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 200]))]
        texts += [near(rng, base, rng.randint(0, max(1, len(base) // 20))) for _ in range(rng.choice([2, 5, 25]))]
        texts += [" ".join(base)] * 3
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 60]))]
        texts.append(" ".join(own + passage))
    texts += [f"a b c d {k}" for k in range(5)] + ["one two", "ONE two", "one", "x y z w v u t s r q"]
    # A chain: neighbours link, ends do not.
    chain = [rng.choice(vocabulary) for _ in range(64)]
    texts += [" ".join(chain[k * 4 : k * 4 + 40]) for k in range(6)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9)
    check(df)


def test_divide_skip_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 400):
        leader = np.unique(rng.integers(0, 3 * n + 2, n)).astype(np.uint64)
        candidates = []
        for _ in range(60):
            keep = leader[rng.random(len(leader)) < rng.uniform(0.7, 1)]
            candidates.append(np.unique(np.concatenate([keep, rng.integers(10**6, 10**7, rng.integers(0, n // 4 + 1)).astype(np.uint64)])))
        candidates = [c for c in candidates if len(c)]
        want = [100 * (i := len(np.intersect1d(leader, c))) >= 75 * (len(leader) + len(c) - i) for c in candidates]
        assert J.divide_skip(leader, candidates).tolist() == want


def test_histograms_bound_the_overlap():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 500)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)]))
        if len(b):
            assert J.overlap_bound(J.histogram(a), J.histogram(b)) >= len(np.intersect1d(a, b))


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in J.components(edges).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(1, n + 1)} | {b"\xf1": b"\xf0"}


def test_histograms_bound_the_overlap_from_above():
    rng = np.random.default_rng(6)
    for n, m, shared in ((5, 4, 4), (200, 200, 160), (200, 260, 190), (3000, 3000, 0), (40, 900, 40)):
        both, x, y = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64) << np.uint64(1)) for k in (shared, n - shared, m - shared))
        a, b = np.unique(np.concatenate([both, x])), np.unique(np.concatenate([both, y]))
        assert shared <= J.overlap_bound(J.histogram(a), J.histogram(b)) <= shared + 0.3 * max(n - shared, m - shared) + 4
    same = np.arange(1000, dtype=np.uint64)  # all in one cell
    assert J.overlap_bound(J.histogram(same), J.histogram(same[:700])) >= 700


def written(monkeypatch):
    """Every table that is written from now on: (name, plan, rows)."""
    seen, write = [], J.materialise

    def noted(df, name, *a, **b):
        out = write(df, name, *a, **b)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(J, "materialise", noted)
    return seen


def test_lists_shared_by_chance_are_not_gathered(spark, monkeypatch):
    """Documents that share a run of words, of which there are too few for any pair to link, take no part in the search of open lists."""
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join([*fresh(60), *(f"p{k // 2}_{i}" for i in range(20)), *fresh(60 + k % 3)]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    seen = written(monkeypatch)
    check(df)
    assert {rows for name, _, rows in seen if name == "open"} == {0}


def test_texts_are_not_shuffled_for_their_sets(documents, monkeypatch):
    """And postings are not written beside the shuffle that deals them out."""
    seen = written(monkeypatch)
    J.ngram_join(documents).collect()
    assert "index" not in [name for name, _, _ in seen]
    plans = [plan for name, plan, _ in seen if name == "grams"]
    assert len(plans) >= 2 and not any("Exchange" in p for p in plans)


def test_members_that_could_link_have_a_partner():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = rng.integers(1, 30)
        lists, n, most = np.sort(rng.integers(0, 6, k)), rng.integers(1, rng.choice([6, 40, 900]), k), rng.integers(1, 60, k)
        order = np.lexsort((n, lists))
        lists, n, most = lists[order], n[order], most[order]
        got = J.has_partner(lists, n, most)
        for i in range(k):
            for j in range(k):
                larger, smaller = max(n[i], n[j]), min(n[i], n[j])
                least = J.least_overlap(n[i], n[j]) - -(-3 * larger // 4) + 1
                if i != j and lists[i] == lists[j] and 4 * smaller >= 3 * larger and least <= min(most[i], most[j]):
                    assert got[i] and got[j]
    # One n-gram in common is too few at equal sizes, enough where the smaller has three quarters.
    assert J.has_partner(np.array([1, 1, 2, 2]), np.array([100, 100, 75, 100]), np.ones(4, int)).tolist() == [False, False, True, True]


def test_bloom_filter_holds_all_it_was_given(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(-(2**63), 2**63 - 1, 3000)
    table = J.bloom(spark.createDataFrame([(int(x),) for x in rows], "row bigint"), 1 << 16)
    assert J.in_bloom(table, rows.view(np.uint64)).all()
    assert J.in_bloom(table, rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.02
    assert not J.in_bloom(np.zeros(8, np.uint64), rows.view(np.uint64)).any()
