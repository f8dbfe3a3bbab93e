import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import lm_score as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            c.update(words(t))
            c["\0end"] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = [*words(t), "\0end"]
        out.append((i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def check(df, monkeypatch=None):
    got = sorted(M.lm_score(df).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    want = sorted(brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]), key=lambda r: (r[0] or -1, r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    return got


def test_documents(documents):
    got = check(documents.repartition(5))
    held = [r for r in got if r.held_out]
    # Letters per token differ between the two, but both are probabilities of the text.
    assert sum(r.score for r in held) < 0


def test_edge_cases(edge, empty):
    check(edge)
    assert M.lm_score(empty).collect() == []


def test_without_training_documents(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame([(i, "some text") for i in ids], "doc_id bigint, text string")
    rows = M.lm_score(df).collect()
    assert {(r.base_score, r.train_tokens, r.n_known) for r in rows} == {(0.0, 0, 0)} and len({r.score for r in rows}) == 1


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 5, 50)
    classes[:5] = range(5)
    classes = np.append(classes, 5)
    inner = np.log(1 / np.bincount(classes)[classes]).astype(np.float32)
    w = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in M.initial_weights(6).items()}
    return M.AttentionModel(classes, inner, w)


def naive(model, ids):
    """Scores a text token by token, each in the window that scores it."""
    w, s = {k: x.astype(float) for k, x in model.weights.items()}, np.append(ids, len(model.classes) - 1)
    target = model.classes[s]
    read = np.concatenate([[model.n_classes], target[:-1]])
    total, stride = 0.0, M.WINDOW - M.OVERLAP
    for t in range(len(s)):
        k = 0 if t < M.WINDOW else -(-(t - M.WINDOW + 1) // stride)
        first = k * stride
        x = w["e"][read[first : t + 1]] + w["p"][: t + 1 - first]
        q, key, v = x[-1] @ w["wq"] / math.sqrt(M.DIM), x @ w["wk"], x @ w["wv"]
        a = np.exp(key @ q)
        z = (x[-1] + a @ v / a.sum()) @ w["u"] + w["b"]
        total += z[target[t]] - np.log(np.exp(z).sum()) + model.inner[s[t]]
    return total


def test_windows_score_each_token_once(model):
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50, n) for n in (0, 1, 30, 31, 32, 33, 54, 55, 56, 57, 200, 777)]
    got = model.log_probability(docs)
    assert np.allclose(got, [naive(model, d) for d in docs], rtol=1e-4)


def test_probabilities_sum_to_one(model):
    """Over the next id, after a given beginning."""
    start = np.array([3, 7, 11, 2])
    # P(start + x, then anything) = P(start + x + end) / P(end | start + x): use single-step scores instead.
    read = np.full((6, M.WINDOW), 0)
    read[:, :5] = [model.n_classes, *model.classes[start]]
    target = np.zeros_like(read)
    target[:, 4] = range(6)
    p = np.exp(model.window_scores(read, target)[:, 4])
    inner = np.bincount(model.classes, np.exp(model.inner))
    assert np.isclose(p.sum(), 1, atol=1e-5) and np.allclose(inner, 1, atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in M.initial_weights(7).items()}
    c, t = rng.integers(0, 8, (3, M.WINDOW)), rng.integers(0, 7, (3, M.WINDOW))
    live = (rng.random((3, M.WINDOW)) < 0.8).astype(np.float64)
    _, g = M.gradients(w, c, t, live)
    for k in w:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            want = (M.gradients(up, c, t, live)[0] - M.gradients(down, c, t, live)[0]) / 2e-5
            assert math.isclose(g[k][at], want, rel_tol=2e-3, abs_tol=1e-6)


def test_training_beats_frequencies():
    """A pattern that frequencies cannot see is learnt."""
    docs = [np.tile([0, 1, 2, 3], 40) for _ in range(40)]
    classes = np.array([0, 1, 2, 3, 4])
    data = M.training_windows(docs, classes, 5)
    w = M.train(M.initial_weights(5), *data, 200, 0.02)
    assert M.gradients(w, *data)[0] < 0.3


def test_context_at_window_edges_and_number_of_classes():
    """Every token beyond the beginning has eight tokens of context at least; frequent ids have 44 classes."""
    first, own, rows = M.windows(np.array([0]), np.array([500]))
    assert own[0] == 0 and own[1:].min() >= 8 and int((rows - own).sum()) == 500
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, 400) for _ in range(40)]
    classes = M.cluster_ids(docs, 300, rng.random(300) < 0.5)
    assert classes.max() + 1 == 44 + 3


def context_model(docs, size=60):
    rng = np.random.default_rng(4)
    counts = np.bincount(np.concatenate([*docs, np.full(len(docs), size)]), minlength=size + 1)
    classes = M.cluster_counted(counts, M.neighbour_counts(docs, counts), rng.random(size) < 0.5, 6)
    units, n_units = M.units_of(classes, counts)
    n_classes = int(classes.max()) + 1
    pairs, tails = np.zeros((n_units + 1, n_units)), np.zeros((n_classes + 1, size + 1))
    for d in docs:
        unit, before = n_units, n_classes
        for i in [*d, size]:
            pairs[unit, units[i]] += 1
            tails[before, i] += 1
            unit, before = units[i], classes[i]
    w = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in M.initial_weights(n_classes, n_units).items()}
    return M.AttentionModel(classes, M.fit_inner(classes, units, n_units, pairs, tails, counts), w)


@pytest.mark.parametrize("head", [0, 9, 500])
def test_factors_within_a_class_sum_to_one(head, monkeypatch):
    monkeypatch.setattr(M, "HEAD", head)
    rng = np.random.default_rng(6)
    m = context_model([rng.zipf(1.4, 300) % 50 for _ in range(20)])
    every = np.arange(len(m.classes))
    for before in range(len(m.inner.class_of)):
        p = np.bincount(m.classes, np.exp(m.inner.log_probability(np.full(len(every), before), every)), m.n_classes)
        assert np.allclose(p[np.unique(m.classes)], 1, atol=1e-4)


def test_scores_with_context_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(M, "HEAD", 9)
    rng = np.random.default_rng(7)
    m = context_model([rng.zipf(1.4, 300) % 50 for _ in range(20)])
    w, stride = {k: x.astype(float) for k, x in m.weights.items()}, M.WINDOW - M.OVERLAP

    def plain(ids):
        s = np.append(ids, len(m.classes) - 1)
        read = [len(w["e"]) - 1, *m.inner.units[s[:-1]]]
        total = 0.0
        for t in range(len(s)):
            first = stride * (0 if t < M.WINDOW else -(-(t - M.WINDOW + 1) // stride))
            x = w["e"][read[first : t + 1]] + w["p"][: t + 1 - first]
            a = np.exp((x @ w["wk"]) @ (x[-1] @ w["wq"]) / math.sqrt(M.DIM))
            z = (x[-1] + a @ (x @ w["wv"]) / a.sum()) @ w["u"] + w["b"]
            total += z[m.classes[s[t]]] - np.log(np.exp(z).sum()) + m.inner.pairs[read[t], m.inner.units[s[t]]] + m.inner.tails[m.inner.class_of[read[t]], s[t]]
        return total

    docs = [rng.integers(0, 50, n) for n in (0, 1, 31, 32, 33, 56, 57, 300)]
    assert np.allclose(m.log_probability(docs), [plain(d) for d in docs], rtol=1e-4)


def test_a_pass_reads_every_place_once_and_steps_grow_with_the_input(monkeypatch):
    monkeypatch.setattr(M, "SLICE_IDS", 500)
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 5, n) for n in (0, 1, 31, 32, 33, 3000, 700, 5)] * 9
    classes, steps, places = np.array([0, 1, 2, 3, 4, 5]), [], []

    class Counted(M.Adam):
        def step(self, read, targets, live, rate):
            steps.append(len(read))
            places.append(int(live.sum()))

    for some in (docs, docs * 3):
        steps.clear(), places.clear()
        done = M.pass_over(Counted(M.initial_weights(6)), some, classes, classes, 0.01)
        assert sum(places) == sum(len(d) + 1 for d in some) and sum(steps) == done
        assert len(steps) >= done / M.BATCH_WINDOWS


def test_neighbours_are_counted(monkeypatch):
    monkeypatch.setattr(M, "NEIGHBOURS", 2)
    docs = [np.array([0, 1, 0, 1, 0]), np.array([2])]
    counts = np.array([3, 2, 1, 2])
    got = M.neighbour_counts(docs, counts)
    # 0 1 0 1 0 end 2 end; the frequent ones are 0 and 1.
    assert got.tolist() == [[0, 2, 0, 0, 2, 1], [2, 0, 0, 2, 0, 0], [0, 0, 1, 0, 0, 1], [1, 0, 1, 0, 0, 1]]


def test_held_out_documents_are_less_surprising_than_under_a_bigram(documents):
    """Bits a subword id, against a bigram interpolated with its unigram; the best of several weights for it."""
    from quarryline.llm.packing import tokenizer_file, word_encoder

    encode = word_encoder(tokenizer_file())
    rows = [(r.doc_id, [*np.frombuffer(encode((r.text or "").translate(LOWER)), "<u4").tolist(), -1]) for r in documents.collect()]
    pairs, ones, befores = Counter(), Counter(), Counter()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    for i, s in rows:
        if i not in held:
            pairs.update(zip([-1, *s], s, strict=False))
            ones.update(s)
            befores.update([-1, *s[:-1]])
    n, v = sum(ones.values()), len(ones) + 1

    def bigram(k):
        return sum(math.log10((pairs[a, b] + k * (ones[b] + 0.1) / (n + 0.1 * v)) / (befores[a] + k)) for i, s in rows if i in held for a, b in zip([-1, *s], s, strict=False))

    got = sum(r.score for r in M.lm_score(documents.repartition(5)).where("held_out").collect())
    assert got > max(map(bigram, (1, 4, 16, 64, 256)))


def test_ids_of_large_vocabularies_are_held_whole():
    from quarryline.llm.lm_score import id_kind

    for size in (1, 1 << 16, (1 << 16) + 1, 1 << 20):
        assert int(np.array([size - 1]).astype(id_kind(size))[0]) == size - 1
    assert id_kind(1 << 16) == "<u2"


def test_results_do_not_depend_on_the_number_of_buckets(documents, monkeypatch):
    want = sorted(map(tuple, M.lm_score(documents).select("doc_id", "n_known", "train_tokens", "base_score").collect()))
    monkeypatch.setattr(M, "BUCKET_BYTES", 1000)
    got = sorted(map(tuple, M.lm_score(documents).select("doc_id", "n_known", "train_tokens", "base_score").collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 * abs(b[3]) for a, b in zip(got, want, strict=True))


def test_places_that_only_serve_as_context_are_not_scored(model, monkeypatch):
    """The scores computed are as many as windows have places beyond those that the window before has scored."""
    made, plain = [], M.AttentionModel.window_scores

    def counted(self, *a):
        out = plain(self, *a)
        made.append(out.size)
        return out

    monkeypatch.setattr(M.AttentionModel, "window_scores", counted)
    model.log_probability([np.zeros(499, np.int64), np.zeros(9, np.int64)])
    n = len(M.windows(np.array([0]), np.array([500]))[0])
    assert sum(made) == 2 * M.WINDOW + (n - 1) * (M.WINDOW - M.OVERLAP)


@pytest.mark.parametrize("times", [1, 12])
def test_scores_and_gradients_of_large_weights_stay_exact(model, times):
    """Numbers beyond what exp() holds are shifted; both ways give what double precision gives."""
    w = {k: x * (times if k in "eub" else 1) for k, x in model.weights.items()}
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, n) for n in (0, 31, 90)]
    large = M.AttentionModel(model.classes, model.inner, w)
    want = [naive(large, d) for d in docs]
    assert np.allclose(large.log_probability(docs), want, rtol=1e-4)
    read, targets, live = M.training_windows(docs, model.classes, model.n_classes, overlap=0)
    one, g = M.gradients(w, read, targets, live)
    two, h = M.gradients({k: x.astype(np.float64) for k, x in w.items()}, read, targets, live)
    assert math.isclose(one, two, rel_tol=1e-4)
    assert all(np.abs(g[k] - h[k]).max() <= 1e-3 * max(np.abs(h[k]).max(), 1e-3) for k in g)


ODD_WORDS = ["a", "ß", "\u00e9", "e\u0301", "a\u0301b", "éa", "naïve,", "÷", "×a", "..", "a.", "a.b", "a...$$$", "it's", "x1", "ﬁ", "é", "Ã", "À", "ª", "a\x1cb", "日本", "<|endoftext|>", "a" * 64, "a" * 65, "ing" * 400, "é" * 33, "-a", "a-", "\x00", "😀ok"]


def test_ids_of_words_are_the_tokenizers():
    from quarryline.llm.merges import ids_of_words, merges_of
    from quarryline.llm.packing import StretchIds, piece_ids, tokenizer_file

    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz" * 4 + "ßäöüéèñçøÿ" + ".,!$" + "É'7½")
    drawn = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 20, 3000)]
    path = tokenizer_file()
    tokenizer = piece_ids(path).tokenizer
    for words in ([], ODD_WORDS, drawn):
        want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        for merges in (merges_of(path), None):
            ids, lengths = ids_of_words([w.encode() for w in words], StretchIds(piece_ids(path)), merges, "<u2")
            assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_packed_documents_are_whole(spark, monkeypatch):
    """Words, how often they occur, and ids of every document, whatever is packed at once."""
    from quarryline.llm.packing import piece_ids, tokenizer_file

    texts = [None, "", "  ", "A b a", " ".join(ODD_WORDS), "b " * 3000, "Ünder É", "b c b", None]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "doc_id bigint, text string, learn boolean").coalesce(1)
    tokenizer = piece_ids(tokenizer_file()).tokenizer
    for size, chunk, cache in ((1 << 19, 1 << 20, 1 << 20), (1, 1, 1), (40, 100, 3)):
        monkeypatch.setattr(M, "STRETCH_BYTES", size)
        monkeypatch.setattr(M, "CHUNK_IDS", chunk)
        monkeypatch.setattr(M, "CACHE_WORDS", cache)
        seen = {}
        for r in M.pack_documents(df, tokenizer_file(), "<u2").collect():
            words, times = M._expand(r.words, "<u4"), M._expand(r.times, "<u4")
            ids, hashes = M._expand(r.ids, "<u2"), np.frombuffer(r.vocabulary, np.uint64)
            n, n_ids, train = np.frombuffer(r.n_distinct, "<u4"), np.frombuffer(r.n_ids, "<u4"), np.frombuffer(r.train, bool)
            total = Counter()
            for k, doc in enumerate(r.doc_ids):
                at, to = n[:k].sum(), n[: k + 1].sum()
                own = dict(zip(hashes[np.cumsum(words[at:to])].tolist(), times[at:to].tolist(), strict=True))
                seen[doc] = (own, int(np.frombuffer(r.n_words, "<u4")[k]), ids[n_ids[:k].sum() : n_ids[: k + 1].sum()].tolist(), bool(train[k]))
                total.update(own if train[k] else {})
            assert np.frombuffer(r.counts, "<u4").tolist() == [total[h] for h in hashes.tolist()]
        import xxhash

        for i, t in enumerate(texts):
            split = (t or "").encode().lower().split()
            ids = [x for w in split for x in tokenizer.encode(w.decode(), add_special_tokens=False).ids]
            assert seen[i] == (Counter(map(xxhash.xxh64_intdigest, split)), len(split), ids, i % 2 == 0)


def test_a_stretch_looks_up_each_distinct_word_once():
    """White space is that of bytes.split(): no other separator and no empty word."""
    from quarryline.llm.packing import tokenizer_file

    asked = []

    class Counted(M.Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    texts = [b"", b" \t\n\x0b\x0c\r ", b" b  A a\r\nB a", b"a", "a\x1cb a b   \x85É é a".encode(), b"\x00 b\x0ba\x0c\x00"]
    known = Counted(tokenizer_file(), "<u2")
    for some in (texts, texts[2:4], [], texts[:2]):
        asked.clear()
        split = [t.lower().split() for t in some]
        n_words, own, place = M._split(some)
        assert n_words.tolist() == list(map(len, split)) and [own[k] for k in place] == [w for s in split for w in s]
        if some:
            packed = M._pack_stretch(known, list(range(len(some))), some, [True] * len(some))
            assert sorted(asked) == sorted({w for s in split for w in s}) and packed.n_words.tolist() == list(map(len, split))


def test_words_of_latin_letters_do_not_go_to_the_tokenizer_whatever_their_case():
    from quarryline.llm.merges import ids_of_words, merges_of
    from quarryline.llm.packing import StretchIds, piece_ids, tokenizer_file

    asked = []

    class Counted(StretchIds):
        def ids(self, stretch):
            asked.append(stretch)
            return super().ids(stretch)

    path = tokenizer_file()
    words = [chr(c) + "lan" + m for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7) for m in ("", ".", "!?" * 4 + ".", "!?" * 5, "!" * 11)] + ["éÀÞa", "×a", "Ÿa", "ÉÉ"]
    ids, lengths = ids_of_words([w.encode() for w in words], Counted(piece_ids(path)), merges_of(path), "<u2")
    want = [piece_ids(path).tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert asked == ["×a", "Ÿa"]


def test_merges_of_vocabularies_beyond_16_bits(tmp_path):
    import json

    from quarryline.llm.merges import ids_of_words, merges_of
    from quarryline.llm.packing import StretchIds, piece_ids, tokenizer_file

    path = tokenizer_file()
    with open(path) as f:
        tokenizer = json.load(f)
    tokenizer["model"]["vocab"]["\x00unused"] = 70_000
    (tmp_path / "wide.json").write_text(json.dumps(tokenizer))
    wide, narrow = merges_of.__wrapped__(str(tmp_path / "wide.json")), merges_of(path)
    assert (wide.key.itemsize, narrow.key.itemsize) == (8, 4)
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéü"), n)).encode() for n in rng.integers(1, 30, 2000)]
    (a, n), (b, m) = (ids_of_words(words, StretchIds(piece_ids(path)), x, "<u4") for x in (wide, narrow))
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


@pytest.mark.parametrize("times", [1, 40])
def test_gradients_do_not_depend_on_the_parts_of_a_batch(model, monkeypatch, times):
    """Nor on whether all of a part, or one window in it, has numbers beyond what exp() holds."""
    w = {k: x.copy() for k, x in model.weights.items()}
    w["e"][0] *= times
    rng = np.random.default_rng(10)
    read, targets, live = M.training_windows([rng.integers(0, 50, n) for n in (90, 31, 0, 200, 7)], model.classes, model.n_classes, overlap=0)
    want, whole = M.gradients({k: x.astype(np.float64) for k, x in w.items()}, read, targets, live)
    for part in (1, 3, 4, 1000):
        monkeypatch.setattr(M, "PART_WINDOWS", part)
        loss, g = M.gradients(w, read, targets, live)
        assert math.isclose(loss, want, rel_tol=1e-4)
        assert all(np.abs(g[k] - whole[k]).max() <= 1e-3 * max(np.abs(whole[k]).max(), 1e-3) for k in g)
