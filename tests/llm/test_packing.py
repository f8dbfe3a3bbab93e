import random
import zlib

import numpy as np
import pytest

from quarryline.llm.packing import best_fit_patterns, pack, place_table, plan_sequences, price_pattern, round_program, solve_configurations, tokenizer_file, word_encoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_stretches_give_the_tokenizers_ids(tokenizer, documents):
    encode = word_encoder(tokenizer_file())
    rng = random.Random(5)
    odd = ["".join(rng.choice("aB1 é́É\x1c\x1f\x85\xa0 　\n'<|endoftext|>s’ẞİΣ가가😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts = [r.text for r in documents.select("text").limit(300).collect()] + odd + ["a <|endoftext|>b<|startoftext|>", "x" * 5000]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check(docs, tokenizer, capacity):
    rows = pack(docs, tokenizer_file(), capacity, rounds=60).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for i, t in texts:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((x[0] or -1, *x[1:]) for x in want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_documents(documents, tokenizer):
    n, tokens = check(documents, tokenizer, 4096)
    assert n <= 1.02 * tokens / 4096 + 1


def test_edge_cases(edge, empty, tokenizer):
    check(edge, tokenizer, 64)
    assert pack(empty, tokenizer_file()).collect() == []


def test_pattern_is_the_best_filling():
    lengths = np.array([3, 5, 7])
    pattern = price_pattern(np.array([3.0, 5.5, 7.0]), lengths, 11)
    assert sum(l * n for l, n in pattern.items()) <= 11
    assert sum({3: 3.0, 5: 5.5, 7: 7.0}[l] * n for l, n in pattern.items()) == 11.5  # 5 + 3 + 3


def least_sequences(histogram, capacity):
    """A lower bound: pieces over half a sequence, and what cannot share with them."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = {l: n for l, n in histogram.items() if 2 * l > capacity}
        room = sum((capacity - l) * n for l, n in big.items() if l <= capacity - k)
        small = sum(l * n for l, n in histogram.items() if k <= l and 2 * l <= capacity)
        best = max(best, sum(big.values()) + max(0, -(-(small - room) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    rng = random.Random(seed)
    histogram = {l: rng.randint(1, 10 ** rng.randint(0, 5)) for l in rng.sample(range(1, 257), rng.randint(1, 200))}
    plan = plan_sequences(histogram, 256, 80)
    placed = {}
    for pattern, times in plan:
        assert times > 0 and sum(l * n for l, n in pattern.items()) <= 256
        for l, n in pattern.items():
            placed[l] = placed.get(l, 0) + n * times
    assert placed == histogram
    assert sum(t for _, t in plan) <= 1.05 * least_sequences(histogram, 256) + 5
    assert all((np.diff(r[:, 0]) > 0).all() for r in place_table(plan).values())


def test_the_program_places_nearly_all():
    """Demand of many pieces a length: the program covers it, its rounded patterns keep it, and best fit does no better."""
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6.4, 0.9, 10_000).astype(int) + 1, 4095)
    for scale, share in ((1, 0.8), (25, 0.9), (300, 0.9)):
        histogram = {int(l): int(n) * scale for l, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        solved, covered = solve_configurations(np.array(list(histogram)), np.array(list(histogram.values()), float), 4096)
        assert covered > 0.95 and all(sum(l * n for l, n in p.items()) <= 4096 for p, _ in solved)
        program, left = round_program(histogram)
        rest = best_fit_patterns(left, 4096)
        count = lambda plan: sum(t for _, t in plan)
        assert count(program) >= share * (count(program) + count(rest))
        assert count(program) + count(rest) <= count(best_fit_patterns(histogram, 4096)) * 1.0005 + 1


def test_a_length_of_many_pieces_is_ranked_in_buckets(spark, tokenizer):
    docs = spark.range(600).selectExpr("id % 40 as doc_id", "if(id % 3 = 0, 'a b', concat('word ', id)) as text")
    rows = pack(docs, tokenizer_file(), 16, bucket_rows=37).collect()
    places = {(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)}
    assert len(rows) == 600 and len(places) == sum(r.length for r in rows) and max(o for _, o in places) < 16
