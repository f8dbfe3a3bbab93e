"""Packing documents into as few training sequences as possible.

Each document becomes token ids (plus an end id); only one longer than a
sequence is cut, into pieces that fill sequences.  Which pieces share a
sequence is the one-dimensional cutting-stock problem, and only the histogram
of piece lengths matters for it:

* the configuration linear program has a variable for each way to fill a
  sequence and a constraint for each length.  Multiplicative weights solve it:
  a length's price starts from its share of a sequence (or the step function of it
  that bounds the number of sequences best) and has a weight, which grows with
  the share of its demand that is not yet covered.  Each round prices the
  fillings of all capacities (an unbounded knapsack by dynamic programming, over
  a part of the lengths that changes from round to round) and takes, for every
  length in turn, the filling that holds it and is worth most.  Fillings worth
  less than the best by more than a small slack are not bought; the others are bought
  until a share of the demand of a length they hold is used up.  Rounds go on
  until ``COVER`` of all tokens are covered or three rounds in a row buy nothing.
  If the plan then needs more sequences than the dual bound allows by ``GAP``, the
  program is solved again at a slower pace, and the better plan is kept;
* the amounts are rounded up, largest first, as long as pieces last, and what is
  left over is filled by best fit over the histogram, each pattern repeated
  as often as its lengths last.

The histogram has at most as many entries as a sequence has tokens, and the
plan a few patterns for each, whatever the number of documents; both are
all that reaches the driver.  Pieces find their places by their rank among the
pieces of their length.  Ranks come from counts of (length, bucket): a length has a
bucket for every ``BUCKET_ROWS`` pieces, so one that a third of all pieces share
is ranked in many tasks.

Defined results: a null text is empty and a document of one token; texts of any
length are read whole; repeated rows are documents of their own; a null id is kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import give_back_memory, materialise

CAPACITY = 4096
ROUNDS = 60
# (share of a length's demand that one round may cover, rate of the weights, slack against the best filling's worth,
# whether prices start anew from what is left).
# The first suits histograms that can be packed nearly without waste, where weights decide between fillings that waste
# alike; the second, slower, others.
PACES = ((0.5, 0.001, 0.0005, False), (0.1, 0.3, 0.02, True))
GAP = 0.005  # above the dual bound: from there on the second pace is tried
COVER = 0.98
PRICED = 400  # lengths that a round's dynamic program fills with
BUCKET_ROWS = 1 << 20
END_ID = 1
CACHE_WORDS = 300_000
CACHE_PIECES = 300_000
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MARKS = ".,;:!?%$*#()"
NOT_SPACES = re.compile("[\x1c-\x1f]")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# Tokens


class PieceIds(dict):
    """Little-endian 32-bit ids of pieces of text that the tokenizer takes apart from their neighbours.

    Lower-case letters go straight to the tokenizer's merges, written as it
    writes bytes: its normaliser and splitter would not change them.
    """

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.merges = tokenizer, tokenizer.model.tokenize
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])})

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha() and piece.islower():
            found = [t.id for t in self.merges(piece)]
        elif LETTERS.fullmatch(piece):
            found = [t.id for t in self.merges(piece.translate(self.spelling))]
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class StretchIds(dict):
    """The same for whole stretches of text between white space.

    The tokenizer drops white space, lower-cases, and parts letters from
    punctuation.  So a word with punctuation behind it, the usual case, is made
    of the ids of its lower-case letters and of the punctuation.
    """

    def __init__(self, pieces: PieceIds) -> None:
        self.pieces = pieces

    def ids(self, stretch: str) -> bytes:
        word = stretch.rstrip(MARKS)
        if not word.isalpha() or not (word.isascii() or WORD.fullmatch(word)):
            return self.pieces[stretch]
        ids = self.pieces[word.lower()]
        return ids + self.pieces[stretch[len(word) :]] if len(word) < len(stretch) else ids

    def __missing__(self, stretch: str) -> bytes:
        ids = self.ids(stretch)
        if len(stretch) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[stretch] = ids
        return ids


@lru_cache(1)
def piece_ids(path: str) -> PieceIds:
    """Kept for the life of a worker process."""
    from tokenizers import Tokenizer

    return PieceIds(Tokenizer.from_file(path))


@lru_cache(1)
def word_encoder(path: str) -> Callable[[str], bytes]:
    """Text to the bytes of its ids; kept for the life of a worker process, as its caches are."""
    pieces = piece_ids(path)
    known = StretchIds(pieces)

    def encode(text: str) -> bytes:
        # str.split() also splits at these four, which the tokenizer keeps.
        if NOT_SPACES.search(text):
            return pieces[text]
        return b"".join(map(known.__getitem__, text.split()))

    return encode


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, encoder: Callable[[str], Callable[[str], bytes]] = word_encoder) -> DataFrame:
    """Pieces of columns doc_id and text: id, number, start, length and CRC-32 of the ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back_memory()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


# The plan: patterns {length: times} and how often each is used


def filling_values(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """What the best multiset of lengths in each capacity is worth: an unbounded knapsack by dynamic programming."""
    best, room = np.zeros(capacity + 1), np.empty(len(lengths))
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]  # a token left empty
        if k := fit[c]:
            best[c] = max(best[c], np.add(best[c - lengths[:k]], prices[:k], out=room[:k]).max())
    return best


def fill(capacity: int, values: np.ndarray, prices: np.ndarray, lengths: np.ndarray) -> dict[int, int]:
    """A filling of the capacity, {place in lengths: times}: each time the length that leaves most; a price of -inf is out of stock."""
    pattern: dict[int, int] = {}
    while capacity > 0 and (k := int(np.searchsorted(lengths, capacity, "right"))):
        worth = prices[:k] + values[capacity - lengths[:k]]
        i = int(worth.argmax())
        if not worth[i] > 0:
            break
        pattern[i] = pattern.get(i, 0) + 1
        capacity -= int(lengths[i])
    return pattern


def price_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths worth most that fits."""
    pattern = fill(capacity, filling_values(prices, lengths, capacity), prices, lengths)
    return {int(lengths[i]): n for i, n in pattern.items()}


def first_prices(lengths: np.ndarray, demand: np.ndarray, capacity: int, extra: float = 0.0) -> tuple[np.ndarray, float]:
    """Prices under which no filling is worth more than a sequence, and how many sequences that proves necessary.

    Of the dual-feasible step functions, the one that proves most: lengths below a bound are free, those above the
    capacity less the bound cost a sequence, others their share of one.  A share of ``extra`` is the plain share of
    a sequence, so that free lengths are better than empty places.
    """
    bounds = np.unique(np.concatenate([[0], lengths[2 * lengths <= capacity], capacity - lengths[2 * lengths > capacity] + 1]))
    bounds = bounds[2 * bounds <= capacity]
    pieces, tokens = (np.concatenate([[0.0], np.cumsum(x)]) for x in (demand, demand * lengths))
    low, high = np.searchsorted(lengths, bounds), np.searchsorted(lengths, capacity - bounds, "right")
    proved = pieces[-1] - pieces[high] + (tokens[high] - tokens[low]) / capacity
    bound = bounds[int(proved.argmax())]
    price = np.where(lengths < bound, 0.0, np.where(lengths > capacity - bound, 1.0, lengths / capacity))
    return price * (1 - extra) + lengths / capacity * extra, float(proved.max())


def solve_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, pace: tuple[float, float, float, bool] = PACES[0], seed: int = 0) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns with fractional amounts that cover no more than the demand, by multiplicative weights, and the share of all tokens they cover."""
    (step, rate, slack, anew), rng = pace, np.random.default_rng(seed)
    left, weight = demand.astype(float), np.ones(len(lengths))
    total, covered, idle = float(lengths @ demand), 0.0, 0
    amounts: dict[tuple, float] = {}
    for _ in range(rounds):
        live = np.flatnonzero(left > 1e-6 * demand)
        if not len(live) or covered >= COVER or idle == 3:
            break
        price = first_prices(lengths, left if anew else demand, capacity, slack / 5)[0] * weight
        some = live if len(live) <= PRICED else np.sort(rng.choice(live, PRICED, replace=False))
        own, offered = lengths[some], price[some]
        values = filling_values(offered, own, capacity)
        place = {int(j): i for i, j in enumerate(some)}
        quota = np.minimum(left, step * demand)
        least = 0.02 * quota  # what is left of a quota below this would be bought in crumbs
        for i in live[::-1].tolist():
            if quota[i] <= least[i]:
                continue
            pattern = {int(some[k]): n for k, n in fill(capacity - int(lengths[i]), values, offered, own).items()}
            pattern[i] = pattern.get(i, 0) + 1
            if sum(price[j] * n for j, n in pattern.items()) < (1 - slack) * values[capacity]:
                continue
            amount = min(quota[j] / n for j, n in pattern.items())
            for j, n in pattern.items():
                quota[j] -= amount * n
                left[j] -= amount * n
                if quota[j] <= least[j] and j in place:
                    offered[place[j]] = -np.inf
            key = tuple(sorted((int(lengths[j]), n) for j, n in pattern.items()))
            amounts[key] = amounts.get(key, 0.0) + amount
        before, covered = covered, 1 - float(lengths @ left) / total
        idle = idle + 1 if covered - before < 1e-4 else 0
        weight = np.exp(rate * (left / demand - (1 - covered)))
    return [(dict(k), a) for k, a in amounts.items()], covered


def best_fit_patterns(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, then the longest that still fits; each pattern as often as its lengths last."""
    lengths = sorted(l for l, n in left.items() if n > 0)
    left = {l: left[l] for l in lengths}
    out = []
    while lengths:
        room, pattern = capacity, {}
        top = len(lengths)
        while room > 0:
            i = bisect.bisect_right(lengths, room, 0, top) - 1
            if i < 0:
                break
            l = lengths[i]
            n = min(room // l, left[l] - pattern.get(l, 0))
            if n > 0:
                pattern[l] = pattern.get(l, 0) + n
                room -= n * l
            top = i
        times = min(left[l] // n for l, n in pattern.items())
        out.append((pattern, times))
        for l, n in pattern.items():
            left[l] -= n * times
            if not left[l]:
                lengths.pop(bisect.bisect_left(lengths, l))
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole numbers of uses that place exactly the histogram's pieces: those of the program, then best fit."""
    program, left = round_program(histogram, capacity, rounds)
    return program + best_fit_patterns(left, capacity)


def round_program(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """The program's patterns with whole numbers of uses, and the pieces that are left."""
    pieces = {l: n for l, n in histogram.items() if n > 0}
    full = [({capacity: 1}, pieces.pop(capacity))] if capacity in pieces else []
    if not pieces:
        return full, {}
    lengths = np.array(sorted(pieces), np.int64)
    demand = np.array([pieces[int(l)] for l in lengths], float)
    needed, best = first_prices(lengths, demand, capacity)[1], None
    for pace in PACES:
        plan, left = [], dict(pieces)
        solved, _ = solve_configurations(lengths, demand, capacity, rounds, pace)
        for pattern, amount in sorted(solved, key=lambda x: -x[1]):
            times = min([int(np.ceil(amount - 1e-9)), *(left[l] // n for l, n in pattern.items())])
            if times > 0:
                plan.append((pattern, times))
                for l, n in pattern.items():
                    left[l] -= n * times
        count = sum(t for _, t in plan + best_fit_patterns(left, capacity))
        if best is None or count < best[0]:
            best = count, plan, left
        if count <= np.ceil(needed * (1 + GAP)):
            break
    return full + best[1], best[2]


def place_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a sequence, first sequence, offset), ranks rising."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for l in sorted(pattern, reverse=True):
            n = pattern[l]
            rank = ranks.get(l, 0)
            rows.setdefault(l, []).append((rank, n, first, offset))
            ranks[l] = rank + n * times
            offset += n * l
        first += times
    return {l: np.array(r, np.int64) for l, r in rows.items()}


# Putting pieces in their places


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, rounds: int = ROUNDS, bucket_rows: int = BUCKET_ROWS, end_id: int = END_ID, encoder: Callable[[str], Callable[[str], bytes]] = word_encoder) -> DataFrame:
    """A row for each piece: where it is cut from and where it is placed."""
    pieces = materialise(tokenise_pieces(docs, tokenizer_path, capacity, end_id, encoder).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # At most a row a length, then a row a length and a row for each ``bucket_rows`` pieces, reach the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = [-(-histogram.get(l, 1) // bucket_rows) for l in range(capacity + 1)]
    of_length = F.split(F.lit(",".join(map(str, buckets))), ",").cast("array<int>")
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.get(of_length, F.col("length").cast("int"))).cast("int"))
    before = np.zeros((capacity + 1, max(buckets)), np.int64)
    if max(buckets) > 1:
        ranked: dict[int, int] = {}
        for r in pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n")).orderBy("length", "_bucket").collect():
            before[r["length"], r["_bucket"]] = ranked.get(r["length"], 0)
            ranked[r["length"]] = ranked.get(r["length"], 0) + r["n"]
    table = place_table(plan_sequences(histogram, capacity, rounds))
    shared = docs.sparkSession.sparkContext.broadcast((before, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = shared.value
        for b in batches:
            length, bucket, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_bucket", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            rank = rank + before[length, bucket]
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                places, l = table[int(length[rows[0]])], int(length[rows[0]])
                hit = places[np.searchsorted(places[:, 0], rank[rows], "right") - 1]
                into = rank[rows] - hit[:, 0]
                sequence[rows] = hit[:, 2] + into // hit[:, 1]
                offset[rows] = hit[:, 3] + into % hit[:, 1] * l
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "_row")
    ranked = pieces.withColumn("_rank", (F.row_number().over(order) - 1).cast("bigint"))
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_file())
