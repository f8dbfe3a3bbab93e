"""Exact similarity join on word n-grams: Jaccard 0.75 and connected components.

A document's set holds a 64-bit hash of every distinct run of five words (of
the whole sequence, if it has fewer).  Two documents link when their sets
have a Jaccard similarity of at least 3/4, that is, an overlap of at least
T = ceil(3 (|a| + |b|) / 7).  The join is a T-occurrence search over an
inverted index, with DivideSkip's split into short and long lists:

1. Sets.  Each document's set is reduced to a 128-bit key, so exact copies
   become one class, and to a histogram of its hashes, which bounds the
   overlap of any two sets from above.  Tasks also count n-grams that repeat
   among their own documents; the sums show which lists are long.
2. Short lists.  N-grams are ordered by list length, unknown ones first, then by
   hash.  Classes with an overlap of T share one of the first |a|/4 + 1
   n-grams of either; only these are indexed.  Index blocks are sent to a
   bucket of n-grams as arrays; each task first merges its own lists, so that
   a list sends one posting a task, however many documents hold the n-gram.
   In each bucket the lists of all tasks are merged.
3. Leaders.  Every list names a leader: the member with the fewest n-grams of
   short lists, which in a large group of near copies is one with few edits of
   its own, so that most others link to it.  Each member is verified against its
   lists' leaders: a number of pairs no larger than the index.  Connected
   components join what is verified.
4. The rest.  Lists whose members are not all connected by then are gathered
   around their smallest member, each class with its n-grams in such lists.
   There, every class outside the largest component merges its lists and counts
   how often it meets each other class.  With T and the sizes, the count of a
   pair has a least value, below which the n-grams that are not indexed cannot
   make up for it, and the histograms bound the overlap from above; only pairs of
   different components that pass both come out.
   A large gathering is split into blocks of queries and blocks of candidates.
5. Verification, for 3 and 4: pairs whose histograms bound the overlap below T
   go.  For the others, the sets are computed again from the texts and each
   leader is searched against its candidates by DivideSkip: the candidates'
   inverted lists for the leader's n-grams are split by length, the short ones
   merged, the long ones probed by binary search for candidates that can
   still reach T.

No step is capped: all pairs that could link are verified unless both are
already in one component, where a link changes nothing.  Keys, counts of long
lists and rows of pairs are all that is shuffled or broadcast.  A list is long
from ``LONG_FROM`` documents on, or from so many that not more than ``LONG_LISTS``
lists can be: all postings divided by that number.  Which lists are long decides
the order of the index, and drops nothing.

Defined results: null and empty texts have no n-grams and are linked with
nothing; texts of any length are read whole; a repeated row (same id, same text) is reported as often as it occurs;
a document with a null id links like others but gives no id to its component,
which is null if it has no other; ids need not be unique; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import discard, give_back_memory, materialise, scratch

WORDS = 5
LONG_LISTS = 1_000_000  # most entries of the broadcast table of long lists: 16 bytes each
LONG_FROM = 16  # documents that make a list long, at least
BUCKET_BYTES = 24 << 20
FLUSH_HASHES = 4 << 20
CACHE_WORDS = 300_000
GROUP_ROWS = 512
BITS, MOST_BITS = 16, 27  # of the filter of wanted rows: for each row; the power of two that is the most (16 MB)
LIST_ROWS = 1 << 17


# Sets


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words; A-Z lower-cased, split at ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s = _mixed(s + np.uint64(0x9E3779B97F4A7C15)) + h[k : k + n]
    return np.unique(_mixed(s))


def set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(s.tobytes())


def histogram(s: np.ndarray) -> bytes:
    """Hashes counted by their leading bits, two to four cells a hash: how many are beyond three in their cell, then two bits a cell."""
    bits = max(4, (2 * len(s)).bit_length())
    count = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    few = np.minimum(count, 3).astype(np.uint8).reshape(-1, 4)
    packed = few[:, 0] | few[:, 1] << 2 | few[:, 2] << 4 | few[:, 3] << 6
    return np.array([len(s) - int(few.sum(dtype=np.int64))], "<u4").tobytes() + packed.tobytes()


# The four cells of each byte.
_CELLS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8)


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these histograms share more."""
    beyond = [int(np.frombuffer(v, "<u4", 1)[0]) for v in (a, b)]
    x, y = (_CELLS[np.frombuffer(v, np.uint8, offset=4)].ravel() for v in (a, b))
    if len(x) == len(y):
        return int(np.minimum(x, y).sum(dtype=np.int64)) + min(beyond)
    x, y = (x, y) if len(x) < len(y) else (y, x)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1, dtype=np.int64)).sum(dtype=np.int64)) + sum(beyond)


def least_overlap(n_a, n_b):
    """ceil(3 (a + b) / 7)."""
    return -(-3 * (n_a + n_b) // 7)


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, str | None]]:
    for first in range(0, batch.num_rows, 256):
        yield from enumerate(batch.column(column).slice(first, 256).to_pylist(), first)


SCAN = "doc_id bigint, key binary, n int, cells binary, gram bigint, times bigint, xx bigint"


def scan_sets(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document's key, size and histogram; an n-gram that repeats in a task, and how often.

    Columns xx and digest (which may be missing) of documents are handed on.
    """
    digests = "digest" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, last = WordHashes(), {}, 0, None

        def repeated():
            every = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            every.sort()
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(every)))
            many = times > 1
            grams, times = every[starts[many]].view(np.int64), times[many]
            none = [None] * len(grams)
            return pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary()), pa.array(grams), pa.array(times, pa.int64()), pa.array(none, pa.int64()), *[pa.array(none, pa.binary())] * digests], schema=last)

        last = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("cells", pa.binary()), ("gram", pa.int64()), ("times", pa.int64()), ("xx", pa.int64()), *[("digest", pa.binary())] * digests])
        for b in batches:
            keys, sizes, cells = [], [], []
            for _, text in texts_of(b, 1):
                s = shingle_set(text, known)
                key = set_key(s) if len(s) else None
                keys.append(key)
                sizes.append(len(s))
                cells.append(histogram(s) if len(s) else None)
                if key is not None and key not in held:
                    held[key] = s
                    size += len(s)
                    if size >= FLUSH_HASHES:
                        yield repeated()
                        held, size = {}, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(cells, pa.binary()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), *b.columns[2:]], schema=last)
        yield repeated()
        held = known = None
        give_back_memory()

    return docs.mapInArrow(run, SCAN + ", digest binary" * digests)


# Short lists


def indexed_grams(s: np.ndarray, long_grams: np.ndarray, long_times: np.ndarray) -> tuple[np.ndarray, int]:
    """The first |s|/4 + 1 n-grams by (list length, hash), and how many of all have short lists."""
    most = len(s) // 4 + 1
    if not len(long_grams):
        return s[:most], len(s)
    at = np.minimum(np.searchsorted(long_grams, s), len(long_grams) - 1)
    is_long = long_grams[at] == s
    short = s[~is_long]
    if len(short) >= most:
        return short[:most], len(short)
    rest, times = s[is_long], long_times[at[is_long]]
    return np.concatenate([short, rest[np.lexsort((rest, times))][: most - len(short)]]), len(short)


def merge_lists(grams: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From postings (n-gram, member rank): each n-gram with its leader, and (n-gram, leader, other member)."""
    order = np.lexsort((members, grams))
    grams, members = grams[order], members[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    again = ~new
    again[1:] &= members[1:] != members[:-1]
    starts = np.flatnonzero(new)
    leader = np.repeat(members[starts], np.diff(np.append(starts, len(grams)))) if len(starts) else members
    return grams[starts], members[starts], np.flatnonzero(again), np.stack([grams.view(np.int64), leader, members], 1) if len(grams) else np.zeros((0, 3), np.int64)


BLOCKS = "bucket int, grams binary, members binary, keys binary, sizes binary, shorts binary, gram bigint, leader binary, leader_n int, member binary, member_n int"
_BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("members", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("shorts", pa.binary()), ("gram", pa.int64()), ("leader", pa.binary()), ("leader_n", pa.int32()), ("member", pa.binary()), ("member_n", pa.int32())])
LISTS = "gram bigint, leader binary, leader_n int, member binary, member_n int"
_LIST_SCHEMA = pa.schema(list(_BLOCK_SCHEMA)[6:])


def _list_rows(grams: np.ndarray, leaders: np.ndarray, members: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    key = pa.array(keys.tolist(), pa.binary())
    return [pa.array(grams.view(np.int64)), key.take(pa.array(leaders)), pa.array(sizes[leaders], pa.int32()), key.take(pa.array(members)), pa.array(sizes[members], pa.int32())]


def _merged(grams: np.ndarray, members: np.ndarray, keys: np.ndarray, sizes: np.ndarray, shorts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Leaders' postings of each list, and rows of LISTS for the other members.

    Members are places in keys; a list's leader has the fewest n-grams of short
    lists, then the smallest key.
    """
    by_key = np.array(sorted(range(len(keys)), key=lambda i: (shorts[i], keys[i])), np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[by_key] = np.arange(len(keys))
    first_grams, first, others, rows = merge_lists(grams, rank[members])
    rows = rows[others]
    return first_grams, by_key[first], _list_rows(rows[:, 0], by_key[rows[:, 1]], by_key[rows[:, 2]], keys, sizes)


def index_blocks(docs: DataFrame, long_grams: np.ndarray, long_times: np.ndarray, buckets: int) -> DataFrame:
    """Rows of two kinds: a task's postings for one bucket; a list's members that the task merged itself, in buckets below 0."""
    shared = docs.sparkSession.sparkContext.broadcast((long_grams, long_times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places, parts, sizes, shorts, size = WordHashes(), {}, [], [], [], 0

        def flush():
            keys, ns, few = np.array(list(places), object), np.array(sizes, np.int64), np.array(shorts, np.int64)
            grams = np.concatenate(parts)
            members = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            grams, members, rows = _merged(grams, members, keys, ns, few)
            n = len(rows[0])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(n) % (16 * buckets), pa.int32()), *[pa.nulls(n, pa.binary()) for _ in range(5)], *rows], schema=_BLOCK_SCHEMA)
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out: list[tuple] = []
            for k in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[k] : cuts[k + 1]]
                own, local = np.unique(members[at], return_inverse=True)
                out.append((int(k), grams[at].tobytes(), local.astype("<u4").tobytes(), b"".join(keys[own]), ns[own].astype("<u4").tobytes(), few[own].astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [f.type for f in _BLOCK_SCHEMA][:6], strict=True)] + [pa.nulls(len(out), f.type) for f in list(_BLOCK_SCHEMA)[6:]], schema=_BLOCK_SCHEMA)

        for b in batches:
            for _, text in texts_of(b, 0):
                s = shingle_set(text, known)
                if not len(s) or (key := set_key(s)) in places:
                    continue
                places[key] = len(parts)
                grams, few = indexed_grams(s, *shared.value)
                parts.append(grams)
                sizes.append(len(s))
                shorts.append(few)
                size += len(parts[-1])
                if size >= FLUSH_HASHES // 3:
                    yield from flush()
                    places, parts, sizes, shorts, size = {}, [], [], [], 0
        if parts:
            yield from flush()
        places = parts = known = None
        give_back_memory()

    return docs.select("text").mapInArrow(run, BLOCKS)


def merge_buckets(blocks: DataFrame) -> DataFrame:
    """Rows of LISTS: those that tasks merged themselves, and those of lists that several tasks share."""

    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.select(_LIST_SCHEMA.names).cast(_LIST_SCHEMA)
        grams, members, keys, sizes, shorts, base = [], [], [], [], [], 0
        for g, m, k, n, f in zip(*[table[c].to_pylist() for c in ("grams", "members", "keys", "sizes", "shorts")], strict=True):
            grams.append(np.frombuffer(g, np.uint64))
            members.append(np.frombuffer(m, "<u4").astype(np.int64) + base)
            keys.append(np.array([k[i : i + 16] for i in range(0, len(k), 16)], object))
            sizes.append(np.frombuffer(n, "<u4").astype(np.int64))
            shorts.append(np.frombuffer(f, "<u4").astype(np.int64))
            base += len(keys[-1])
        grams, members = np.concatenate(grams), np.concatenate(members)
        # Lists of one posting, most of them, need no merging.
        order = np.argsort(grams)
        same = np.zeros(len(grams), bool)
        same[1:] = grams[order][1:] == grams[order][:-1]
        same[:-1] |= same[1:]
        at = order[same]
        own, local = np.unique(members[at], return_inverse=True)
        # One class that several tasks met has one key, by which it is left out below.
        _, rows = _merged(grams[at], local, np.concatenate(keys)[own], np.concatenate(sizes)[own], np.concatenate(shorts)[own])[1:]
        out = pa.Table.from_arrays(rows, schema=_LIST_SCHEMA)
        return out.filter(pc.not_equal(out["leader"], out["member"]))

    return blocks.groupBy("bucket").applyInArrow(run, LISTS)


# Verification


def divide_skip(leader: np.ndarray, candidates: list[np.ndarray]) -> np.ndarray:
    """Which candidates overlap the leader enough: T-occurrence over their inverted lists.

    The lists are those of the leader's n-grams.  The longest L of them are set
    aside; the others are merged and counted; a candidate with at least T - L
    there is looked up in the long ones by binary search.
    """
    sizes = np.array([len(c) for c in candidates])
    need = least_overlap(len(leader), sizes)
    gram = np.concatenate(candidates)
    who = np.repeat(np.arange(len(candidates)), sizes)
    at = np.searchsorted(leader, gram)
    at[at == len(leader)] = 0
    hit = leader[at] == gram
    at, who = at[hit], who[hit]
    order = np.argsort(at, kind="stable")  # members of a list stay in order
    at, who = at[order], who[order]
    starts = np.searchsorted(at, np.arange(len(leader) + 1))
    length = np.diff(starts)
    longest = int(length.max(initial=0))
    least = int(need.min())
    n_long = min(len(leader), int(least / (0.01 * math.log2(longest + 1) * 10 + 1))) if longest > 8 else 0
    n_long = min(n_long, least - 1)
    by_length = np.argsort(-length, kind="stable")
    is_long = np.zeros(len(leader), bool)
    is_long[by_length[:n_long]] = True
    # Merging the short lists: one sorted run of members, counted.
    count = np.bincount(who[~is_long[at]], minlength=len(candidates))
    alive = np.flatnonzero(count >= need - n_long)
    left = n_long
    for k in by_length[:n_long]:
        if not len(alive):
            break
        members = who[starts[k] : starts[k + 1]]
        place = np.searchsorted(members, alive)
        found = place < len(members)
        found[found] = members[place[found]] == alive[found]
        count[alive] += found
        left -= 1
        alive = alive[count[alive] >= need[alive] - left]
    ok = np.zeros(len(candidates), bool)
    ok[alive] = count[alive] >= need[alive]
    return ok


def bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose histograms allow the overlap."""
    a = classes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
    b = classes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y, n_a, n_b, ca, cb = (t.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "cells_a", "cells_b"))
            keep = [overlap_bound(p, q) >= least_overlap(i, j) for p, q, i, j in zip(ca, cb, n_a, n_b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.binary()) for c in (x, y)], names=["a", "b"])
        give_back_memory()

    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b")
    return joined.mapInArrow(run, "a binary, b binary")


def _bits(rows: np.ndarray, size: int) -> np.ndarray:
    """The bits that stand for each row's hash in a filter of so many bits (a power of two): four rows of them."""
    a, b = _mixed(rows), _mixed(rows + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([a + np.uint64(i) * b for i in range(4)]) & np.uint64(size - 1)


def bloom(wanted: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the hashes in column row: words of 64 bits, gathered on executors, at most one row a word."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy().view(np.uint64), size))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = wanted.select("row").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def in_bloom(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; all that are in it."""
    at = _bits(rows, len(table) << 6)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(0)


def class_sets(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, grams) of the classes named, computed again from the text that stands for each; and the written table behind it.

    Texts are read where they lie and none is shuffled: a Bloom filter of the wanted rows, by id and
    hash of the text, says which are computed.  The few others that it lets through add sets of other classes, or
    a set once more.
    """
    wanted = keys.select("key").distinct().join(classes.select("key", "rep", "rep_xx"), "key")
    # Ids may be missing or repeat, so the text's hash is a part.
    wanted = materialise(wanted.select(F.xxhash64("rep", "rep_xx").alias("row")), "wanted")
    size = 1 << min(MOST_BITS, max(16, (BITS * wanted.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, size))
    discard(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        for b in batches:
            b = b.filter(pa.array(in_bloom(shared.value, b.column(1).to_numpy().view(np.uint64))))
            keys, out = [], []
            for _, text in texts_of(b, 0):
                s = shingle_set(text, known)
                if len(s) and (key := set_key(s)) not in done:
                    done.add(key)
                    keys.append(key)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["key", "grams"])
        known = done = None
        give_back_memory()

    grams = materialise(docs.select("text", F.xxhash64("doc_id", "xx").alias("row")).mapInArrow(sets, "key binary, grams binary"), "grams")
    # A row that repeats, in several tasks, comes once.
    return grams.groupBy("key").agg(F.first("grams").alias("grams")), grams


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; a is the one searched for."""
    likely = materialise(bounded_pairs(pairs, classes), "likely")
    one, grams = class_sets(likely.select(F.explode(F.array("a", "b")).alias("key")), classes, docs)
    # A leader with many candidates is split into groups of about GROUP_ROWS.
    groups = likely.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_groups"))
    left = groups.join(one.withColumnRenamed("key", "a"), "a").select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("part"), F.col("grams").alias("own"))
    right = likely.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_groups")).cast("int").alias("g"), F.col("b"))
    right = right.join(one.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("of"), F.col("g").alias("g"), F.col("b").alias("b"), F.col("grams").alias("grams"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if a.num_rows and b.num_rows:
            leader = np.frombuffer(a["own"][0].as_py(), np.uint64)
            names = b["b"].to_pylist()
            ok = divide_skip(leader, [np.frombuffer(g, np.uint64) for g in b["grams"].to_pylist()])
            out_b = [x for x, k in zip(names, ok, strict=True) if k]
            out_a = [a["leader"][0].as_py()] * len(out_b)
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    found = left.groupBy("leader", "part").cogroup(right.groupBy("of", "g")).applyInArrow(search, "a binary, b binary")
    return materialise(found, "links", frees=(likely, grams))


# Components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for the nodes of edges (a, b).

    Large-star and small-star rounds, each written to the shared folder, until
    all edges are stars around the smallest node.
    """
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialise(small.where("u <> v").distinct(), "edges")
        if new.exceptAll(current).isEmpty() and current.exceptAll(new).isEmpty():
            return materialise(new.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "roots", frees=(new, current))
        discard(current)
        current = new


# The rest


def meetings(queries: tuple, candidates: tuple, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (query, candidate) of pairs of different components that meet often enough, and how often; by query.

    Both sides hold sizes, components and n-grams (flat, with a length each).
    The lists of many queries are merged at a time, by counting equal pairs.
    """
    (m, r, g, lengths), (n, roots, grams, own) = queries, candidates
    who = np.repeat(np.arange(len(n)), own)
    order = np.argsort(grams, kind="stable")
    grams, who = grams[order], who[order]
    first, last = np.searchsorted(grams, g), np.searchsorted(grams, g, "right")
    asks = np.repeat(np.arange(len(m)), lengths)
    work = np.cumsum(last - first)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(m):
        # As many whole queries as stay within ``most`` list entries, one at least.
        done = work[ends[a - 1] - 1] if a and ends[a - 1] else 0
        b = max(a + 1, int(np.searchsorted(work[ends - 1], done + most, "right")))
        x, y = ends[a - 1] if a else 0, ends[b - 1]
        count = last[x:y] - first[x:y]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[x:y], count)
        code, times = np.unique(np.repeat(asks[x:y], count) * len(n) + who[at], return_counts=True)
        i, j = code // len(n), code % len(n)
        larger, smaller = np.maximum(m[i], n[j]), np.minimum(m[i], n[j])
        # The class whose index ends first has ceil(3/4 n) - 1 n-grams beyond it.
        enough = (times >= least_overlap(m[i], n[j]) - -(-3 * larger // 4) + 1) & (4 * smaller >= 3 * larger)
        i, j, times = i[enough], j[enough], times[enough]
        other = r[i] != roots[j]
        yield i[other], j[other], times[other]
        a = b


def open_pairs(named: DataFrame, classes: DataFrame, query_rows: int = 2048, candidate_rows: int = 16384) -> DataFrame:
    """Pairs (a, b) worth verifying, from rows (gram, key, n, root, head) of open lists.

    Small gatherings share a task with others, which adds no pairs: a class
    brings all its n-grams of open lists, so a pair's count is the same anywhere,
    and its histogram, which most pairs that do not link fail by.
    """
    here = named.select("head", "key", "n", "root").distinct()
    grams = named.groupBy(F.col("key").alias("_key")).agg(F.collect_list("gram").alias("grams"))
    by_root = here.groupBy("head", "root").agg(F.count("*").alias("c"))
    size = by_root.groupBy(F.col("head").alias("_head")).agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.sum("c").alias("all"), F.max("c").alias("top"))
    size = size.select("_head", "most", F.ceil((F.col("all") - F.col("top")) / query_rows).cast("int").alias("q"), F.ceil(F.col("all") / candidate_rows).cast("int").alias("c"))
    sized = materialise(here.join(size, F.col("head") == F.col("_head")).where("q > 0").select("head", "key", "n", "root", "q", "c", (F.col("root") != F.col("most")).alias("asks")), "sized")
    shares = max(1, math.ceil(sized.count() / query_rows))
    small = (F.col("q") == 1) & (F.col("c") == 1)
    place = F.when(small, F.pmod(F.xxhash64("head"), F.lit(shares)).cast("string")).otherwise(F.hex("head"))
    rows = sized.groupBy(place.alias("h"), "key").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max("asks").alias("asks"), F.max("q").alias("q"), F.max("c").alias("c"))
    grams = grams.join(classes.select(F.col("key").alias("_own"), "cells"), F.col("_key") == F.col("_own")).drop("_own")
    rows = materialise(rows.join(grams, F.col("key") == F.col("_key")).drop("_key"), "gathered", frees=(sized,))
    part = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("asks").select(F.col("h").alias("h1"), part("q", 1).alias("i1"), every("c").alias("j1"), F.col("key").alias("key1"), F.col("n").alias("n1"), F.col("root").alias("root1"), F.col("grams").alias("grams1"), F.col("cells").alias("cells1"))
    right = rows.select("h", every("q").alias("i"), part("c", 2).alias("j"), "key", "n", "root", "grams", "cells")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            roots = pa.chunked_array([*a["root1"].chunks, *b["root"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            sides = []
            for t, end, r in ((a, "1", roots[: a.num_rows]), (b, "", roots[a.num_rows :])):
                g = t["grams" + end].combine_chunks()
                sides.append((t["n" + end].to_numpy().astype(np.int64), r, g.flatten().to_numpy(), pc.list_value_length(g).to_numpy().astype(np.int64)))
            x, y = a["key1"].to_pylist(), b["key"].to_pylist()
            cells = a["cells1"].to_pylist(), b["cells"].to_pylist()
            for i, j, _ in meetings(*sides):
                need = least_overlap(sides[0][0][i], sides[1][0][j]).tolist()
                likely = [overlap_bound(cells[0][p], cells[1][q]) >= m for p, q, m in zip(i.tolist(), j.tolist(), need, strict=True)]
                i, j = i[likely], j[likely]
                found += [(min(x[p], y[q]), max(x[p], y[q])) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        return pa.table({"a": pa.array([p for p, _ in found], pa.binary()), "b": pa.array([q for _, q in found], pa.binary())})

    return left.groupBy("h1", "i1", "j1").cogroup(right.groupBy("h", "i", "j")).applyInArrow(search, "a binary, b binary")


# The join


def classes_of(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, n, root, grams): a row for each class in a list, with the n-grams of its lists."""
    sides = [lists.select("gram", F.col(k).alias("key"), F.col(f"{k}_n").alias("n")) for k in ("leader", "member")]
    held = sides[0].unionByName(sides[1]).groupBy("key").agg(F.first("n").alias("n"), F.collect_set("gram").alias("grams"))
    return held.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "n", F.coalesce("root", "key").alias("root"), "grams")


def has_partner(lists: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which members have another member in their list that they could link with, given how many n-grams they may share at most.

    Rows are sorted by list and size.  Classes of sizes s <= l that link meet, in the index, at least
    ceil(3 (s + l) / 7) - ceil(3 l / 4) + 1 times (see ``meetings``).  So 28 times the n-grams that either may share
    is at least 12 s - 9 l + 7, which leaves a span of sizes above a class and one below.
    """
    step = int(n.max(initial=0)) * 2 + 2
    code = np.cumsum(np.append(False, lists[1:] != lists[:-1])) * step if len(lists) else lists
    at = code + n
    found = np.zeros(len(lists), bool)
    above = np.maximum(n, -(-(12 * n + 7 - 28 * most) // 9)), 4 * n // 3
    below = -(-3 * n // 4), np.minimum(n, (28 * most - 7 + 9 * n) // 12)
    for low, high in (above, below):
        there = np.searchsorted(at, code + np.maximum(high, 0), "right") - np.searchsorted(at, code + low)
        found |= there - ((low <= n) & (n <= high)) > 0
    return found


def open_members(held: DataFrame) -> DataFrame:
    """(gram, key, n, root, head) of the members of lists that hold several components, but for members that can
    link with none of their list by the sizes and by how many n-grams of lists each has.

    Most lists are n-grams that unrelated documents share by chance, and go.  Two classes of different
    components that can link are both left in every list that both are in.
    """
    rows = held.select(F.explode("grams").alias("gram"), "key", "n", F.size("grams").alias("most"), "root").repartition("gram").sortWithinPartitions("gram", "n")
    schema = pa.schema([("gram", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("root", pa.binary()), ("head", pa.binary())])

    def judged(t: pa.Table) -> list[pa.RecordBatch]:
        gram = t["gram"].to_numpy()
        t = t.filter(pa.array(has_partner(gram, t["n"].to_numpy().astype(np.int64), t["most"].to_numpy().astype(np.int64))))
        gram = t["gram"].to_numpy()
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(gram)))
        root = t["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        several = np.repeat(np.maximum.reduceat(root, starts) > np.minimum.reduceat(root, starts), lengths) if len(gram) else np.zeros(0, bool)
        # The smallest key of each list.
        order = pc.rank(t["key"], tiebreaker="dense").to_numpy()
        least = np.repeat(np.minimum.reduceat(order, starts), lengths) if len(gram) else order
        place = np.zeros(len(gram) + 1, np.int64)
        place[order] = np.arange(len(gram))
        t = t.append_column("head", t["key"].take(pa.array(place[least]))).filter(pa.array(several))
        return t.select(schema.names).cast(schema).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, enough = [], 0, LIST_ROWS
        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size < enough:
                continue
            t = pa.Table.from_batches(waiting).combine_chunks()
            # The last list may go on.
            gram = t["gram"].to_numpy()
            whole = int(np.searchsorted(gram, gram[-1]))
            if whole:
                yield from judged(t.slice(0, whole))
            waiting, size = t.slice(whole).to_batches(), t.num_rows - whole
            enough = max(LIST_ROWS, 2 * size)
        if size:
            yield from judged(pa.Table.from_batches(waiting).combine_chunks())
        waiting = None
        give_back_memory()

    return rows.mapInArrow(run, "gram bigint, key binary, n int, root binary, head binary")


def without(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) that were not tried in either order."""
    return pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


def links(docs: DataFrame, digests: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with key and n, and digest of their text if asked for; classes; components of the links between classes)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("xx"))
    scan = materialise(scan_sets(docs.withColumn("digest", text_digest()) if digests else docs), "sets")
    rows = scan.where("n is not null").select("doc_id", "key", "n", *["digest"] * digests)
    # Of a class, the row with the smallest id, if any has one, stands for all.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xx"))
    classes = scan.where("key is not null").groupBy("key").agg(first.alias("r"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    classes = materialise(classes.select("key", F.col("r.doc_id").alias("rep"), F.col("r.xx").alias("rep_xx"), "n", "cells"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    sums = materialise(scan.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")), "sums")
    long_from = max(LONG_FROM, math.ceil((sums.agg(F.sum("times")).first()[0] or 0) / LONG_LISTS))
    long = sums.where(F.col("times") >= long_from).toArrow()
    long_grams, long_times = long["gram"].to_numpy().view(np.uint64), long["times"].to_numpy()
    order = np.argsort(long_grams)
    buckets = max(1, math.ceil(total / 4 * 14 / BUCKET_BYTES))

    # The postings, most of what is written, lie on disk once: as the shuffle by bucket.
    lists = materialise(merge_buckets(index_blocks(docs, long_grams[order], long_times[order], buckets)), "lists", frees=(sums,))

    fits = (F.least("leader_n", "member_n") * 4) >= (F.greatest("leader_n", "member_n") * 3)
    led = materialise(lists.where(fits).select(F.col("leader").alias("a"), F.col("member").alias("b")).distinct(), "led")
    found = verified(led, classes, docs)
    roots = components(found)

    # Lists that still hold several components.
    left = materialise(open_members(classes_of(lists, roots)), "open", frees=(lists,))
    # What went leaves classes with fewer n-grams, of which more can link with none.
    again = left.groupBy("key").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_list("gram").alias("grams"))
    left = materialise(open_members(again), "open", frees=(left,))
    more = verified(without(open_pairs(left, classes).distinct(), led), classes, docs)
    discard(left, led)
    return rows, classes, components(found.unionByName(more)) if not more.isEmpty() else roots


def text_digest() -> Column:
    return F.unhex(F.md5("text"))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the text) of every document but one of each component.

    That one has the smallest id, or no id if none has, and of those the smallest digest.
    Documents without a word are in no component.
    """
    rows, classes, roots = links(docs, digests=True)
    named = classes.select("key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    placed = rows.join(named, "key").select("root", "doc_id", "digest")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("kept"))
    lost = placed.join(kept, "root").where("not (doc_id <=> kept.doc_id and digest = kept.digest)")
    return lost.select("doc_id", "digest").distinct()


def ngram_join(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id.  Reads doc_id and text."""
    with scratch(docs.sparkSession):
        rows, classes, roots = links(docs)
        named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        ids = named.join(smallest, "root").select("key", "component_id")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return materialise(rows.join(ids, "key", "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id")), "joined", keep=True)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
