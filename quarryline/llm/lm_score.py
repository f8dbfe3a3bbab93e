"""Scores of texts under language models learnt from part of the corpus.

The score is the log10 probability of a text under a causal self-attention model
in numpy.  Its tokens are the subword ids of a public tokenizer and an end.  Each
id belongs to one of a few dozen classes, and to a unit: frequent ids are units
of their own, the other ids of a class share one.  The model predicts the class of
the next token by attention over the embedded units of a window, the unit within
its class given the unit before, and the id within its unit given the class before:

    P(text) = product over tokens of P(class | window) * P(unit | class, unit before) * P(id | unit, class before)

Windows overlap: each starts where its last ``OVERLAP`` positions repeat those
of the one before, which only serve as context, so every token is scored once
with a context of at least that many tokens (or from the text's beginning).
Windows of many texts are scored in one batch of masked attention.

What is learnt, all of it from all training documents: id frequencies, which name
the frequent ids; the neighbours of every id, by which ids are clustered to classes;
the counts behind the two inner factors, smoothed towards those with less context;
and the weights of the attention.  These start from ``STEPS`` steps on the
``SAMPLE_DOCS`` training documents with the smallest hash of their id.  Then each of
``ROUNDS`` rounds takes its share of the training documents, each document in one
round: every task goes on from the round's weights with a step for each
``BATCH_WINDOWS`` of its windows, and the results are averaged by number of windows.
The tables of counts are bounded by the vocabulary's size, not by the input.

Beside it, the base score is that of a smoothed unigram model of words.  Word
counts are exact over all training documents and never gathered in one place:
documents are packed into chunks with a vocabulary each, vocabularies are
summed by bucket of the word's hash, and every chunk gets back the sums of its
own words.

Words are compared by 64-bit hashes.

Defined results: null and empty texts have one token, the end; a document with a
null id is neither held out nor learnt from; repeated rows are scored alike, and
each counts if it is learnt from; without training documents, N is 0, the base
score is 0 and the model is uniform over classes, and over the ids of each; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import give_back_memory, materialise
from quarryline.llm.language_id import remainder
from quarryline.llm.merges import ids_of_words, merges_of
from quarryline.llm.packing import StretchIds, piece_ids, tokenizer_file, word_encoder

CHUNK_IDS = 2 << 20  # ids of a chunk, which is one row of a few megabytes
STRETCH_BYTES = 2 << 20  # of texts that are packed at once
CACHE_WORDS = 350_000  # words that a task keeps ids for
LEAST_BUCKETS = 48
BUCKET_BYTES = 16 << 20  # of the chunks' vocabularies, gathered in one task by bucket of the word's hash
WINDOW, OVERLAP = 32, 8
DIM, CLUSTERS = 16, 44
HEAD = 512  # most frequent ids, units of their own
NEIGHBOURS = 32  # most frequent ids, told apart as neighbours when ids are clustered
SAMPLE_DOCS = 400
STEPS, BATCH_WINDOWS = 300, 256
ROUNDS, RATES = 2, (0.004, 0.001)
SLICE_IDS = 1 << 17  # whose windows are shuffled together in a round
SCORE_WINDOWS = PART_WINDOWS = 128  # as many as stay in a core's cache
SMOOTHING = 0.1
TOWARDS = {"unit by class": 20.0, "unit by unit": 8.0, "id by class": 30.0}  # counts that the factor with less context is worth


# Packing documents: word indices, subword ids, vocabularies


class Words(defaultdict):
    """Numbers of lower-case words as they are asked for, with the subword ids and the hash of each once ``learn`` has run.

    The tokenizer splits at white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str, kind: str) -> None:
        super().__init__(count().__next__)
        self.path = path
        self.ids, self.lengths, self.hashes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def learn(self) -> None:
        """Takes the words met since the last time, whose numbers are already given."""
        from xxhash import xxh64_intdigest

        if len(self) == len(self.lengths):
            return
        new = list(islice(reversed(self), len(self) - len(self.lengths)))[::-1]
        ids, lengths = ids_of_words(new, StretchIds(piece_ids(self.path)), merges_of(self.path), self.ids.dtype.str)
        self.ids, self.lengths = np.append(self.ids, ids), np.append(self.lengths, lengths)
        self.hashes = np.append(self.hashes, np.fromiter(map(xxh64_intdigest, new), np.uint64, len(new)))

    def ids_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after the other, and how many each has."""
        lengths = self.lengths[words]
        ends = np.cumsum(lengths)
        shift = (np.cumsum(self.lengths) - self.lengths)[words] - (ends - lengths)
        return self.ids[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def id_kind(vocabulary_size: int) -> str:
    """The narrowest type that holds every id."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


PACKED = "chunk string, doc_ids array<bigint>, train binary, n_words binary, n_distinct binary, words binary, times binary, n_ids binary, ids binary, vocabulary binary, counts binary, id_counts binary"
_PACKED_SCHEMA = pa.schema([("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("train", "n_words", "n_distinct", "words", "times", "n_ids", "ids", "vocabulary", "counts", "id_counts")]])


def _squeeze(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _expand(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


@dataclass
class Stretch:
    """Some documents of a chunk: word numbers, distinct and ascending in each, how often each occurs there, and ids."""

    doc_ids: list
    train: np.ndarray
    n_words: np.ndarray
    n_distinct: np.ndarray
    words: np.ndarray
    times: np.ndarray
    n_ids: np.ndarray
    ids: np.ndarray


def _split(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """How many words each text has, the distinct words in lower case, and the number of each word among them."""
    texts = [t.strip() for t in texts]
    filled = np.array([t != b"" for t in texts], bool)
    ends = np.cumsum([0, *(len(t) for t in texts if t)], dtype=np.int64)
    lower = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(texts).lower()))
    split = pc.ascii_split_whitespace(lower)
    n_words = np.zeros(len(texts), np.int64)
    n_words[filled] = pc.list_value_length(split).to_numpy()
    found = split.flatten().dictionary_encode()
    # White space parts the words, so none holds a line feed.
    ended = pc.binary_join_element_wise(found.dictionary, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    own = ended.buffers()[2].to_pybytes().split(b"\n")[: len(ended)] if len(ended) else []
    return n_words, own, found.indices.to_numpy()


def _pack_stretch(known: Words, doc_ids: list, texts: list[bytes], train: list[bool]) -> Stretch:
    n_words, own, place = _split(texts)
    words = np.fromiter(map(known.__getitem__, own), np.int64, len(own))[place]
    known.learn()
    doc = np.repeat(np.arange(len(texts)), n_words)
    ids, lengths = known.ids_of(words)
    pairs = np.sort(doc << 32 | words)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    times = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    n_ids = np.bincount(doc, lengths, len(texts))
    return Stretch(doc_ids, np.array(train, bool), n_words.astype("<u4"), np.bincount(pairs >> 32, minlength=len(texts)).astype("<u4"), pairs & 0xFFFFFFFF, times.astype("<u4"), n_ids.astype("<u4"), ids)


def _chunk_row(name: str, known: Words, stretches: list[Stretch]) -> list:
    """The values of PACKED."""
    train, n_words, n, words, times, n_ids, ids = (np.concatenate([getattr(s, c) for s in stretches]) for c in ("train", "n_words", "n_distinct", "words", "times", "n_ids", "ids"))
    learnt = np.repeat(train, n)
    counts = np.bincount(words[learnt], times[learnt], len(known)).astype("<u4")
    seen = np.zeros(len(known), bool)
    seen[words] = True
    # Words of this chunk, renumbered without gaps; the order stays.
    used = np.flatnonzero(seen)
    number = (np.cumsum(seen) - 1)[words]
    steps = np.diff(number, prepend=0)
    starts = (np.cumsum(n, dtype=np.int64) - n)[n > 0]
    steps[starts] = number[starts]
    id_counts = np.bincount(ids[np.repeat(train, n_ids)], minlength=1)
    own = np.flatnonzero(id_counts)
    return [
        name, [d for s in stretches for d in s.doc_ids], train.tobytes(), n_words.tobytes(), n.tobytes(), _squeeze(steps.astype("<u4")), _squeeze(times),
        n_ids.tobytes(), _squeeze(ids), known.hashes[used].tobytes(), counts[used].tobytes(), np.stack([own, id_counts[own]]).astype("<u4").tobytes(),
    ]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[bool]]]:
    """Documents in lists of ``STRETCH_BYTES`` of text, or little more than their last document beyond it."""
    docs, texts, train, held = [], [], [], 0
    for b in batches:
        for first in range(0, b.num_rows, 256):
            s = b.slice(first, 256)
            for doc, text, learn in zip(*[s.column(c).to_pylist() for c in ("doc_id", "text", "learn")], strict=True):
                texts.append((text or "").encode())
                docs.append(doc)
                train.append(bool(learn))
                held += len(texts[-1])
                if held >= STRETCH_BYTES:
                    yield docs, texts, train
                    docs, texts, train, held = [], [], [], 0
    if docs:
        yield docs, texts, train


def pack_documents(docs: DataFrame, tokenizer_path: str, kind: str) -> DataFrame:
    """A row a chunk of documents, ids as ``kind``; columns doc_id, text and learn are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        known, rows, held = Words(tokenizer_path, kind), [], 0

        def flush():
            nonlocal rows, held, made
            out = _chunk_row(f"{part}-{made}", known, rows)
            rows, held, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, _PACKED_SCHEMA, strict=True)], schema=_PACKED_SCHEMA)

        for some in _stretches(batches):
            rows.append(_pack_stretch(known, *some))
            held += len(rows[-1].ids)
            if held >= CHUNK_IDS:
                yield flush()
            if len(known) >= CACHE_WORDS:
                if rows:
                    yield flush()
                known = Words(tokenizer_path, kind)
        if rows:
            yield flush()
        known = some = None
        give_back_memory()

    return docs.select("doc_id", "text", "learn").mapInArrow(run, PACKED)


# Word counts


def bucket_count(packed: DataFrame) -> int:
    """As many buckets as keep the vocabularies of one within ``BUCKET_BYTES`` on average, whatever the input's size."""
    held = packed.agg(F.sum(F.octet_length("vocabulary").cast("bigint"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-held // BUCKET_BYTES))


def _bucket_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def count_words(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows (chunk, bucket, sums of the chunk's words there) and rows (null, bucket, totals)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, v, c in zip(*[b.column(k).to_pylist() for k in ("chunk", "vocabulary", "counts")], strict=True):
                hashes, counts = np.frombuffer(v, np.uint64), np.frombuffer(c, "<u4")
                order, cuts = _bucket_order(hashes, buckets)
                at = [order[cuts[k] : cuts[k + 1]] for k in range(buckets)]
                some = [k for k in range(buckets) if len(at[k])]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.string()), pa.array([hashes[at[k]].tobytes() for k in some], pa.binary()), pa.array([counts[at[k]].tobytes() for k in some], pa.binary())], names=["bucket", "chunk", "hashes", "counts"])
        give_back_memory()

    def merge(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in t["counts"].to_pylist()]).astype(np.int64)
        cuts = np.cumsum([0, *map(len, hashes)])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)
        back = [total[at[a:b]].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        stats = np.array([(total > 0).sum(), total.sum()], "<i8").tobytes()
        bucket = t["bucket"][0].as_py()
        return pa.table({"chunk": pa.array([*t["chunk"].to_pylist(), None], pa.string()), "bucket": pa.array([bucket] * (len(back) + 1), pa.int32()), "sums": pa.array([*back, stats], pa.binary())})

    rows = packed.select("chunk", "vocabulary", "counts").mapInArrow(split, "bucket int, chunk string, hashes binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(merge, "chunk string, bucket int, sums binary")


# The attention model


@dataclass
class Inner:
    """The factors within a class: the unit of each id, the class of each unit (the last is a beginning), and
    log P(unit | class, unit before) and log P(id | unit, class before) by what comes before."""

    units: np.ndarray
    class_of: np.ndarray
    pairs: np.ndarray
    tails: np.ndarray

    def log_probability(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.pairs[before, self.units[ids]] + self.tails[self.class_of[before], ids]


def fit_inner(classes: np.ndarray, units: np.ndarray, n_units: int, pairs: np.ndarray, tails: np.ndarray, counts: np.ndarray) -> Inner:
    """From how often units follow units (or a beginning), ids follow classes, and ids occur."""
    n_classes = int(classes.max()) + 1
    class_of = np.full(n_units + 1, n_classes)
    class_of[units] = classes
    of = class_of[:-1]

    def by(group, m, n):
        return np.stack([np.bincount(group, row, n) for row in m])

    def towards(m, group, n, less, worth):
        return (m + worth * less) / (by(group, m, n)[:, group] + worth)

    counts = counts + SMOOTHING
    in_unit = counts / np.bincount(units, counts, n_units)[units]
    per_unit = np.bincount(units, counts, n_units)
    # A unit without ids (and a class of none) has no share; it never is a target.
    base = per_unit / np.maximum(np.bincount(of, per_unit, n_classes + 1), 1e-300)[of]
    by_class = np.zeros((n_classes + 1, n_units))
    np.add.at(by_class, class_of, pairs)
    less = towards(by_class, of, n_classes + 1, base, TOWARDS["unit by class"])
    full = towards(pairs, of, n_classes + 1, less[class_of], TOWARDS["unit by unit"])
    ids = np.empty(tails.shape, np.float32)
    for k, row in enumerate(tails):
        ids[k] = np.log((row + TOWARDS["id by class"] * in_unit) / (np.bincount(units, row, n_units)[units] + TOWARDS["id by class"]))
    return Inner(units, class_of, np.log(np.maximum(full, 1e-300)).astype(np.float32), ids)


@dataclass
class AttentionModel:
    """Class of each id (the last is the end), log P(id | class) or the factors with context, and the weights."""

    classes: np.ndarray
    inner: np.ndarray | Inner
    weights: dict[str, np.ndarray]

    @property
    def n_classes(self) -> int:
        return len(self.weights["b"])

    def log_probability(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each sequence of ids, its end included."""
        end = len(self.classes) - 1
        lengths = np.array([len(d) + 1 for d in documents])
        targets = np.concatenate([x for d in documents for x in (d, [end])]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        classes = self.classes[targets]
        # What is read before each target: the unit before it, or a beginning.
        context = isinstance(self.inner, Inner)
        read = self.inner.units[targets] if context else classes
        before = np.concatenate([[0], read[:-1]])
        before[starts] = len(self.weights["e"]) - 1
        score = (self.inner.log_probability(before, targets) if context else self.inner[targets]).astype(np.float64)
        first, own, rows = windows(starts, lengths)
        # Windows alike in their context go together: places that only serve as context are read, but not scored.
        for context in np.unique(own).tolist():
            alike = np.flatnonzero(own == context)
            for a in range(0, len(alike), SCORE_WINDOWS):
                some = alike[a : a + SCORE_WINDOWS]
                at = np.minimum(first[some, None] + np.arange(WINDOW), len(before) - 1)
                scored = at[:, context:]
                live = np.arange(context, WINDOW) < rows[some, None]
                score[scored[live]] += self.window_scores(before[at], classes[scored], context)[live]
        return np.add.reduceat(score, starts)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The query of each unit and of each place, on which keys are the embedded units themselves."""
        w = self.weights
        form = w["wq"] @ w["wk"].T * np.float32(1 / np.sqrt(DIM))
        return w["e"] @ form, w["p"] @ form

    def window_scores(self, read: np.ndarray, targets: np.ndarray, own: int = 0) -> np.ndarray:
        """log P(target class) at the places from ``own`` on of windows of units read."""
        if not hasattr(self, "_table"):
            self._table = self.table()
        w = self.weights
        x = w["e"].take(read, 0)
        x += w["p"]
        q = self._table[0].take(read[:, own:], 0)
        q += self._table[1][own:]
        s, total = _attend(q, np.ascontiguousarray(x.transpose(0, 2, 1)), CAUSAL[own:])
        mixed = np.matmul(s, x)
        mixed *= (1 / total).reshape(*q.shape[:2], 1)
        h = np.matmul(mixed, w["wv"])
        h += x[:, own:]
        targets = targets.ravel()
        z = np.matmul(h, w["u"]).reshape(-1, len(w["b"]))
        wanted = z.ravel().take(np.arange(0, z.size, z.shape[1]) + targets) + w["b"].take(targets)
        _, total, _, shift = _soften(h, w["u"], w["b"], z)
        return (wanted - np.log(total) - shift).reshape(q.shape[:2])


# Sums of exp() within these lost nothing to what single precision holds; others are taken again with a shift.
LEAST, MOST = 1e-17, 1e17
STEADY = 40  # of what is added to all rows alike


def _steady(total: np.ndarray) -> bool:
    return bool(total.min() > LEAST and total.max() < MOST)  # not so if any is nan


def _attend(q: np.ndarray, keys: np.ndarray, causal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(q keys) up to a factor for each row, 0 where a place may not look, and the sum of each row."""
    ones = np.ones(WINDOW, q.dtype)
    s = np.matmul(q, keys)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        np.exp(s, out=s)
        s *= causal
        total = s.reshape(-1, WINDOW) @ ones
    if not _steady(total):
        s = np.matmul(q, keys)
        np.copyto(s, -np.inf, where=causal == 0)
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        total = s.reshape(-1, WINDOW) @ ones
    return s, total


def _soften(h: np.ndarray, u: np.ndarray, b: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """exp(z) in place, where z is h u; the sum of each row times what each column is worth; that worth; the logarithm of what
    the sum leaves out of that of exp(z + b)."""
    high = b.max()
    if high - b.min() < STEADY:
        worth = np.exp(b - high)
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            np.exp(z, out=z)
            total = z @ worth
        if _steady(total):
            return z, total, worth, high
        np.matmul(h, u, out=z.reshape(*h.shape[:2], -1))
    z += b
    shift = z.max(1)
    z -= shift[:, None]
    np.exp(z, out=z)
    worth = np.ones_like(b)
    return z, z @ worth, worth, shift


CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def windows(starts: np.ndarray, lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: first place, places that only serve as context, places within its text."""
    stride = WINDOW - overlap
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return starts[doc] + k * stride, np.where(k > 0, overlap, 0), np.minimum(WINDOW, lengths[doc] - k * stride)


def initial_weights(n_classes: int, n_units: int | None = None, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
    read = n_classes if n_units is None else n_units
    return {"e": draw(read + 1, DIM, by=0.3), "p": draw(WINDOW, DIM, by=0.1), "wq": draw(DIM, DIM, by=0.25), "wk": draw(DIM, DIM, by=0.25), "wv": draw(DIM, DIM, by=0.25), "u": draw(DIM, n_classes, by=0.1), "b": np.zeros(n_classes, np.float32)}


def gradients(w: dict[str, np.ndarray], read: np.ndarray, targets: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the live places of windows of units read, and its gradients.

    Queries and keys only meet in products, so the embedded units are the keys, and queries go through both
    matrices at once; values are mixed before they go through theirs.  What divides a row is never
    applied to its weights or probabilities, but to the few numbers that are multiplied with them.
    Windows go in parts that stay in a core's cache, whose sums are added.
    """
    scale = np.float32(1 / np.sqrt(DIM))
    form = w["wq"] @ w["wk"].T * scale
    back = {"form": np.ascontiguousarray(form.T), "wv": np.ascontiguousarray(w["wv"].T)}
    n, loss = max(1, int(live.sum())), 0.0
    df, g = np.zeros_like(form), {k: np.zeros_like(x) for k, x in w.items() if k not in ("wq", "wk")}
    for a in range(0, len(read), PART_WINDOWS):
        some = slice(a, a + PART_WINDOWS)
        loss += _add_gradients(w, form, back, read[some], targets[some], live[some], n, df, g)
    df *= scale
    return loss, g | {"wq": df @ w["wk"], "wk": df.T @ w["wq"]}


def _add_gradients(w: dict[str, np.ndarray], form: np.ndarray, back: dict[str, np.ndarray], read: np.ndarray, targets: np.ndarray, live: np.ndarray, n: int, df: np.ndarray, g: dict[str, np.ndarray]) -> float:
    """Adds what some windows have of the gradients to ``df`` (that of ``form``) and ``g``; their share of the loss."""
    x = w["e"].take(read, 0)
    x += w["p"]
    kind = x.dtype
    q = np.matmul(x, form)
    keys = np.ones((len(x), DIM + 1, WINDOW), kind)  # the last row meets what is taken from a whole row
    keys[:, :DIM] = x.transpose(0, 2, 1)
    a, total = _attend(q, keys[:, :DIM], CAUSAL)
    part = (1 / total).reshape(*read.shape, 1)
    mixed = np.matmul(a, x)
    mixed *= part
    h = np.matmul(mixed, w["wv"])
    h += x
    p = np.matmul(h, w["u"])
    rows, total, worth, _ = _soften(h, w["u"], w["b"], p.reshape(-1, p.shape[2]))
    counted, targets = live.ravel(), targets.ravel()
    at = np.arange(0, p.size, p.shape[2]) + targets
    here, due = rows.ravel().take(at), total / worth.take(targets)
    loss = float(-(np.log(np.maximum(here / due, 1e-12)) * counted).sum() / n)
    p.reshape(-1)[at] = here - due
    share = (counted / (n * total)).astype(kind)
    dh = np.matmul(p, np.ascontiguousarray((w["u"] * worth).T))
    dh *= share.reshape(part.shape)
    h *= share.reshape(part.shape)
    d = np.empty((*read.shape, DIM + 1), kind)
    inner = np.matmul(dh, back["wv"])
    inner *= part
    d[..., :DIM] = inner
    d[..., DIM] = ((inner * mixed).reshape(-1, DIM) @ np.full(DIM, -1, kind)).reshape(read.shape)
    ds = np.matmul(d, keys)
    ds *= a
    dq = np.matmul(ds, x)
    dx = np.matmul(a.transpose(0, 2, 1), inner)
    dx += np.matmul(ds.transpose(0, 2, 1), q)
    dx += np.matmul(dq, back["form"])
    dx += dh
    df += _over_windows(x, dq)
    _add_by_unit(g["e"], read, dx)
    g["p"] += dx.sum(0)
    g["wv"] += _over_windows(mixed, dh)
    g["u"] += _over_windows(h, p) * worth
    g["b"] += share @ rows * worth
    return loss


def _over_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product over all places; by a few windows, as such narrow ones are slow in one piece."""
    cut, out = len(a) // 4 * 4, np.zeros((a.shape[2], b.shape[2]), b.dtype)
    for x, y in ((a[:cut].reshape(-1, 4 * WINDOW, a.shape[2]), b[:cut].reshape(-1, 4 * WINDOW, b.shape[2])), (a[cut:], b[cut:])):
        if len(x):
            out += np.matmul(x.transpose(0, 2, 1), y).sum(0)
    return out


def _add_by_unit(out: np.ndarray, read: np.ndarray, x: np.ndarray) -> None:
    """Adds x to the rows of the units read; two components go as one complex number."""
    kind = np.result_type(x.dtype, np.complex64)
    at = read.reshape(-1, 1) * (DIM // 2) + np.arange(DIM // 2)
    np.add.at(out.reshape(-1).view(kind), at.ravel(), x.reshape(-1).view(kind))


class Adam:
    """Weights and the moments of their gradients, each in one array; ``w`` are its parts."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.flat, self.t = np.concatenate([x.ravel() for x in w.values()]), 0
        parts = np.split(self.flat, np.cumsum([x.size for x in w.values()])[:-1])
        self.w = {k: part.reshape(x.shape) for (k, x), part in zip(w.items(), parts, strict=True)}
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, read: np.ndarray, targets: np.ndarray, live: np.ndarray, rate: float) -> None:
        self.t += 1
        _, by_name = gradients(self.w, read, targets, live)
        g = np.concatenate([by_name[k].ravel() for k in self.w])
        self.m += 0.1 * (g - self.m)
        self.s += 0.01 * (g**2 - self.s)
        self.flat -= (rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8)).astype(self.flat.dtype)


def train(w: dict[str, np.ndarray], read: np.ndarray, targets: np.ndarray, live: np.ndarray, steps: int, rate: float, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on random batches of windows, with a rate that falls to zero."""
    adam, rng = Adam(w), np.random.default_rng(seed)
    for t in range(1, steps + 1):
        at = rng.integers(0, len(read), min(BATCH_WINDOWS, len(read)))
        adam.step(read[at], targets[at], live[at], rate * (1 - t / (steps + 1)))
    return adam.w


def pass_over(adam: Adam, documents: list[np.ndarray], classes: np.ndarray, units: np.ndarray, rate: float, seed: int = 7) -> int:
    """A step for every batch of windows of these documents, each place in one window; the number of windows."""
    rng, done = np.random.default_rng(seed), 0
    cuts = np.searchsorted(np.cumsum([len(d) + 1 for d in documents]), np.arange(SLICE_IDS, sum(map(len, documents)) + len(documents), SLICE_IDS))
    for a, b in zip([0, *cuts], [*cuts, len(documents)], strict=True):
        if a < b:
            read, targets, live = training_windows(documents[a:b], classes, len(adam.w["e"]) - 1, units, 0)
            for at in np.array_split(rng.permutation(len(read)), -(-len(read) // BATCH_WINDOWS)):
                adam.step(read[at], targets[at], live[at], rate)
            done += len(read)
    return done


def with_end(documents: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, each document's followed by the end; where documents start, and their lengths."""
    lengths = np.array([len(d) + 1 for d in documents])
    ids = np.concatenate([x for d in documents for x in (d, [end])]).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths


def training_windows(documents: list[np.ndarray], classes: np.ndarray, beginning: int, units: np.ndarray | None = None, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (units read, target classes, places that count) of some documents; without units, classes are read."""
    ids, starts, lengths = with_end(documents, len(classes) - 1)
    target = classes[ids]
    before = np.concatenate([[0], (target if units is None else units[ids])[:-1]])
    before[starts] = beginning
    first, own, rows = windows(starts, lengths, overlap)
    at = np.minimum(first[:, None] + np.arange(WINDOW), len(before) - 1)
    place = np.arange(WINDOW)
    return before[at], target[at], ((place < rows[:, None]) & (place >= own[:, None])).astype(np.float32)


def neighbour_counts(documents: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """How often each id (the last is the end) comes after and before the most frequent ones, and after and before any other."""
    n, width = len(counts), NEIGHBOURS + 1
    top = np.argsort(-counts, kind="stable")[:NEIGHBOURS]
    place = np.full(n, NEIGHBOURS)
    place[top] = np.arange(len(top))
    ids, _, _ = with_end(documents, n - 1)
    out = np.zeros(2 * n * width, np.int64)
    near = place[ids]
    named = np.flatnonzero(near < NEIGHBOURS)
    every = np.bincount(ids, minlength=n)
    for own, by, first, edge in ((1, named[named < len(ids) - 1], 0, ids[0]), (-1, named[named > 0], width, ids[-1])):
        beside = ids[by + own]
        at = beside * (2 * width)
        at += near[by]
        at += first
        np.add.at(out, at, 1)
        # Neighbours that are not named are those left over; the first id comes after none, the last before none.
        rest = every - np.bincount(beside, minlength=n)
        rest[edge] -= 1
        out.reshape(n, 2 * width)[:, first + NEIGHBOURS] = rest
    return out.reshape(n, 2 * width)


def cluster_ids(documents: list[np.ndarray], vocabulary_size: int, ends_word: np.ndarray, clusters: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """``cluster_counted`` of the ids in some documents."""
    counts = np.bincount(np.concatenate([*documents, np.zeros(0, np.int64)]).astype(np.int64), minlength=vocabulary_size + 1)
    counts[-1] = len(documents)
    return cluster_counted(counts, neighbour_counts(documents, counts), ends_word, clusters, seed)


def cluster_counted(counts: np.ndarray, neighbours: np.ndarray, ends_word: np.ndarray, clusters: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """A class for each id by its neighbours; ids with fewer than five places by whether they end a word; the end has its own."""
    classes = np.where(ends_word, clusters, clusters + 1).astype(np.int64)
    classes = np.append(classes, clusters + 2)
    count = counts[:-1]
    chosen = np.flatnonzero(count >= 5)
    if len(chosen) <= clusters:
        classes[chosen] = np.arange(len(chosen))
        return classes
    table = neighbours[chosen].astype(np.float64)
    table = np.append(np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1)), ends_word[chosen, None] * 0.7, 1)
    weight = np.sqrt(count[chosen])
    rng = np.random.default_rng(seed)
    centre = table[rng.choice(len(chosen), clusters, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        near = (table @ centre.T * 2 - (centre**2).sum(1)).argmax(1)
        for c in range(clusters):
            mine = near == c
            if mine.any():
                centre[c] = np.average(table[mine], 0, weight[mine])
    classes[chosen] = near
    return classes


def units_of(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The unit of each id: frequent ids have their own, the others one for each class; and how many there are."""
    head = np.argsort(-counts, kind="stable")[:HEAD]
    head = head[counts[head] > 0]
    units = classes + len(head)
    units[head] = np.arange(len(head))
    return units, len(head) + int(classes.max()) + 1


def sample_texts(docs: DataFrame, learnt: int, rows: int = SAMPLE_DOCS) -> list[str]:
    """Texts of the training documents with the smallest hashes of their ids.

    Those below a hash that leaves enough (by six standard deviations) are ordered, so
    that tasks send the driver few rows more than it keeps, however many there are.
    """
    near = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))) <= (rows + 6 * rows**0.5) / max(learnt, 1)
    chosen = docs.where("learn").where(near).orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id", F.xxhash64("text")).limit(rows)
    return [r["text"] or "" for r in chosen.select("text").collect()]


def _learnt_from(b: pa.RecordBatch, kind: str) -> Iterator[list[np.ndarray]]:
    """The ids of the training documents of each chunk; reads train, n_ids and ids."""
    for t, n, ids in zip(*[b.column(k).to_pylist() for k in ("train", "n_ids", "ids")], strict=True):
        parts = np.split(_expand(ids, kind), np.cumsum(np.frombuffer(n, "<u4"))[:-1])
        if own := [d for d, ok in zip(parts, np.frombuffer(t, bool), strict=True) if ok]:
            yield own


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of x by place; as many as the vocabulary and the model's tables have places, whatever the input."""
    t = rows.groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[t["at"].to_numpy()] = t["x"].to_numpy()
    return out


def _sparse(total: np.ndarray, first: int = 0) -> pa.RecordBatch:
    at = np.flatnonzero(total != 0)
    return pa.RecordBatch.from_arrays([pa.array(at + first, pa.int32()), pa.array(total[at].astype(np.float64))], names=["at", "x"])


def fit_model(docs: DataFrame, packed: DataFrame, tokenizer_path: str, learnt: int) -> AttentionModel:
    """First weights from a sample; counts, classes and the rounds from all (so many) training documents."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    size = tokenizer.get_vocab_size()
    kind = id_kind(size)
    ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
    share = docs.sparkSession.sparkContext.broadcast
    chunks = packed.select("train", "n_ids", "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, times = np.frombuffer(c, "<u4").reshape(2, -1)
                total[ids] += times
                total[size] += int(np.frombuffer(t, bool).sum())
        yield _sparse(total)
        give_back_memory()

    counts = _summed(packed.select("id_counts", "train").mapInArrow(count, "at int, x double"), size + 1)
    seen_often = share(counts)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for own in _learnt_from(b, kind):
                total = total + neighbour_counts(own, seen_often.value)
        yield _sparse(np.ravel(total))
        total = None
        give_back_memory()

    width = 2 * (NEIGHBOURS + 1)
    near = _summed(chunks.mapInArrow(neighbours, "at int, x double"), (size + 1) * width).reshape(-1, width)
    classes = cluster_counted(counts, near, ends)
    del near
    n_classes = int(classes.max()) + 1
    units, n_units = units_of(classes, counts)
    w = initial_weights(n_classes, n_units)
    by_class = np.bincount(classes, counts + SMOOTHING, n_classes)
    w["b"] = np.log(np.maximum(by_class, SMOOTHING) / by_class.sum()).astype(np.float32)
    n_pairs, n_tails = (n_units + 1) * n_units, (n_classes + 1) * (size + 1)
    sums = np.zeros(n_pairs + n_tails)
    if not learnt:
        w = {k: x * 0 for k, x in w.items()}
    else:
        encode = word_encoder(tokenizer_path)
        sample = [np.frombuffer(encode(t), "<u4").astype(np.int64) for t in sample_texts(docs, learnt)]
        w = train(w, *training_windows(sample, classes, n_units, units), STEPS, 0.02)
        for r in range(ROUNDS):
            w, counted = _round(chunks, kind, w, classes, units, n_units, r, sums.size)
            sums += counted
    pairs, tails = sums[:n_pairs].reshape(-1, n_units), sums[n_pairs:].reshape(-1, size + 1)
    return AttentionModel(classes, fit_inner(classes, units, n_units, pairs, tails, counts), w)


def _round(chunks: DataFrame, kind: str, w: dict[str, np.ndarray], classes: np.ndarray, units: np.ndarray, n_units: int, r: int, n_counts: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights after a round, and what its documents add to the counts of the inner factors."""
    n_classes, n_ids = int(classes.max()) + 1, len(classes)
    names = list(w)
    sizes = [w[k].size for k in names]
    shared = chunks.sparkSession.sparkContext.broadcast((w, classes, units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, classes, units = shared.value
        adam, done, total = Adam(w), 0, np.zeros(n_counts, np.int64)
        n_pairs = (n_units + 1) * n_units
        for b in batches:
            for own in _learnt_from(b, kind):
                if own := own[r::ROUNDS]:
                    done += pass_over(adam, own, classes, units, RATES[r])
                    ids, starts, _ = with_end(own, n_ids - 1)
                    unit = units[ids]
                    before = np.append(0, unit[:-1])
                    before[starts] = n_units
                    # An id that is a unit of its own is certain given the unit.
                    shares = np.flatnonzero(unit >= n_units - n_classes)
                    after = classes[ids[shares - 1]]
                    after[before[shares] == n_units] = n_classes
                    before *= n_units
                    before += unit
                    total[:n_pairs] += np.bincount(before, minlength=n_pairs)
                    after *= n_ids
                    after += ids[shares]
                    np.add.at(total[n_pairs:], after, 1)
        if done:
            yield _sparse(total)
            yield _sparse(np.append(np.concatenate([adam.w[k].ravel() for k in names]).astype(np.float64) * done, done), n_counts)
        total = adam = None
        give_back_memory()

    sums = _summed(chunks.mapInArrow(run, "at int, x double"), n_counts + sum(sizes) + 1)
    if sums[-1]:
        mean = (sums[n_counts:-1] / sums[-1]).astype(np.float32)
        w = {k: part.reshape(w[k].shape) for k, part in zip(names, np.split(mean, np.cumsum(sizes)[:-1]), strict=True)}
    return w, sums[:n_counts]


# Scoring


OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def lm_score(docs: DataFrame, tokenizer_path: str | None = None, held_out_remainder: int = 1) -> DataFrame:
    """A row for each document: both scores in log10 and the counts they rest on.  Reads doc_id and text."""
    from tokenizers import Tokenizer

    path = tokenizer_path or tokenizer_file()
    kind = id_kind(Tokenizer.from_file(path).get_vocab_size())
    rest = remainder(F.col("doc_id"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("learn", F.coalesce(rest != held_out_remainder, F.lit(False)))
    packed = materialise(pack_documents(docs, path, kind), "packed")
    buckets = bucket_count(packed)
    sums = materialise(count_words(packed, buckets), "sums")
    distinct = total = 0
    for r in sums.where("chunk is null").select("sums").collect():
        v, n = np.frombuffer(r["sums"], "<i8").tolist()
        distinct, total = distinct + v, total + n
    trained = int(packed.select(F.explode("doc_ids").alias("doc_id")).where(rest != held_out_remainder).count())
    model = fit_model(docs, packed, path, trained)
    n_all, v_all = total + trained, distinct + (trained > 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spread = np.log10(n_all + 0.5 * (v_all + 1))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if piece_ids.cache_info().currsize:  # a worker that packed before needs its memory now
            piece_ids.cache_clear()
            give_back_memory()
        ids, held, tokens, knowns, bases, scores = [], [], [], [], [], []
        by_bucket = dict(zip(b["bucket"].to_pylist(), b["sums"].to_pylist(), strict=True))
        for r in a.to_pylist():
            order, cuts = _bucket_order(np.frombuffer(r["vocabulary"], np.uint64), buckets)
            count = np.zeros(len(order), np.int64)
            for k in range(buckets):
                if cuts[k + 1] > cuts[k]:
                    count[order[cuts[k] : cuts[k + 1]]] = np.frombuffer(by_bucket[k], "<i8")
            log = np.log10(count + 0.5) - spread
            n, n_words = np.frombuffer(r["n_distinct"], "<u4"), np.frombuffer(r["n_words"], "<u4").astype(np.int64)
            steps, times = _expand(r["words"], "<u4"), _expand(r["times"], "<u4")
            sums, known, at = [], [], 0
            for m in n.tolist():
                index, often = np.cumsum(steps[at : at + m]), times[at : at + m]
                sums.append(float(log[index] @ often))
                known.append(int(often[count[index] > 0].sum()))
                at += m
            ids += r["doc_ids"]
            held += [i is not None and not t for i, t in zip(r["doc_ids"], np.frombuffer(r["train"], bool).tolist(), strict=True)]
            tokens += (n_words + 1).tolist()
            knowns += [k + (trained > 0) for k in known]
            bases += [x + float(np.log10(trained + 0.5) - spread) for x in sums]
            parts = np.split(_expand(r["ids"], kind), np.cumsum(np.frombuffer(r["n_ids"], "<u4"))[:-1])
            for first in range(0, len(parts), 256):
                scores += (shared.value.log_probability(parts[first : first + 256]) / np.log(10)).tolist()
        out = pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(knowns, pa.int64()), "train_tokens": pa.array([n_all] * len(ids), pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})
        by_bucket.clear()
        give_back_memory()
        return out

    left = packed.select("chunk", "doc_ids", "train", "n_words", "n_distinct", "words", "times", "n_ids", "ids", "vocabulary")
    return left.groupBy("chunk").cogroup(sums.where("chunk is not null").groupBy("chunk")).applyInArrow(score, OUT)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
