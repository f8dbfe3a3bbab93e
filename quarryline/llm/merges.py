"""Subword ids of many words at once, by the tokenizer's own merges.

A byte-pair encoder merges, in each word, the pair of neighbours with the
lowest rank, the leftmost of equal ones, until no pair has a rank.  Words of one
length are rows of an array, and each step does one merge in every row that is
not finished, so a step's cost is a few array operations for all rows together.

Only words of Latin letters (of A-Z, lower-case ones) with or without marks behind them, which the
tokenizer's normaliser and splitter leave as they are but for the case and for parting the marks,
are taken this way; all others go to the tokenizer, as every word does if its
model is not a plain byte-pair encoder.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from quarryline.llm.packing import MARKS, StretchIds

PLACES = 6  # bits beside a rank for the place of a pair in its word
NO_RANK = np.int32(np.iinfo(np.int32).max >> PLACES << PLACES)
LONGEST = 1 << PLACES  # bytes of letters; steps grow with the square of a word's length, so longer ones go to the tokenizer


class Merges:
    """Symbols of bytes, and ranks of pairs in a hash table of four times their number at least.

    A rank stands ``PLACES`` bits higher, so that the least sum of rank and place is the leftmost of the lowest pairs.
    """

    def __init__(self, model: dict, spelling: list[str]) -> None:
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        # Two symbols are one key; vocabularies beyond 16 bits need a wider one.
        self.key = np.dtype(np.uint32 if max(vocabulary.values()) < (1 << 16) - 1 else np.uint64)
        self.half = self.key.type(4 * self.key.itemsize)
        self.inner, self.last = (np.array([vocabulary[c + s] for c in spelling], self.key) for s in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], self.key)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        # No symbol has the greatest number, so no pair has this key.
        self.free = np.iinfo(self.key).max
        self.keys, self.ranks = np.full(1 << self.bits, self.free, self.key), np.full(1 << self.bits, NO_RANK, np.int32)
        keys = self._keys(*(np.array([vocabulary[p[k]] for p in pairs], self.key) for k in (0, 1)))
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == self.free]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.ranks[at[free]] = keys[free], free << PLACES
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        # Ranks of two bytes, within a word and at its end.
        one, two = np.divmod(np.arange(1 << 16), 256)
        self.bytes = np.stack([self.rank(self.inner[one], end[two]) for end in (self.inner, self.last)])

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a << self.half | b

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ keys >> (self.half - self.key.type(1))) * self.key.type(0x9E3779B97F4A7C15 >> 64 - 8 * self.key.itemsize | 1)
        return (mixed >> self.key.type(8 * self.key.itemsize - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._keys(a, b)
        at = self._slots(keys)
        there = self.keys.take(at)
        out = self.ranks.take(at)
        other = there != keys
        out[other] = NO_RANK
        left = np.flatnonzero(other & (there != self.free))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (there != self.free)]
        return out

    def merge(self, letters: np.ndarray):
        """Yields (rows, ids of each) for rows of bytes, which are words of one length.

        Words are columns here, so that a step goes over all words place by place.
        """
        letters = np.ascontiguousarray(letters.T)
        symbols = self.inner.take(letters)
        symbols[-1] = self.last.take(letters[-1])
        rows = np.arange(symbols.shape[1])
        two = letters[:-1].astype(np.int64) << 8 | letters[1:]
        ranks = self.bytes[0].take(two)
        ranks[-1:] = self.bytes[1].take(two[-1:])
        place = np.arange(len(symbols), dtype=np.int32)[:, None]
        while len(symbols) > 1 and len(rows):
            best = (ranks + place[: len(ranks)]).min(0)
            if len(done := np.flatnonzero(best >= NO_RANK)):
                yield rows[done], symbols[:, done].T
                more = np.flatnonzero(best < NO_RANK)
                if not len(more):
                    return
                rows, symbols, ranks, best = rows[more], symbols.take(more, 1), ranks.take(more, 1), best[more]
            j, each, width = best & ((1 << PLACES) - 1), np.arange(len(best)), len(symbols)
            new = self.made.take(best >> PLACES)
            symbols = np.where(place[: width - 1] <= j, symbols[:-1], symbols[1:])
            symbols[j, each] = new
            ranks = np.where(place[: width - 2] < j, ranks[:-1], ranks[1:])
            before, after = np.flatnonzero(j > 0), np.flatnonzero(j < width - 2)
            at = np.concatenate([j[before] - 1, j[after]])
            row = np.concatenate([before, after])
            ranks[at, row] = self.rank(symbols[at, row], symbols[at + 1, row])
        if len(rows):
            yield rows, symbols.T


@lru_cache(1)
def merges_of(path: str) -> Merges | None:
    """Kept for the life of a worker process; none if the tokenizer's model is another one."""
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path) as f:
        model = json.load(f)["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    # The two bytes of each letter from U+00C0 to U+00FF begin with C3; others only occur in words that the tokenizer gets.
    spelling = ["!"] * 256
    for c in range(128):
        spelling[c] = spell(chr(c))[0][0] if chr(c).isalpha() else "!"
    for c in range(0xC0, 0x100):
        spelling[0xC3], spelling[0x80 + c - 0xC0] = spell(chr(c))[0][0]
    suffix = model.get("end_of_word_suffix") or ""
    if not plain or any(c + s not in model["vocab"] for c in spelling for s in ("", suffix)):
        return None
    return Merges(model | {"end_of_word_suffix": suffix}, spelling)


LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[97:123] = True
MARK[list(MARKS.encode())] = True
SECOND = np.zeros(256, bool)  # behind C3: U+00DF to U+00FF without U+00F7
SECOND[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
CAPITAL = np.zeros(256, bool)  # behind C3: U+00C0 to U+00DE without U+00D7, 32 before their lower-case letters
CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True
MARKS_IN_KEY = 9  # of seven bits each


def _marks(words: list[bytes], text: np.ndarray, some: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """The marks behind some words, and the words with each."""
    n, key = (ends - starts)[some], np.zeros(len(some), np.int64)
    for k in range(min(MARKS_IN_KEY, n.max(initial=0))):
        at = np.flatnonzero(n > k)
        key[at] = key[at] << 7 | text[starts[some[at]] + k]
    # Longer ones are told apart one by one, by numbers that are no keys.
    longer: dict[bytes, int] = {}
    for i in np.flatnonzero(n > MARKS_IN_KEY).tolist():
        w = some[i]
        key[i] = -1 - longer.setdefault(words[w][starts[w] - ends[w] :], len(longer))
    order = np.argsort(key, kind="stable")
    groups = np.split(some[order], np.flatnonzero(np.diff(key[order])) + 1) if len(some) else []
    return [(words[at[0]][starts[at[0]] - ends[at[0]] :], at) for at in groups]


def ids_of_words(words: list[bytes], stretches: StretchIds, merges: Merges | None, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (without white space) one after the other, and how many each has."""
    text = np.frombuffer(b"\n".join([*words, b""]), np.uint8).copy()
    ends = np.flatnonzero(text == 10)
    starts = np.append(0, ends + 1)[:-1]
    second = np.flatnonzero(text[:-1] == 0xC3) + 1
    text[second[CAPITAL[text[second]]]] += 32
    two = np.zeros(len(text), bool)
    two[second[SECOND[text[second]]] - 1] = True
    letter, mark = LETTER[text] | two, MARK[text]
    letter[1:] |= two[:-1]
    wrong = ~(letter | mark)
    wrong[ends] = False
    wrong[1:] |= letter[1:] & mark[:-1]
    wrong[starts] |= ~letter[starts]
    word = np.repeat(np.arange(len(words)), ends - starts + 1)
    plain = np.ones(len(words), bool)
    plain[word[wrong]] = False
    if merges is None:
        plain[:] = False
    n_letters = np.bincount(word[letter], minlength=len(words))
    plain[n_letters > LONGEST] = False
    lengths, found = np.zeros(len(words), np.int64), []
    order = np.flatnonzero(plain)
    order = order[np.argsort(n_letters[order], kind="stable")]
    for some in np.split(order, np.flatnonzero(np.diff(n_letters[order])) + 1) if len(order) else []:
        for rows, ids in merges.merge(text[starts[some, None] + np.arange(n_letters[some[0]])]):
            found.append((some[rows], ids))
            lengths[some[rows]] = ids.shape[1]
    own = lengths.copy()
    behind = [(at, np.frombuffer(stretches.pieces[m.decode()], "<u4")) for m, at in _marks(words, text, np.flatnonzero(plain & (n_letters < ends - starts)), starts + n_letters, ends)]
    for at, ids in behind:
        lengths[at] += len(ids)
    others = [(w, np.frombuffer(stretches.ids(words[w].decode()), "<u4")) for w in np.flatnonzero(~plain).tolist()]
    for w, ids in others:
        lengths[w] = len(ids)
    first = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), kind)
    for at, ids in found:
        out[first[at, None] + np.arange(ids.shape[1])] = ids
    for at, ids in behind:
        out[(first + own)[at, None] + np.arange(len(ids))] = ids
    for w, ids in others:
        out[first[w] : first[w] + len(ids)] = ids
    return out, lengths
