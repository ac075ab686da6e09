"""A compressed full-text index of word numbers: suffix order, wavelet tree, backward search.

The index keeps the Burrows-Wheeler transform as a wavelet matrix, a tree of packed bit levels with
rank counts: about 1.5 * log2(vocabulary) bits a word. The suffix array is dropped once it is built.
Searches run for many patterns at a time; a step of all of them is a few array operations a level.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.before = self.before.astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """Rank of symbols in a sequence of numbers below ``symbols``."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(int(symbols - 1).bit_length(), 1)
        self.levels: list[tuple[Bits, int]] = []
        now = sequence
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            zeros = len(now) - int(np.count_nonzero(bit))
            self.levels.append((Bits(bit), zeros))
            now = np.concatenate([now[~bit], now[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places end on the way down to ``symbol``; differences are ranks."""
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """The index of ``texts``: word numbers from 1 on, each text followed by 0.

    ``depth``: searches can shorten their pattern to that many words, see ``widen``.
    """

    def __init__(self, texts: np.ndarray, symbols: int, depth: int):
        order, same = suffix_order(texts, depth)
        n = len(texts)
        transformed = texts[order - 1]  # the word before each suffix; the first one's is the last 0
        self.wavelet = Wavelet(transformed, symbols)
        counts = np.bincount(texts, minlength=symbols)
        below = np.cumsum(counts) - counts
        every = np.arange(symbols)
        self.offset = below - self.wavelet.place(every, np.zeros(symbols, np.int64))
        self.edges = np.append(np.flatnonzero(~same), n)
        self.groups = Bits(~same)
        self.size = n

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``word`` put before them."""
        offset = self.offset[word]
        return offset + self.wavelet.place(word, low), offset + self.wavelet.place(word, high)

    def widen(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``depth`` words of the suffixes at ``low``."""
        group = self.groups.ones(low + 1) - 1
        return self.edges[group], self.edges[group + 1]


def suffix_order(texts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each shares its first ``depth`` words with the one before.

    Suffixes end with their text; of two that are equal up to there, the earlier comes first.
    """
    n = len(texts)
    ends = np.flatnonzero(texts == 0)
    rank = texts + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    have, deep = 1, None
    while True:
        if deep is None and 2 * have > depth:  # the words of ``depth`` by two overlapping parts
            deep = rank, depth - have
        key = rank * np.int64(n + 1)
        key[:-have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        have *= 2
        if deep is not None and fresh.all():
            break
    part, shift = deep
    shifted = np.concatenate([part[shift:], np.full(shift, -1)])
    same = np.zeros(n, bool)
    a, b = order[1:], order[:-1]
    same[1:] = (part[a] == part[b]) & (shifted[a] == shifted[b])
    return order, same


def repeated_windows(texts: list[np.ndarray], index: FMIndex, window: int) -> list[np.ndarray]:
    """For each text, the starts of its windows that the index holds twice or more.

    All texts are streamed from their last word to the first. The statistic of a place is the
    longest match that begins there, up to ``window`` words: the pattern is cut to ``window - 1``
    words, as the index's depth must be, before the next word is put before it.
    """
    by_length = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in by_length])
    words = np.concatenate([texts[i] for i in by_length]) if len(texts) else np.empty(0, np.int64)
    last = np.cumsum(lengths) - 1
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), index.size)
    found = []
    for t in range(int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -t, side="left"))  # texts with more than t words
        low, high = low[:active], high[:active]
        if t >= window:
            low, high = index.widen(low)
        low, high = index.step(words[last[:active] - t], low, high)
        if t >= window - 1:
            often = np.flatnonzero(high - low >= 2)
            found.append(np.stack([often, lengths[often] - 1 - t]))
    out = [np.empty(0, np.int64)] * len(texts)
    if found:
        text, start = np.concatenate(found, axis=1)
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        for k, i in enumerate(by_length.tolist()):
            out[i] = start[cuts[k] : cuts[k + 1]]
    return out
