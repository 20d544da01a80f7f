"""A compressed FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform.

The suffixes are ordered by their first `DEPTH` words, which is all that patterns of up to `DEPTH`
words need. All searches of a step are vectorised.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class Bits:
    """A bit vector of packed 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of a sequence of ids from 1 to `size`; 0 ends each part and is searched for by nothing.

    owner: a number for each place of the sequence. Kept are the wavelet matrix of the transform, the
    symbols' first places, and where each class begins with its least owner.
    """

    def __init__(self, text: np.ndarray, size: int, window: int, owner: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        eighth, length = rank, 1
        while length < DEPTH:
            later = np.zeros(n, np.int64)
            later[: max(n - length, 0)] = rank[length:] + 1
            key = rank * (n + size + 2) + later
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            length *= 2
            if length == 8:
                eighth = rank
        # Neighbours in suffix order with the same first `window` words (8 < window <= 16) form a class.
        tail = eighth[np.minimum(order + window - 8, n - 1)]
        head = eighth[order]
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        self.class_start = np.append(np.flatnonzero(fresh), n).astype(np.int32)
        # One number for each class stays; the suffixes themselves are needed no further.
        self.least = np.minimum.reduceat(owner[order], self.class_start[:-1])
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.levels: list[tuple[int, Bits]] = []
        row = bwt
        for bit in range(max(1, int(size).bit_length()) - 1, -1, -1):
            b = (row >> bit & 1).astype(np.uint8)
            self.levels.append((bit, Bits(b)))
            row = np.concatenate([row[b == 0], row[b == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before each of two positions of the transform."""
        start = np.zeros_like(low)
        for bit, bits in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            moved = []
            for at in (start, low, high):
                ones = bits.ones(at)
                moved.append(np.where(one, bits.zeros + ones, at - ones))
            start, low, high = moved
        return low - start, high - start

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the patterns with `symbol` put before them."""
        a, b = self.rank(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b


def matched_minimum(parts: list[list], owner: np.ndarray, window: int) -> list[np.ndarray]:
    """For each part (a list of words) and each of its windows, the least owner of a part that has the window.

    Every part is streamed from its end through the index of all parts: its matching statistic grows by
    a word at each backward step and is held at `window` words.
    """
    lengths = np.array([len(p) for p in parts])
    code: dict = {}
    flat = np.fromiter((code.setdefault(w, len(code) + 1) for p in parts for w in p), np.int64, int(lengths.sum()))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(parts)), lengths)] = flat
    index = FMIndex(text, len(code), window, np.repeat(owner, lengths + 1))
    out = [np.zeros(max(0, n - window + 1), np.int64) for n in lengths]
    results = np.zeros(int(np.maximum(lengths - window + 1, 0).sum()), np.int64)
    slot = np.concatenate([[0], np.cumsum(np.maximum(lengths - window + 1, 0))])
    low, high = np.zeros(len(parts), np.int64), np.full(len(parts), len(text), np.int64)
    for step in range(1, int(lengths.max(initial=0)) + 1):
        on = np.flatnonzero(lengths >= step)
        at = begin[on] + lengths[on] - step
        a, b = index.extend(text[at], low[on], high[on])
        if step >= window:
            k = np.searchsorted(index.class_start, a, "right") - 1
            a, b = index.class_start[k].astype(np.int64), index.class_start[k + 1].astype(np.int64)
            results[slot[on] + lengths[on] - step] = index.least[k]
        low[on], high[on] = a, b
    for k in range(len(parts)):
        out[k] = results[slot[k] : slot[k + 1]]
    return out
