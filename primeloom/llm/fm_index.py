"""An FM-index over word numbers, in numpy: suffix array by prefix doubling, wavelet matrix ranks, sampled positions.

All queries run at once on arrays: a search step costs one rank per wavelet level for all phrases together.
"""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 16


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``s`` (numbers below ``symbols``); after the first sort only tied suffixes are sorted again."""
    n = len(s)
    bits = max(1, int(symbols).bit_length())
    packed = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(packed):
        shifted = np.zeros(n, np.int64)
        shifted[: max(n - j, 0)] = s[j:] + 1 if j < n else 0
        key = (key << bits) | shifted
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = packed
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffix = order[at]
        later = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1)
        group = rank[suffix]
        again = np.lexsort((later, group))
        suffix, later, group = suffix[again], later[again], group[again]
        order[at] = suffix
        fresh = np.append(True, (group[1:] != group[:-1]) | (later[1:] != later[:-1]))
        new[at] = fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2


class Bits:
    """Bit array with ranks: a running count per 64-bit word and population counts inside it."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)[:-1], dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels: list[tuple[Bits, int, int]] = []
        for b in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (values >> b) & 1
            zeros = int(len(values) - bit.sum())
            self.levels.append((Bits(bit.astype(np.uint8)), zeros, b))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often value c stands before place i, for arrays of c and i."""
        begin = np.zeros(len(i), np.int64)
        for bits, zeros, b in self.levels:
            one = (c >> b) & 1 == 1
            ri, rb = bits.rank(i), bits.rank(begin)
            i, begin = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rb, begin - rb)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), np.int64)
        for bits, zeros, b in self.levels:
            one, r = bits.get(i), bits.rank(i)
            value |= one.astype(np.int64) << b
            i = np.where(one, zeros + r, i - r)
        return value


class FMIndex:
    """Index of one text of word numbers. Number 0 is for separators and words no phrase holds; no phrase may hold it."""

    def __init__(self, s: np.ndarray, symbols: int, rate: int = SAMPLE_RATE):
        # one end mark less than all others, else steps back would mix up the places of separators
        s, symbols = np.append(s.astype(np.int64) + 1, 0), symbols + 1
        order = suffix_array(s, symbols)
        last = s[order - 1]
        self.tree = WaveletMatrix(last, symbols)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        kept = order % rate == 0
        self.marked, self.sample, self.n = Bits(kept.astype(np.uint8)), order[kept], len(s)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges of rows whose suffixes begin with each phrase (a row of ``phrases`` each)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j] + 1
            low, high = self.less[c] + self.tree.rank(c, low), self.less[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text place of each row: steps back through the text, all rows together, until a sampled place."""
        place, steps = np.full(len(rows), -1, np.int64), 0
        open_at, row = np.arange(len(rows)), rows.copy()
        while len(open_at):
            hit = self.marked.get(row)
            place[open_at[hit]] = self.sample[self.marked.rank(row[hit])] + steps
            open_at, row = open_at[~hit], row[~hit]
            if len(row):
                c = self.tree.access(row)
                row = self.less[c] + self.tree.rank(c, row)
            steps += 1
        return place
