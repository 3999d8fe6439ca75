"""Words, word hashes and word n-grams.

"Words" are defined once for the whole subpackage: lower-case the text, delete every character that is not a letter,
digit, underscore or white space, and split at white space. ``words`` is the Python form, ``words_text`` the column form
(the words joined by one blank each, '' where there is none, NULL for NULL).

The numpy helpers work on a whole Arrow batch at once: the words of all its records lie in one flat array of 64-bit
hashes, with the offset of each record, so that n-grams, minima and orders cost no Python loop per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_DELETED = re.compile(r"[^\w\s]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3 | 1 << 63)


def words(text: str | None) -> list[str]:
    return _DELETED.sub("", text.lower()).split() if text else []


def words_text(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


class WordHash(dict):
    """64-bit hash of each word, remembered; emptied when ``limit`` words are held, so memory is bounded."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def flat_hashes(texts: Sequence[str], known: WordHash) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts as ``words_text`` gives them: hashes of all words, offsets (one more than texts), the words."""
    counts = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, len(texts))
    flat = " ".join(t for t in texts if t).split(" ") if counts.any() else []
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    return hashes, np.concatenate(([0], np.cumsum(counts))), flat


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of k words that lie within one record: hash, record number, first word's flat place."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled = hashes[:n].copy()
    for j in range(1, k):
        rolled = rolled * _BASE + hashes[j : n + j]
    record = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(record[:n] == record[k - 1 :])
    return mix(rolled[at]), record[at], at


def distinct(value: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once a record, sorted by record and value."""
    order = np.lexsort((value, record))
    value, record = value[order], record[order]
    first = np.append(True, (value[1:] != value[:-1]) | (record[1:] != record[:-1])) if len(value) else np.zeros(0, bool)
    return value[first], record[first]


def seeds(n: int, seed: int = 7) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed))


def starts(record: np.ndarray) -> np.ndarray:
    """Places in a sorted array at which a new value begins."""
    return np.flatnonzero(np.concatenate(([True], record[1:] != record[:-1]))) if len(record) else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def shingle_set(of: Sequence[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(of[i:] for i in range(k))))


def jaccard(a: Iterable, b: Iterable) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a or b else 0.0
