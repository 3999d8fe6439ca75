"""Banded alignment of two word sequences whose parts may have moved: seeds, bands of diagonals, gaps.

A seed is a run of words that stands in both texts. Seeds next to each other on one diagonal are a block. Blocks that follow one
another in both texts and leave their diagonal by no more than ``BAND`` words are a segment; a moved part is a segment of its
own. What lies between two blocks of a segment is aligned inside the band. The work grows with the length of the texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence

BAND = 24
#: words that a segment must cover to count as a part in common; fewer are words met by chance
LEAST = 5

Block = tuple[int, int, int]  # place in the one text, place in the other, words


def run_seeds(a: Sequence[str], b: Sequence[str], k: int) -> list[tuple[int, int]]:
    """Places of the runs of k words in common: the first time a run stands in a with the first in b, the second with the second."""
    where = run_places(b, k)
    times: dict[tuple[str, ...], int] = {}
    found = []
    for i, run in enumerate(zip(*(a[s:] for s in range(k)))):
        at = where.get(run)
        if at is not None:
            n = times.get(run, 0)
            times[run] = n + 1
            if n < len(at):
                found.append((i, at[n]))
    return found


def run_places(b: Sequence[str], k: int) -> dict[tuple[str, ...], list[int]]:
    where: dict[tuple[str, ...], list[int]] = {}
    for j, run in enumerate(zip(*(b[s:] for s in range(k)))):
        where.setdefault(run, []).append(j)
    return where


def blocks(seeds: Iterable[tuple[int, int]], k: int) -> list[Block]:
    """Seeds in the order of ``a``, those that overlap or touch on one diagonal as one block."""
    found: list[Block] = []
    last: dict[int, int] = {}  # diagonal: its latest block
    for i, j in sorted(seeds):
        at = last.get(i - j)
        if at is not None and i <= found[at][0] + found[at][2]:
            p, q, n = found[at]
            found[at] = p, q, max(n, i + k - p)
        else:
            last[i - j] = len(found)
            found.append((i, j, k))
    return found


def segments(parts: Iterable[Block], band: int = BAND) -> list[list[Block]]:
    """Blocks chained where they follow one another in both texts within the band; each block in one segment."""
    made: list[list[Block]] = []
    latest: dict[int, int] = {}  # diagonal // band: the segment whose last block lies there
    for block in parts:
        i, j, _ = block
        d, best, nearest = i - j, None, band + 1
        for zone in (d // band - 1, d // band, d // band + 1):
            s = latest.get(zone)
            if s is not None:
                p, q, _ = made[s][-1]
                if i > p and j > q and abs(d - (p - q)) < nearest:
                    best, nearest = s, abs(d - (p - q))
        if best is None:
            best = len(made)
            made.append([])
        made[best].append(block)
        latest[d // band] = best
    return made


def extend(a: Sequence[str], b: Sequence[str], where: dict[tuple[str, ...], list[int]], chain: list[Block], k: int, band: int = BAND) -> list[tuple[int, int]]:
    """Runs of k words in common along a chain of blocks: from its first block on and back, over edits, as long as within
    ``band`` words a further run follows that leaves the diagonal by no more than that. ``where``: ``run_places`` of b."""

    def nearest(i: int, wish: int, low: int, high: int) -> int | None:
        at = where.get(tuple(a[i : i + k]))
        if at is None:
            return None
        n = bisect_left(at, wish)
        near = [j for j in at[max(n - 1, 0) : n + 1] if low <= j <= high and abs(j - wish) <= band]
        return min(near, key=lambda j: abs(j - wish), default=None)

    first = chain[0]
    found = []
    ahead = iter(chain[1:])
    following = next(ahead, None)
    d, last_i, last_j = first[0] - first[1], first[0], first[1] - 1
    i = first[0]
    while i + k <= len(a):
        while following is not None and (following[0] < i or following[1] <= last_j):
            following = next(ahead, None)
        if following is not None and following[0] == i:
            j: int | None = following[1]
        else:
            j = nearest(i, i - d, last_j + 1, len(b) - k)
        if j is not None:
            found.append((i, j))
            d, last_i, last_j = i - j, i, j
        elif i - last_i > band + k:
            if following is None:
                break
            i = following[0] - 1
        i += 1
    d, last_i, last_j = first[0] - first[1], first[0], first[1]
    i = first[0] - 1
    while i >= 0 and last_i - i <= band + k:
        j = nearest(i, i - d, 0, last_j - 1)
        if j is not None:
            found.append((i, j))
            d, last_i, last_j = i - j, i, j
        i -= 1
    return found


def gap_edits(x: Sequence[str], y: Sequence[str], band: int = BAND) -> int:
    """Insertions, deletions and substitutions between the words of a gap; one that is wider than the band is taken as replaced."""
    if not x or not y or max(len(x), len(y)) > band:
        return max(len(x), len(y))
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (w != v))
    return row[-1]


def covered(spans: Iterable[tuple[int, int]]) -> int:
    """Places in at least one of the half-open spans."""
    total, end = 0, 0
    for start, stop in sorted(spans):
        total += max(0, stop - max(start, end))
        end = max(end, stop)
    return total


def aligned(a: Sequence[str], b: Sequence[str], k: int, band: int = BAND, least: int = LEAST) -> tuple[float, int, int]:
    """Share of the runs of k words that lie in aligned segments (of those of both texts together), edits, segments.

    Runs count once however often they stand in a text. Edits are those between and around the blocks of all segments.
    """
    parts = [s for s in segments(blocks(run_seeds(a, b, k), k), band) if sum(n for *_, n in s) >= min(least, len(a), len(b))]
    runs = {tuple(a[x : x + k]) for s in parts for i, _, n in s for x in range(i, i + n - k + 1)}
    edits = 0
    for s in parts:
        for (p, q, n), (i, j, _) in zip(s, s[1:]):
            over = max(p + n - i, q + n - j, 0)  # blocks that overlap in one text: words repeated there
            edits += gap_edits(a[p + n : i + over], b[q + n : j + over], band)
    # what no segment spans: replaced where both texts have such words, else inserted or deleted
    edits += max(len(a) - covered((s[0][0], s[-1][0] + s[-1][2]) for s in parts), len(b) - covered((s[0][1], s[-1][1] + s[-1][2]) for s in parts))
    both = len(set(zip(*(a[s:] for s in range(k))))) + len(set(zip(*(b[s:] for s in range(k))))) - len(runs)
    return (len(runs) / both if both else 0.0), edits, len(parts)
