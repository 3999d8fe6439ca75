"""Problem 3: texts that were cut, so that they end within a word or a sentence.

Method: near-copies are found through min-hashes of the windows of a text: of every ``WINDOW`` neighbouring runs of ``RUN`` words the
least hash, up to five successive ones making a band. Windows are cut by content, so what is left of a cut text meets its copies however much was
lost. Every open end is looked up by all of its bands that other texts have too; candidates that cannot hold
``SIMILAR`` of its runs are dropped, the others are aligned. Where the alignment of a text's end lies before the end of a copy, what
follows there tells whether the text ends within a word or a sentence; of several copies the one that holds most of the text
decides. Texts without such a copy are scored by their closing words: how often the same words close a sentence
elsewhere (the most specific context seen often enough decides), and whether the last word is only the beginning of known words.

Only an open end can be cut: a text that closes with a final mark or a closing quotation mark is whole.

Equal texts are compared once; bands of any size are split (``pairs.meetings``). Defined cases: NULL and blank texts and texts
without a paraphrase (see ``answers``) are no cases; re-delivered rows count once; empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.llm import alignment as A
from primeloom.llm import answers
from primeloom.llm import pairs as P
from primeloom.llm import split_overlap as S
from primeloom.llm import words as W
from primeloom.sources.storage import shuffles_freed

RUN, WINDOW, ROWS, SIMILAR, ALIGNED = 5, 4, (3, 4, 5), 0.8, 3
#: least counts at which a context decides (three words, two words, all but the last word, one word), and the least shares of ends
SEEN, CLOSES, CLOSES_AFTER = (8, 15, 100, 40), 0.02, 0.005
SUMMED = 400_000  # rows of counts that a task sums before it sends them on
#: bits of a filter for each value it holds, the least and the most bits it may have, and the bits of a slice of it
BITS_EACH, BITS, SLICE = 32, (1 << 20, 1 << 28), 1 << 19
#: bits of a text's bit set of runs that go with each of its bands, and the columns that hold them
SIEVE = 256
#: members of a block of a bucket: few are askers, and each pair costs next to nothing
MET = 4096
#: texts from which bands are shuffled in two parts, in three from twice as many, and the most parts: each reads all texts again
PART_TEXTS, PARTS = 8_000_000, 4
_SIEVE = [f"b{i}" for i in range(SIEVE // 64)]
_ELLIPSIS = re.compile(r"(?:…|\.{2,})[\"”»)]*$")
_CLOSED = re.compile(r"(?:[.!?。！？][\"”’»)\]*_]*|[”»]|(?<=\w)\")$")
_GERMAN = re.compile(r"„[^“”]*[“”]")
_STOP = "¶"
_KEPT = re.compile(r"[^\w\s¶]")


def marked_words(text: str) -> list[str]:
    """Words with ``¶`` where a sentence or line ends: at a line break, and at a final or closing quotation mark before a blank."""
    text = text.lower().replace(_STOP, " ") + " "
    text = text.replace("\n", " ¶ ").replace("” ", " ¶ ").replace("» ", " ¶ ").replace('" ', " ¶ ")
    text = text.replace(". ", " ¶ ").replace("! ", " ¶ ").replace("? ", " ¶ ")
    return _KEPT.sub("", text).split()


def sentences_closed(said: list[str]) -> list[int]:
    """How many sentences are closed before each place."""
    return list(accumulate((w == _STOP and i > 0 and said[i - 1] != _STOP for i, w in enumerate(said)), initial=0))


def open_end(text: str) -> str | None:
    """The text without what was set after it, or None if it is closed."""
    text = text.strip("\u200b \t\r\n\u00a0")
    parts = text.rsplit(None, 2)  # marks and what was set after the text lie in its last words
    head = parts[0] if len(parts) > 2 else ""
    tail = answers._DECORATION.sub("", text[len(head) :]).rstrip()
    if _ELLIPSIS.search(tail):
        tail = _ELLIPSIS.sub("", tail).rstrip()
    elif not tail or _CLOSED.search(tail):
        return None
    return head + tail


def in_quotation(text: str) -> bool:
    """Whether the last line ends within “...”."""
    line = _GERMAN.sub("", text.rsplit("\n", 1)[-1])
    return line.rfind("“") > line.rfind("”")


def contexts(hashes: np.ndarray) -> np.ndarray:
    """For each word the hashes of: it and two before, it and one before, two before without it, it alone."""
    n = len(hashes)
    one = np.concatenate((np.zeros(1, np.uint64), hashes[:-1])) if n else hashes
    two = np.concatenate((np.zeros(1, np.uint64), one[:-1])) if n else hashes
    # the word hashes are well mixed, so products with odd numbers are enough
    x, y, z, u = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
    out = np.empty((n, 4), np.uint64)
    out[:, 3] = hashes * u
    out[:, 1] = hashes * x + one * y
    out[:, 0] = out[:, 1] + two * z
    out[:, 2] = one * z + two * x
    return out


def _beginning(known: W.WordHash, start: str) -> int:
    return known["\x00" + start]


def plain_hashes(flat: list[str], size: np.ndarray, known: W.WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the marked words of some texts one after the other, ``size`` of each: their hashes, those of words alone, words of each text."""
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    word = hashes != np.uint64(known[_STOP])
    before = np.concatenate(([0], np.cumsum(word)))
    ends = np.cumsum(size)
    return hashes, hashes[word], before[ends] - before[ends - size]


def bands(hashes: np.ndarray, size: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and key of each band of the texts, each key once a text: successive min-hashes of windows.

    ``hashes``: of the words of all texts; ``size``: how many each text has.

    Without ``wanted`` the bands that an open end asks for: of the most ROWS, or of all its min-hashes where it has fewer. One
    of less than the least ROWS, about ten words, would be met by chance and asks for texts of the same words. With ``wanted``,
    those of any ROWS, and of all words, that pass the filter.
    """
    offsets = np.concatenate(([0], np.cumsum(size)))
    # all words of a text as one key
    full = np.flatnonzero(size)
    order = W.mix(np.arange(1, len(hashes) + 1).astype(np.uint64) - np.repeat(offsets[:-1], size).astype(np.uint64)) | np.uint64(1)
    whole = W.mix(np.add.reduceat(hashes * order, offsets[full])) if len(full) else hashes
    value, record, at = W.ngrams(hashes, offsets, RUN)
    chosen = S.select_minima(value, record, WINDOW)
    value, record, at = value[chosen], record[chosen], at[chosen]
    n = len(value)
    times = np.bincount(record, minlength=len(size))
    use = times[full] < ROWS[0] if wanted is None else asked(whole, wanted)
    keys, records = [whole[use]], [full[use]]
    held = times[record]
    left = held - (np.arange(n) - (np.cumsum(times) - times)[record])
    key = value
    for rows in range(2, ROWS[-1] + 1) if n else ():
        nxt = np.minimum(np.arange(n) + rows - 1, n - 1)
        key = W.mix(key * np.uint64(3) + value[nxt] + (at[nxt] - at).astype(np.uint64))
        if rows in ROWS:
            use = left >= rows
            if wanted is not None:
                use &= asked(key, wanted)
            elif rows < ROWS[-1]:
                use &= held == rows
            keys.append(key[use])
            records.append(record[use])
    key, record = W.distinct(np.concatenate(keys), np.concatenate(records))
    return record, key


OPEN = "said string, digest binary, quoted boolean, c array<long>, bands array<long>, letters int"


def prepared(rows: DataFrame) -> DataFrame:
    """The rows (``id, text`` and more), stored, with ``said`` (the marked words, of an open end without what was set after it),
    ``digest`` of the text, and what is looked up for an open end, NULL for closed texts. All are NULL for texts without words.

    ``quoted``: whether it lies within an open quotation; ``c``: the four contexts of the last word, and the word as the
    beginning of longer ones, which has so many ``letters``; ``bands``: the keys of the bands it asks for.
    """
    n, at = len(rows.columns), rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for batch in batches:
            digests, whole, quoted, contexts_, letters = ([None] * batch.num_rows for _ in range(5))
            where, flat, size = [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                left = open_end(text) if text else None
                said = marked_words(text if left is None else left) if text else []
                while said and said[-1] == _STOP:
                    said.pop()
                if not said:
                    continue
                whole[i], digests[i] = " ".join(said), md5(text.encode()).digest()
                if left is None:
                    continue
                tail = [_STOP, _STOP, *said][-3:]
                where.append(i)
                flat += said
                size.append(len(said))
                quoted[i], letters[i] = in_quotation(left), len(said[-1])
                row = [*contexts(np.fromiter(map(known.__getitem__, tail), np.uint64, 3))[2], np.uint64(_beginning(known, said[-1]))]
                contexts_[i] = W.signed(np.array(row, np.uint64)).tolist()
            held: list = [None] * batch.num_rows
            which, key = bands(*plain_hashes(flat, np.array(size, np.int64), known)[1:])
            begin = np.searchsorted(which, np.arange(len(size) + 1)).tolist()
            key = W.signed(key).tolist()
            for j, i in enumerate(where):
                held[i] = key[begin[j] : begin[j + 1]]
            longs = pa.list_(pa.int64())
            made = [pa.array(c, t) for c, t in ((whole, pa.string()), (digests, pa.binary()), (quoted, pa.bool_()), (contexts_, longs), (held, longs), (letters, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*(f"c{i}" for i in range(n)), "said", "digest", "quoted", "c", "bands", "letters"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return P.stored(rows.mapInArrow(run, f"{given}, {OPEN}"))


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (key & np.uint64(bits - 1)).astype(np.int64), ((key >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def asked(key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    p = (key & np.uint64(len(wanted) * 8 - 1)).astype(np.int64)
    hit = (wanted[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1) == 1
    at = np.flatnonzero(hit)
    q = _places(key[at], len(wanted) * 8)[1]
    hit[at] = (wanted[q >> 3] >> (q & 7).astype(np.uint8)) & np.uint8(1) == 1
    return hit


def wanted_filter(values: DataFrame, column: str = "value") -> np.ndarray:
    """A bit set that holds (besides a few others) every value of a long column, two bits each.

    It has ``BITS_EACH`` bits for each value, as far as ``BITS`` allows (32 MB): beyond that it lets more pass, which costs time
    but changes no result. It is made in slices of 64 KB, and only these reach the driver.
    """
    n = values.count()
    bits = min(max(1 << max(n * BITS_EACH - 1, 1).bit_length(), BITS[0]), BITS[1])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                order = np.argsort(part)
                part = part[order]
                begin = W.starts(part // SLICE)
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
                    own = held.setdefault(int(part[a] // SLICE), np.zeros(SLICE // 8, np.uint8))
                    place = part[a:b] % SLICE
                    np.bitwise_or.at(own, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != last:
                    if last is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "bits"])
                    last, own = s, np.zeros(SLICE // 8, np.uint8)
                own |= np.frombuffer(b, np.uint8)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "bits"])

    with shuffles_freed(values.sparkSession):
        made = values.select(column).mapInArrow(slices, "slice int, bits binary")
        rows = made.repartition("slice").sortWithinPartitions("slice").mapInArrow(merged, "slice int, bits binary").collect()
    held = np.zeros(bits // 8, np.uint8)
    for row in rows:
        held[row["slice"] * (SLICE // 8) : (row["slice"] + 1) * (SLICE // 8)] = np.frombuffer(row["bits"], np.uint8)
    return held


def _summed(parts: list[pa.Table]) -> pa.RecordBatch:
    each = pa.concat_tables(parts).group_by("context", use_threads=False).aggregate([("n", "sum"), ("ends", "sum"), ("lo", "min"), ("hi", "max")])
    made = [each[c].combine_chunks() for c in ("context", "n_sum", "ends_sum", "lo_min", "hi_max")]
    return pa.RecordBatch.from_arrays([made[0].cast(pa.uint64()).view(pa.int64()), *made[1:]], ["context", "n", "ends", "lo", "hi"])


def closing_counts(held: DataFrame, wanted: np.ndarray, letters: list[int]) -> DataFrame:
    """``context, n, ends``: how often each wanted context was seen in all texts and how often a sentence closed after it.

    For the beginning of a word ``n`` counts the longer words (``letters``: the lengths of the beginnings asked for). Bands that
    unlike texts have in common are rows without counts; those of one text alone, or of equal ones, are left out: the least and
    the greatest text that has a band tell. The last words of open ends are left out. Contexts that no open end asks for are
    dropped by the filter before they are summed; counts are combined per task before the shuffle. ``held``: ``prepared`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        stop = known[_STOP]
        parts: list[pa.Table] = []
        for batch in batches:
            flat: list[str] = []
            open_at: list[int] = []
            size: list[int] = []
            for text, is_open in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                said = text.split(" ")
                flat += said
                if is_open:
                    open_at.append(len(flat) - 1)
                flat += (_STOP, _STOP)  # two stops between texts: no context reaches over them
                size.append(len(said) + 2)
            hashes, *words = plain_hashes(flat, np.array(size, np.int64), known)
            closes = np.append(hashes[1:] == stop, False) if len(hashes) else np.zeros(0, bool)
            use = hashes != stop
            use[open_at] = False
            seen = Counter(flat)
            seen.subtract(flat[i] for i in open_at)
            longer: Counter = Counter()
            for w, n in seen.items():
                if w != _STOP and n > 0:
                    for k in letters:
                        if k >= len(w):
                            break
                        longer[w[:k]] += n
            start = np.fromiter((_beginning(known, w) for w in longer), np.uint64, len(longer))
            times = np.fromiter(longer.values(), np.int64, len(longer))
            met = asked(start, wanted)
            keys, ns, es = [start[met]], [times[met]], [np.zeros(int(met.sum()), np.int64)]
            of, band = bands(*words, wanted)
            own = batch.column(2).to_numpy()[of]
            all_contexts = contexts(hashes)
            for i in range(4):
                at = np.flatnonzero(use & asked(all_contexts[:, i], wanted))
                each = pa.table({"k": all_contexts[at, i], "e": closes[at].astype(np.int64)})
                summed = each.group_by("k", use_threads=False).aggregate([("e", "count"), ("e", "sum")])
                keys.append(summed["k"].to_numpy())
                ns.append(summed["e_count"].to_numpy())
                es.append(summed["e_sum"].to_numpy())
            counted, texts = pa.nulls(sum(map(len, keys)), pa.int64()), pa.nulls(len(band), pa.int64())
            parts.append(pa.table({"context": np.concatenate(keys), "n": np.concatenate(ns).astype(np.int64), "ends": np.concatenate(es).astype(np.int64), "lo": counted, "hi": counted}))
            parts.append(pa.table({"context": band, "n": texts, "ends": texts, "lo": own, "hi": own}))
            if sum(p.num_rows for p in parts) > SUMMED:
                yield _summed(parts)
                parts = []
        if parts:
            yield _summed(parts)

    rows = held.where("said IS NOT NULL").select("said", F.col("c").isNotNull().alias("open"), F.xxhash64("digest"))
    counted = rows.mapInArrow(run, "context long, n long, ends long, lo long, hi long")
    summed = counted.groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return summed.where("n IS NOT NULL OR lo <> hi").select("context", "n", "ends")


def scored(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, cut`` of all open ends, by closing words alone."""
    met = ends.select("id", "quoted", F.posexplode("c").alias("i", "context")).join(counts.where("n IS NOT NULL"), "context", "left")
    best = met.groupBy("id", "quoted").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(5) for c in ("n", "ends")])
    share = [F.col(f"ends{i}") / F.col(f"n{i}") for i in range(4)]
    # the word's own contexts decide by the most specific; the words before it may also rule an end out
    rule = F.when(F.col("n0") >= SEEN[0], share[0] < CLOSES).when(F.col("n1") >= SEEN[1], (share[1] < CLOSES) | ((F.col("n2") >= SEEN[2]) & (share[2] < CLOSES_AFTER)))
    rule = rule.when(F.col("n2") >= SEEN[2], (share[2] < CLOSES_AFTER) | ((F.col("n3") >= SEEN[3]) & (share[3] < CLOSES))).when(F.col("n3") >= SEEN[3], share[3] < CLOSES)
    unknown, longer = F.coalesce("n3", F.lit(0)), F.coalesce("n4", F.lit(0))
    within = (longer >= 5) & (longer >= 20 * unknown) & (unknown < SEEN[3])
    return best.select("id", (within | F.coalesce(rule, F.lit(False)) | F.col("quoted")).alias("cut"))


def band_rows(held: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``key, id, digest, asks, size, runs, b0, b1 ...``: the bands of all ``prepared`` texts that pass the filter of the open ends' bands.

    ``digest``: 64 bits of it; ``asks``: whether the text is an open end that asks for the band; ``size``: words; ``runs`` of ALIGNED
    words and their bit set, in longs of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for batch in batches:
            said = [t.split(" ") for t in batch.column(1).to_pylist()]
            _, hashes, size = plain_hashes(list(chain.from_iterable(said)), np.fromiter(map(len, said), np.int64, len(said)), known)
            of, flat = bands(hashes, size, wanted)
            asked_of = batch.column(3)
            asking = np.repeat(np.arange(len(said)), asked_of.value_lengths().fill_null(0).to_numpy())
            asks = np.isin(_own_key(of, flat), _own_key(asking, asked_of.flatten().to_numpy().view(np.uint64)))
            own, place = np.unique(of, return_inverse=True)
            meets = np.zeros(len(size), bool)
            meets[own] = True
            hashes, size = hashes[np.repeat(meets, size)], size[own]
            value, record = W.distinct(*W.ngrams(hashes, np.concatenate(([0], np.cumsum(size))), ALIGNED)[:2])
            facts = [size.astype(np.int32), np.bincount(record, minlength=len(own)).astype(np.int32), *P.bit_set(value, record, len(own), SIEVE).T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.signed(flat)), *[batch.column(i).take(pa.array(of)) for i in (0, 2)], pa.array(asks), *[pa.array(np.ascontiguousarray(f)[place]) for f in facts]],
                ["key", "id", "digest", "asks", "size", "runs", *_SIEVE],
            )

    rows = held.where("said IS NOT NULL").select("id", "said", F.xxhash64("digest").alias("digest"), "bands")
    return rows.mapInArrow(run, f"key long, id long, digest long, asks boolean, size int, runs int, {', '.join(f'{b} long' for b in _SIEVE)}")


def _own_key(record: np.ndarray, key: np.ndarray) -> np.ndarray:
    return W.mix(key + W.mix(record.astype(np.uint64) + np.uint64(1)))


def copy_verdict(text: str, other: str) -> bool | None:
    """Whether ``text`` ends early in the longer ``other``, within a word or sentence; None where the two don't tell."""
    told = verified_copy(text, other)
    return None if told is None else told[2]


def verified_copy(text: str, other: str) -> tuple[float, int, bool] | None:
    """The share of the text's runs that is aligned with ``other``, minus the words that ``other`` has, and whether the text ends early.

    None if less than SIMILAR is aligned, if the alignment doesn't reach the text's end, or if the copy is open at the same place.
    """
    left = open_end(text)
    if left is None:
        return None
    a, b = marked_words(left), marked_words(other)
    plain_a, plain_b = [w for w in a if w != _STOP], [w for w in b if w != _STOP]
    runs = W.shingle_set(plain_a, ALIGNED)
    if not runs or len(plain_b) < len(plain_a):
        return None
    parts = A.segments(A.blocks(A.run_seeds(plain_a, plain_b, ALIGNED), ALIGNED))
    parts = [s for s in parts if sum(n for *_, n in s) >= min(A.LEAST, len(plain_a))]
    held = {tuple(plain_a[x : x + ALIGNED]) for s in parts for i, _, n in s for x in range(i, i + n - ALIGNED + 1)}
    if len(held) < SIMILAR * len(runs):
        return None
    closed_a, closed_b = sentences_closed(a)[-1], sentences_closed(b)
    places = [j for j, w in enumerate(b) if w != _STOP]
    best = None
    for s in parts:
        i, j, n = s[-1]
        last = j + len(plain_a) - 1 - i  # where the text's last word lies on the last block's diagonal
        if i + n < len(plain_a) - 1 or last >= len(plain_b):
            continue
        at = places[last]
        if plain_b[last] == plain_a[-1]:
            if at + 1 == len(b) and open_end(other) is not None:
                continue
            early = at + 1 < len(b) and b[at + 1] != _STOP
            if early and closed_b[at] < closed_a:
                continue  # the copy doesn't mark its sentences
        elif plain_b[last].startswith(plain_a[-1]):
            early = True
        else:
            continue
        weight = sum(n for *_, n in s)
        if best is None or weight > best[0]:
            best = (weight, early)
    return None if best is None else (len(held) / len(runs), -len(plain_b), best[1])


def by_copies(held: DataFrame, ends: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, early`` of the open ends of which a verified copy tells: of these the one that holds most of the text, then the shortest."""
    shared = counts.where("n IS NULL").select("context")
    wanted = P.kept(ends.select(F.explode("bands").alias("context")).distinct().join(shared, "context", "left_semi"))
    # a copy lacks at most this part of the end's runs, and each bit that it lacks stands for at least one of them
    # both ways in one condition, so that both sides of the join come from one shuffle
    holds = " OR ".join(
        f"({x}.asks AND {y}.size >= {x}.size AND {' + '.join(f'bit_count({x}.{b} & ~{y}.{b})' for b in _SIEVE)} <= {x}.runs * {1 - SIMILAR!r}D + 1e-6D)"
        for x, y in ("xy", "yx")
    )

    def meeting(keys: DataFrame) -> DataFrame:
        rows = band_rows(held, wanted_filter(keys, "context"))
        # one shuffle, by the band, serves the classes of equal texts and both sides of what meets
        facts = [c for c in rows.columns if c not in ("key", "id", "digest")]
        once = rows.repartition("key").groupBy("key", "digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in facts])
        return P.meetings(once.drop("digest"), holds, MET).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    # with many texts a part of the bands after the other, so that only one part's rows are on disk
    parts = min(PARTS, 1 + held.count() // PART_TEXTS)
    met = meeting(wanted) if parts == 1 else reduce(DataFrame.unionAll, [P.kept(meeting(wanted.where(f"pmod(context, {parts}) = {i}"))) for i in range(parts)]).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                got += [(end, *told) for end, told in ((a, verified_copy(ta, tb)), (b, verified_copy(tb, ta))) if told]
            columns = zip(*got) if got else ([], [], [], [])
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["end", "share", "less", "early"])

    told = P.with_texts(met, held.select(F.col("id").alias("rep"), "text")).mapInArrow(run, "end long, share double, less int, early boolean")
    nearest = told.groupBy("end").agg(F.max(F.struct("share", "less", "early")).alias("top"))
    same = ends.groupBy("digest").agg(F.min("id").alias("end"))
    return nearest.join(same, "end").join(ends.select("id", "digest"), "digest").select("id", F.col("top.early").alias("early"))


def told(held: DataFrame) -> DataFrame:
    """``id, early, cut`` of all open ends of ``prepared`` rows: what a copy tells (NULL without one), and what the closing words do."""
    ends = held.where("c IS NOT NULL").select("id", "digest", "quoted", "c", "bands", "letters")
    letters = sorted(r[0] for r in ends.select("letters").distinct().collect())  # no more than the longest word has letters
    values = ends.select(F.explode(F.concat("c", "bands")).alias("value"))
    counts = P.stored(closing_counts(held, wanted_filter(values), letters))
    return scored(ends, counts).join(by_copies(held, ends, counts), "id", "left")


def cut_ends(held: DataFrame) -> DataFrame:
    """``id`` of the ``prepared`` rows whose text has lost its end, whether or not it is a paraphrase."""
    return told(held).where(F.coalesce("early", "cut")).select("id")


def _rows(explications: DataFrame, dataset: DataFrame) -> DataFrame:
    """``id`` (key * 2, + 1 in nsm_dataset), ``tab, rec_id, origin, word, entry_id, examples, text, loaded_at`` of all deliveries with text."""
    shown = F.lit(None).cast("array<string>").alias("examples")
    one = explications.where("text IS NOT NULL AND expl_id IS NOT NULL").select(
        (F.col("expl_id") * 2).alias("id"), F.lit("explications").alias("tab"), F.col("expl_id").alias("rec_id"), F.lower(F.trim("model")).alias("origin"),
        F.col("target_word").alias("word"), "entry_id", shown, "text", "loaded_at",
    )
    two = dataset.where("explication IS NOT NULL AND row_id IS NOT NULL").select(
        (F.col("row_id") * 2 + 1).alias("id"), F.lit("nsm_dataset").alias("tab"), F.col("row_id").alias("rec_id"), F.lower(F.trim("source")).alias("origin"),
        "word", F.lit(None).cast("long").alias("entry_id"), "examples", F.col("explication").alias("text"), "loaded_at",
    )
    return one.unionAll(two)


def records(explications: DataFrame, dataset: DataFrame) -> DataFrame:
    """``id, tab, origin, text`` of all texts; both tables are put together before re-deliveries are sorted out, in one shuffle."""
    return P.latest(_rows(explications, dataset), "id", "tab", "origin", "text")


def cases(every: DataFrame, explications: DataFrame, dataset: DataFrame, entries: DataFrame) -> DataFrame:
    """``tab, rec_id, origin`` of all cut paraphrases among ``prepared`` records. An explication's examples are those of its entry.

    Prompts are read for the cut texts alone.
    """
    cut = P.only(_rows(explications, dataset), cut_ends(every), "id")
    rows = P.latest(cut, "id", "tab", "rec_id", "origin", "word", "entry_id", "examples", "text")
    shown = entries.where("entry_id IS NOT NULL").groupBy("entry_id").agg(F.max("examples").alias("entry_examples"))
    asked = P.kept(rows.join(shown, "entry_id", "left").withColumn("examples", F.coalesce("examples", "entry_examples")))
    sound = answers.labelled(asked).where("defect IS NULL").select("id")
    return asked.join(sound, "id").select("tab", "rec_id", "origin")


def found(explications: DataFrame, dataset: DataFrame, entries: DataFrame) -> DataFrame:
    """``tab, rec_id``."""
    return cases(prepared(records(explications, dataset)), explications, dataset, entries).select("tab", "rec_id")


def rates(explications: DataFrame, dataset: DataFrame, entries: DataFrame) -> DataFrame:
    """``tab, origin, records, cut, rate``: by model or source."""
    every = prepared(records(explications, dataset))
    total = every.groupBy("tab", "origin").agg(F.count(F.lit(1)).alias("records"))
    cut = cases(every, explications, dataset, entries).groupBy("tab", "origin").agg(F.count(F.lit(1)).alias("cut"))
    same = (total["tab"] == cut["tab"]) & total["origin"].eqNullSafe(cut["origin"])
    n = F.coalesce(cut["cut"], F.lit(0))
    return total.join(cut, same, "left").select(total["tab"], total["origin"], "records", n.alias("cut"), F.round(n / F.col("records"), 6).alias("rate"))
