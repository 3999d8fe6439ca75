"""Problem 4: records that share most of their content but for small edits, insertions or reordering.

Method: Order MinHash. A sample takes, of the occurrence-labelled runs of three words of a text, some that are least under a
random order and keeps them in the order of the text; texts that agree in a sample are candidates. Half of the samples take two
runs, those of stock phrases last (``common_pairs``), and every second of these leaves the text's order out, as parts may be moved
all over. The other half takes four whatever they are, in no order, so texts that have only stock in common meet too.

Candidates whose sets of runs cannot agree are dropped (``pairs.promising``); the others are decided by banded alignment: the
runs inside aligned segments, of which a moved part is one of its own, must make up ``THRESHOLD`` of the runs of both texts.

Equal texts are one class each and take part once. Defined cases: NULL texts, NULL or blank ``examples`` elements count as
no words; a text of fewer than three words has no run and no pair; re-delivered rows count once; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.llm import pairs as P
from primeloom.llm import words as W
from primeloom.llm.alignment import aligned

RUN = 3
#: samples of rarer runs first and of any runs, and how many runs each takes
SAMPLES = ((32, 2, True), (32, 4, False))
THRESHOLD = 0.5  # TESTDATA.md: cases share at least 60 % of the runs, all other pairs less than 40 %
COMMON_SHARE, COMMON_MOST, GROUPED = 0.002, 50_000, 0.4
#: texts sampled at once, so that their runs stay in the processor's cache
CHUNK = 2_000
SCHEMA = "id long, split string, source string, digest binary, size int, runs int, bits array<long>, text string"


def records(dataset: DataFrame) -> DataFrame:
    """``id, split, source, digest, size, runs, bits, text``: the words of ``explication`` and then those of the non-null ``examples``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for batch in batches:
            said = [
                " ".join([*W.words(text), *(w for e in shown or () for w in W.words(e))])
                for text, shown in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            digest = pa.array([md5(t.encode()).digest() for t in said], pa.binary())
            hashes, offsets, _ = W.flat_hashes(said, known)
            value, record = W.distinct(*W.ngrams(hashes, offsets, RUN)[:2])
            runs = np.bincount(record, minlength=len(said)).astype(np.int32)
            bits = pa.ListArray.from_arrays(np.arange(len(said) + 1, dtype=np.int32) * P.LONGS, P.bit_set(value, record, len(said)).ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], digest, pa.array(np.diff(offsets).astype(np.int32)), pa.array(runs), bits, pa.array(said, pa.string())],
                ["id", "split", "source", "digest", "size", "runs", "bits", "text"],
            )

    named = P.latest(dataset, "row_id", F.lower(F.trim("split")).alias("split"), F.lower(F.trim("source")).alias("source"), "explication", "examples")
    return named.withColumnRenamed("row_id", "id").mapInArrow(run, SCHEMA)


def common_pairs(texts: DataFrame, share: float = COMMON_SHARE, most: int = COMMON_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of stock pairs of neighbouring words, and a class of frequency from 1 up for each.

    Stock is what at least ``share`` of all texts (and 8) hold, and unlike texts. No more than (mean distinct pairs of a text) /
    share pairs can reach the share, whatever the number of texts; where texts are so long that this exceeds ``most``, the
    share is raised to what ``most`` pairs can reach. A pair that is frequent because a large group of near-copies holds it is no
    stock: its texts mostly agree in their min-hashes (``GROUPED`` of them in each of three); else what is rare in such texts
    would be their edits. The pairs only order the runs. Counts are combined per Arrow batch before the shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for batch in batches:
            hashes, offsets, _ = W.flat_hashes(batch.column(0).to_pylist(), known)
            pair, n = np.unique(W.distinct(*W.ngrams(hashes, offsets, 2)[:2])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(pair)), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = P.kept(texts.select("text").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    total, every = texts.count(), counts.agg(F.sum("n")).first()[0] or 0
    least = max(8.0, total * share, every / most)
    top = counts.where(F.col("n") >= least).toPandas()
    frequent, n = top["pair"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(frequent)
    frequent, n = frequent[order], n[order]
    if not len(frequent):
        return frequent, np.zeros(0, np.uint8)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        factors = W.seeds(3, 11) | np.uint64(1)
        for batch in batches:
            hashes, offsets, _ = W.flat_hashes(batch.column(0).to_pylist(), known)
            run, of, _ = W.ngrams(hashes, offsets, RUN)
            begin = W.starts(of)
            bucket = np.zeros((len(offsets), 3), np.int64)
            if len(begin):
                for s, factor in enumerate(factors):
                    bucket[of[begin], s] = (W.mix(np.minimum.reduceat(run * factor, begin)) & np.uint64(15)).astype(np.int64)
            value, record = W.distinct(*W.ngrams(hashes, offsets, 2)[:2])
            spot = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
            at = np.flatnonzero(frequent[spot] == value)
            slot, times = np.unique(np.concatenate([spot[at] * 48 + s * 16 + bucket[record[at], s] for s in range(3)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(times.astype(np.int64))], ["slot", "n"])

    by_bucket = texts.select("text").mapInArrow(grouped, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    by_hash = by_bucket.groupBy(F.floor(F.col("slot") / 16).cast("long").alias("h")).agg((F.max("n") / F.sum("n")).alias("top"))
    alike = by_hash.groupBy(F.floor(F.col("h") / 3).cast("long").alias("i")).agg(F.min("top").alias("top")).where(F.col("top") >= GROUPED)
    stock = np.delete(np.arange(len(frequent)), alike.toPandas()["i"].to_numpy(np.int64))
    return frequent[stock], (1 + np.log2(np.maximum(n[stock] / least, 1))).astype(np.uint8)


def stock_class(hashes: np.ndarray, at: np.ndarray, k: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For the runs of k words that start at ``at`` the class of their rarest pair of words; 0 if that is no stock."""
    frequent, classes = common
    if len(hashes) < 2 or not len(frequent):
        return np.zeros(len(at), np.uint8)
    pair = W.ngrams(hashes, np.array([0, len(hashes)]), 2)[0]
    spot = np.minimum(np.searchsorted(frequent, pair), len(frequent) - 1)
    of_pair = np.where(frequent[spot] == pair, classes[spot], np.uint8(0))
    least = of_pair[at]
    for j in range(1, k - 1):
        least = np.minimum(least, of_pair[at + j])
    return least


def occurrences(value: np.ndarray, record: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for the first, second, third ... place of an equal value in one record."""
    order = np.lexsort((value, record))
    v, r = value[order], record[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - first
    return out


def least_places(h: np.ndarray, of: np.ndarray, limit: np.ndarray, size: np.ndarray, take: int) -> np.ndarray:
    """For each record (``of``: 0, 1 ... in order, none empty) the places of its ``take`` least values, -1 where it has fewer.

    Only values up to the record's ``limit`` are looked at; a record with too few of these is looked at whole.
    """
    low = h <= limit[of]
    short = np.bincount(of[low], minlength=len(size)) < np.minimum(size, take)
    if short.any():
        low |= short[of]
    at = np.flatnonzero(low)
    left, row = h[at], of[at]
    begin, none = W.starts(row), np.uint64(2**64 - 1)
    places = np.full((len(size), take), -1, np.int64)
    for c in range(take):
        least = np.minimum.reduceat(left, begin)
        hit = np.flatnonzero((left == least[row]) & (left != none))
        places[row[hit], c] = at[hit]
        left[hit] = none
    return places


def order_min_hash(value: np.ndarray, record: np.ndarray, stock: np.ndarray, samples=SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Record numbers that have runs, and a key for each and sample. ``stock``: marks runs of stock pairs only."""
    count = sum(n for n, *_ in samples)
    if not len(value):
        return np.zeros(0, np.int64), np.zeros((0, count), np.uint64)
    labelled = W.mix(value + occurrences(value, record).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin = W.starts(record)
    size = np.diff(np.append(begin, len(record)))
    of = np.repeat(np.arange(len(begin)), size)
    keys, i, seeds = np.empty((len(begin), count), np.uint64), 0, W.seeds(count)
    for n, take, rarer_first in samples:
        top = stock.astype(np.uint64) << np.uint64(63) if rarer_first else np.uint64(0)
        among = np.bincount(of[~stock], minlength=len(begin)) if rarer_first else size
        wanted = 4 * take + 8  # about so many values lie below the limit, so that it rarely misses
        share = np.minimum(wanted / np.maximum(among, 1), 0.999)
        limit = np.where(among >= take, (share * 2.0**63).astype(np.uint64), np.uint64(2**64 - 1))
        for turn in range(n):
            h = ((labelled * (seeds[i] | np.uint64(1))) >> np.uint64(1)) | top
            places = np.sort(least_places(h, of, limit, size, take), axis=1)
            x = np.where(places < 0, np.uint64(0), labelled[places])
            if turn % 2 or not rarer_first:
                x = np.sort(x, axis=1)
            key = np.full(len(begin), seeds[i])
            for c in range(take):
                key = W.mix(key * np.uint64(3) + x[:, c])
            keys[:, i] = key
            i += 1
    return record[begin], keys


def sketches(reps: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int = RUN, samples=SAMPLES) -> DataFrame:
    """``key, id``: a row for each text and sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                hashes, offsets, _ = W.flat_hashes(batch.column(1).to_pylist(), known)
                value, record, at = W.ngrams(hashes, offsets, k)
                which, keys = order_min_hash(value, record, stock_class(hashes, at, k, common) > 0, samples)
                ids = np.repeat(batch.column(0).to_numpy()[which], keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys.ravel())), pa.array(ids)], ["key", "id"])

    return reps.select("rep", "text").mapInArrow(run, "key long, id long")


def links(dataset: DataFrame, k: int = RUN, samples=SAMPLES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links between different texts (``a, b, similarity, edits, segments``) and members (``rep, id, split, source``)."""
    reps, members = P.classes(P.stored(records(dataset)).where("size > 0"))
    held = P.stored(reps.select("rep", "runs", "bits", "text"))
    met = P.meetings(sketches(held, common_pairs(held), k, samples)).select("x.id", F.col("y.id").alias("b")).withColumnRenamed("id", "a").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                similarity, edits, parts = aligned(ta.split(" "), tb.split(" "), k)
                if similarity >= threshold:
                    got.append((a, b, similarity, edits, parts))
            columns = list(zip(*got)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                ["a", "b", "similarity", "edits", "segments"],
            )

    verified = P.with_texts(P.promising(met, held, threshold), held).mapInArrow(run, "a long, b long, similarity double, edits long, segments long")
    return verified, members.select("rep", "id", "split", "source", (F.col("size") >= k).alias("has_run"))


def found(dataset: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b``: every pair of records within a group."""
    linked, members = links(dataset)
    pairs = P.expand(linked.select("a", "b"), members.where("has_run"))
    return pairs.select(F.col("x.id").alias("row_id_a"), F.col("y.id").alias("row_id_b"))


def class_pairs(dataset: DataFrame) -> DataFrame:
    """``class_a, class_b, similarity, edits, segments`` of every link, as aligned; a class is named by its least row_id."""
    linked, _ = links(dataset)
    return linked.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 6).alias("similarity"), "edits", "segments")


def class_links(dataset: DataFrame) -> DataFrame:
    """One row a record: ``row_id, class_id`` (least row_id with the same words), ``copies`` and ``links`` to other classes."""
    linked, members = links(dataset)
    ends = linked.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    per_class = sizes.join(ends, "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return members.join(per_class, "rep").select(F.col("id").alias("row_id"), F.col("rep").alias("class_id"), "copies", "links")
