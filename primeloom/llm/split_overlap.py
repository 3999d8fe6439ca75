"""Problem 1: evaluation records that also stand, exactly or almost, in a training record.

Method: the distinct runs of three words of every text are put in one order, rarer ones first (``run_counts``). Two texts whose runs agree
by ``near_edits.THRESHOLD`` have one of each text's first runs in common (``first_runs``), so these alone are joined, across splits
only, and no pair that meets the threshold is left out, whatever its edits are. What cannot agree by the places of
the run in the two orders and the numbers of runs isn't even paired; of the rest, what cannot agree by its bits is dropped (``pairs.promising``).

The two texts of a candidate are winnowed: of every ``WINDOW`` neighbouring runs of ``RUN`` words the one with the least rolling hash is
selected, so stretches of ``WINDOW + RUN - 1`` words in common share a selected run. Selected runs in common with their places are seeds;
they are chained where they follow one another in both texts, and the chains are extended by alignment inside
a band. A pair counts when the runs of three words on aligned stretches make up ``near_edits.THRESHOLD`` of the runs of both texts;
the part of each text's words that they cover is its coverage.

Equal texts are one class each. Defined cases as in ``near_edits``; a record whose split is NULL or of another name takes part
in no pair; the source of a NULL source is reported as NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.llm import alignment as A
from primeloom.llm import near_edits as N
from primeloom.llm import pairs as P
from primeloom.llm import words as W

RUN, WINDOW = 5, 4
#: least and most counters of runs, and those of a slice; more make the order finer, the result is the same
COUNTERS, SLICE = (1 << 16, 1 << 20), 1 << 14
TRAIN, EVALUATION = 1, 2


def select_minima(value: np.ndarray, record: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indexes of the runs selected by winnowing: the rightmost least of each full window; of a shorter record its least."""
    n = len(value)
    chosen = np.zeros(n, bool)
    if not n:
        return np.flatnonzero(chosen)
    m = n - window + 1
    if m > 0:
        least = value[:m].copy()
        for shift in range(1, window):
            np.minimum(least, value[shift : m + shift], out=least)
        open_ = record[:m] == record[window - 1 :]  # windows within one record
        for shift in range(window - 1, -1, -1):
            hit = open_ & (value[shift : m + shift] == least)
            chosen[shift : m + shift] |= hit
            open_ &= ~hit
    begin = W.starts(record)
    size = np.diff(np.append(begin, n))
    for b, k in zip(begin[size < window].tolist(), size[size < window].tolist()):
        chosen[b + k - 1 - int(np.argmin(value[b : b + k][::-1]))] = True
    return np.flatnonzero(chosen)


def shared_seeds(a: Sequence[str], b: Sequence[str], known: W.WordHash) -> list[tuple[int, int]]:
    """Places in a and in b of the selected runs in common; of all runs of three words where a text has few of ``RUN``."""
    hashes = np.fromiter(map(known.__getitem__, [*a, *b]), np.uint64, len(a) + len(b))
    k = RUN if min(len(a), len(b)) >= 2 * RUN else N.RUN
    value, record, at = W.ngrams(hashes, np.array([0, len(a), len(a) + len(b)]), k)
    chosen = select_minima(value, record) if k == RUN else np.arange(len(value))
    places: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for v, r, p in zip(value[chosen].tolist(), record[chosen].tolist(), at[chosen].tolist()):
        places[r].setdefault(v, p - r * len(a))
    return [(i, places[1][v]) for v, i in places[0].items() if v in places[1]]


def run_counts(reps: DataFrame) -> np.ndarray:
    """How often the runs of each counter stand in all texts. A run's counter is given by its first bits (``_counter``).

    Counted in each task and summed by slices; there are no more than the larger of ``COUNTERS``, and only they reach the driver.
    """
    total = reps.agg(F.sum("runs")).first()[0] or 0
    size = min(max(1 << (int(total) // 8).bit_length(), COUNTERS[0]), COUNTERS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = W.WordHash(), np.zeros(size, np.int64)
        for batch in batches:
            hashes, offsets, _ = W.flat_hashes(batch.column(0).to_pylist(), known)
            own += np.bincount(_counter(W.distinct(*W.ngrams(hashes, offsets, N.RUN)[:2])[0], size), minlength=size)
        if own.any():
            parts = np.minimum(own, 2**32 - 1).astype(np.uint32).reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[s] = held.get(s, 0) + np.frombuffer(n, np.uint32).astype(np.int64)
        made = [np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes() for n in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(made, pa.binary())], ["slice", "n"])

    counts = np.zeros(size, np.uint32)
    for row in reps.select("text").mapInArrow(run, "slice int, n binary").repartition("slice").mapInArrow(merged, "slice int, n binary").collect():
        counts[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["n"], np.uint32)
    return counts


def _counter(value: np.ndarray, size: int) -> np.ndarray:
    return (value >> np.uint64(65 - size.bit_length())).astype(np.int64)


def first_runs(hashes: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, record and rank of the runs that are joined: of a record's n distinct runs the first n - ceil(THRESHOLD * n) + 1.

    Of two texts that agree by the threshold each has at least that share of its runs in common with the other, and the first of these
    in the order, the same for both, is among the first runs of both.
    """
    value, record = W.distinct(*W.ngrams(hashes, offsets, N.RUN)[:2])
    order = np.lexsort((value, counts[_counter(value, len(counts))], record))
    value, record = value[order], record[order]
    size = np.bincount(record, minlength=len(offsets) - 1)
    rank = np.arange(len(record)) - (np.cumsum(size) - size)[record]
    joined = rank <= size[record] - np.ceil(N.THRESHOLD * size[record] - 1e-9)
    return value[joined], record[joined], rank[joined]


def firsts(reps: DataFrame, counts: np.ndarray) -> DataFrame:
    """``key, id, side, rank, runs``: a row for each of the first runs of each text."""
    held = reps.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for whole in batches:
            for start in range(0, whole.num_rows, N.CHUNK):
                batch = whole.slice(start, N.CHUNK)
                hashes, offsets, _ = W.flat_hashes(batch.column(1).to_pylist(), known)
                key, of, rank = first_runs(hashes, offsets, held.value)
                rows = [batch.column(i).take(pa.array(of)) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(key)), rows[0], rows[1], pa.array(rank.astype(np.int32)), rows[2]], ["key", "id", "side", "rank", "runs"])

    return reps.select("rep", "text", "side", "runs").mapInArrow(run, "key long, id long, side int, rank int, runs int")


def aligned_runs(a: Sequence[str], b: Sequence[str], seeds: list[tuple[int, int]], k: int = N.RUN) -> tuple[set[int], set[int]]:
    """Places in a and in b of the runs of k words on the stretches that chains of seeds, extended by alignment, hold in common."""
    where = A.run_places(b, k)
    in_a: set[int] = set()
    in_b: set[int] = set()

    def chained(starts: list[tuple[int, int]]) -> None:
        for chain in A.segments(A.blocks(starts, k)):
            if not all(i in in_a for i, *_ in chain):  # else an earlier stretch holds it
                found = A.extend(a, b, where, chain, k)
                in_a.update(i for i, _ in found)
                in_b.update(j for _, j in found)

    chained(seeds)
    # parts no chain reached, as those moved: runs in common there are seeds of their own
    if len(in_a) < len(a) - k + 1 and len(in_b) < len(b) - k + 1:
        left = [(i, j) for i, j in A.run_seeds(a, b, k) if i not in in_a and j not in in_b]
        chained([(i, j) for i, j, n in A.blocks(left, k) if n >= A.LEAST])
    return in_a, in_b


def overlap(a: Sequence[str], b: Sequence[str], seeds: list[tuple[int, int]], k: int = N.RUN) -> tuple[float, float, float]:
    """Share of the distinct runs of both texts that lie on common stretches; coverage of a's and of b's words by these."""
    in_a, in_b = aligned_runs(a, b, seeds, k)
    runs = {tuple(a[i : i + k]) for i in in_a}
    # a repeated run covers each of its places
    cover = [A.covered((i, i + k) for i, run in enumerate(zip(*(t[s:] for s in range(k)))) if run in runs) / max(len(t), 1) for t in (a, b)]
    both = len(W.shingle_set(a, k)) + len(W.shingle_set(b, k)) - len(runs)
    return (len(runs) / both if both else 0.0), cover[0], cover[1]


def links(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between different texts across splits, with coverage of either; members ``rep, id, split, source, side``."""
    side = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("validation", "test"), EVALUATION).otherwise(0)
    rec = P.stored(N.records(dataset).withColumn("side", side).where("side > 0 AND size > 0"))
    reps, members = P.classes(rec)
    sides = rec.groupBy("digest").agg(F.min("id").alias("rep"), F.bit_or("side").cast("int").alias("side")).select("rep", "side")
    held = P.stored(reps.select("rep", "runs", "bits", "text").join(sides, "rep"))
    across = "((x.side & 1 > 0 AND y.side & 2 > 0) OR (x.side & 2 > 0 AND y.side & 1 > 0))"
    # if this is the first run in common, all others in common come after it in both texts
    enough = f"least(x.runs - x.rank, y.runs - y.rank) >= (x.runs + y.runs) * {N.THRESHOLD / (1 + N.THRESHOLD)!r}D - 1e-6D"
    met = P.meetings(firsts(held, run_counts(held)), f"{across} AND {enough}").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for batch in batches:
            got = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = ta.split(" "), tb.split(" ")
                similarity, of_a, of_b = overlap(x, y, shared_seeds(x, y, known))
                if similarity >= N.THRESHOLD:
                    got.append((a, b, similarity, of_a, of_b))
            columns = list(zip(*got)) if got else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "b", "similarity", "cover_a", "cover_b"])

    schema = "a long, b long, similarity double, cover_a double, cover_b double"
    verified = P.with_texts(P.promising(met, held, N.THRESHOLD), held).mapInArrow(run, schema)
    return verified, members.select("rep", "id", "split", "source", "side", (F.col("size") >= N.RUN).alias("has_run"))


def pairs(dataset: DataFrame) -> DataFrame:
    """Every pair of a training and an evaluation record that overlap, as structs ``x`` and ``y``."""
    linked, members = links(dataset)
    return P.expand(linked.select("a", "b"), members.where("has_run")).where(F.col("x.side") != F.col("y.side"))


def found(dataset: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b``."""
    return pairs(dataset).select(F.col("x.id").alias("row_id_a"), F.col("y.id").alias("row_id_b"))


def _per_class(linked: DataFrame, members: DataFrame) -> DataFrame:
    """``rep, trains, exact, links, best, cover``: training records that overlap each class' text, of these equal ones, and the
    greatest similarity and coverage. A class none overlaps has no row."""
    own = members.where("has_run").groupBy("rep").agg(F.count_if(F.col("side") == TRAIN).alias("trains"))
    ends = [linked.select(F.col(s).alias("rep"), F.col(o).alias("o"), "similarity", F.col(f"cover_{s}").alias("cover")) for s, o in ("ab", "ba")]
    across = (
        ends[0]
        .unionAll(ends[1])
        .join(own.select(F.col("rep").alias("o"), F.col("trains").alias("t")), "o")
        .where("t > 0")
        .groupBy("rep")
        .agg(F.sum("t").alias("linked"), F.max("similarity").alias("similarity"), F.max("cover").alias("cover"))
    )
    exact = F.col("trains")
    joined = own.join(across, "rep", "left").where((exact > 0) | F.col("linked").isNotNull())
    return joined.select(
        "rep",
        (exact + F.coalesce("linked", F.lit(0))).cast("long").alias("trains"),
        exact.cast("long").alias("exact"),
        F.when(exact > 0, 1.0).otherwise(F.col("similarity")).alias("best"),
        F.when(exact > 0, 1.0).otherwise(F.col("cover")).alias("cover"),
    )


def evaluation_records(dataset: DataFrame) -> DataFrame:
    """One row an evaluation record that overlaps: ``row_id, split, source, train_records, exact_copies``, and by alignment
    ``best_similarity`` and ``coverage``, the greatest part of its words that lies on stretches in common with one training record."""
    linked, members = links(dataset)
    mine = members.where((F.col("side") == EVALUATION) & F.col("has_run")).join(_per_class(linked, members), "rep")
    return mine.select(
        F.col("id").alias("row_id"), "split", "source", F.col("trains").alias("train_records"), F.col("exact").alias("exact_copies"),
        F.round("best", 6).alias("best_similarity"), F.round("cover", 6).alias("coverage"),
    )


def evaluation_counts(dataset: DataFrame) -> DataFrame:
    """``row_id, split, source, train_records, exact_copies`` of ``evaluation_records``."""
    return evaluation_records(dataset).drop("best_similarity", "coverage")


def by_split_and_source(dataset: DataFrame) -> DataFrame:
    """``split, source, records, overlapping, pairs, coverage``: all evaluation records by split and source.

    ``coverage`` is the mean, over the overlapping records, of their coverage in ``evaluation_records``.
    """
    linked, members = links(dataset)
    per_record = members.where(F.col("side") == EVALUATION).join(_per_class(linked, members), "rep", "left")
    counted = F.when(F.col("has_run"), F.col("trains"))
    return per_record.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(counted > 0).alias("overlapping"),
        F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias("pairs"),
        F.round(F.avg(F.when(counted > 0, F.col("cover"))), 6).alias("coverage"),
    )


def counts_by_split_and_source(dataset: DataFrame) -> DataFrame:
    """``by_split_and_source`` without coverage."""
    return by_split_and_source(dataset).drop("coverage")
