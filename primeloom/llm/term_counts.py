"""Problem 2: occurrences and records of every distinct word, with marks on words too rare or too common.

Method: range-partitioned external sort of (term, record) pairs with run-length scanning. Each task sorts the pairs of its
texts in runs and scans them at once (occurrences and distinct records of a term; a record lies whole in one task, so
counts of records add up). The scanned runs are sent to ranges of terms, sorted there (Spark's sort spills to disk) and
scanned again. As runs are scanned before they are sent, a word found in every record costs one row a task.

Defined cases: rows with a NULL key or NULL text are no records; a blank text is a record without words; re-delivered rows
count once; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.llm import pairs as P
from primeloom.llm import words as W

RARE_BELOW, COMMON_ABOVE = 3, 0.25
#: terms a task holds before it sends them on; about how many texts the bounds of the ranges are taken from (they only balance tasks)
HELD, BOUND_TEXTS = 500_000, 2_000


def texts(explications: DataFrame, dataset: DataFrame) -> DataFrame:
    """``text`` of every record of both tables that has one."""
    one = P.latest(explications.where(F.col("text").isNotNull()), "expl_id", "text")
    two = P.latest(dataset.where(F.col("explication").isNotNull()), "row_id", F.col("explication").alias("text"))
    return one.select("text").unionAll(two.select("text"))


def scan_runs(said: list[list[str]], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (term, record) pairs of some records, scanned: term numbers, occurrences, distinct records."""
    counts = np.fromiter(map(len, said), np.int64, len(said))
    term = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(said)), np.int64, counts.sum())
    pair = np.sort(term * len(said) + np.repeat(np.arange(len(said)), counts))
    begin = W.starts(pair)
    of = pair[begin] // max(len(said), 1)
    times = np.diff(np.append(begin, len(pair)))
    first = W.starts(of)
    return of[first], np.add.reduceat(times, first) if len(first) else times, np.diff(np.append(first, len(of)))


def count_terms(said: DataFrame, bound_texts: int = BOUND_TEXTS) -> DataFrame:
    """``term, occurrences, records`` of every word of the column ``text``."""
    n = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = min(1.0, bound_texts / max(said.count(), 1))
    seen = sorted({w for (t,) in said.sample(part, 7).collect() for w in W.words(t)})  # from all partitions alike
    bounds = [seen[len(seen) * i // n] for i in range(1, n)] if len(seen) >= n else []

    def send(held: dict[str, list[int]]) -> pa.RecordBatch:
        terms = list(held)
        occurrences, records = zip(*held.values()) if held else ([], [])
        part = [bisect_right(bounds, t) for t in terms]
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())],
            ["part", "term", "occurrences", "records"],
        )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            numbers: dict[str, int] = {}
            term, occurrences, records = scan_runs([W.words(t) for t in batch.column(0).to_pylist()], numbers)
            names = list(numbers)
            for i, o, r in zip(term.tolist(), occurrences.tolist(), records.tolist()):
                got = held.setdefault(names[i], [0, 0])
                got[0] += o
                got[1] += r
            if len(held) > HELD:
                yield send(held)
                held = {}
        yield send(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            done: list[list] = []
            for term, o, r in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if last and last[0] == term:
                    last[1] += o
                    last[2] += r
                else:
                    if last:
                        done.append(last)
                    last = [term, o, r]
            yield _rows(done)
        if last:
            yield _rows([last])

    return (
        said.select("text")
        .mapInArrow(runs, "part int, term string, occurrences long, records long")
        .repartitionById(n, F.col("part"))
        .select("term", "occurrences", "records")
        .sortWithinPartitions("term")
        .mapInArrow(scan, "term string, occurrences long, records long")
    )


def _rows(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["term", "occurrences", "records"])


def terms(explications: DataFrame, dataset: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """``term, occurrences, records, mark`` (``rare``, ``common`` or NULL) of every distinct word."""
    said = P.stored(texts(explications, dataset))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * said.count(), "common")
    return count_terms(said).select("term", "occurrences", "records", mark.alias("mark"))


def found(explications: DataFrame, dataset: DataFrame) -> DataFrame:
    """``term, mark`` of the marked words."""
    return terms(explications, dataset).where("mark IS NOT NULL").select("term", "mark")
