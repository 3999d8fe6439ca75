"""Problem 7: a mixture of sources with target shares, measured in tokens of a public tokenizer.

Method: subset-sum budget fitting. Documents are counted by exact token length; a source whose budget exceeds its tokens is
used whole as often as that takes; for the rest of the budget as many documents of each length are taken as keeps the lengths'
proportions, and what then is left is filled by bounded-knapsack dynamic programming over the documents of each length still
free. Documents of a length are chosen in the order of a seeded hash.

Size of the mixture: ``total_tokens``, or by default the largest at which every source with documents reaches its share under
its ``max_repeats``. Targets of sources without documents can't be met; the others' shares are scaled up to sum to 1
(``feasible_share``), and the target stays beside the actual share.

Defined cases: sources are compared in lower case without outer blanks; documents of a NULL source or one without target, with
NULL text or NULL key, or of no token aren't used; two targets of one name count together; a NULL or negative share counts as
0, a NULL ``max_repeats`` as 1; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from primeloom.llm import pairs as P

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how that vocabulary splits text before it merges bytes
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED, WINDOW, RANKED_AT_ONCE = 20_240, 16_384, 50_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of the documents that have a target. The vocabulary file lies on the driver and is sent with the job."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            tokens = pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], ["doc_id", "source", "tokens"])

    named = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    wanted = named.join(targets.select("source"), "source", "left_semi").select("doc_id", "source", "text")
    return wanted.mapInArrow(run, "doc_id long, source string, tokens long").where("tokens > 0")


def clean_targets(targets: DataFrame) -> DataFrame:
    return (
        targets.where("source IS NOT NULL")
        .groupBy(F.lower(F.trim("source")).alias("source"))
        .agg(
            F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
            F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).cast("int").alias("max_repeats"),
        )
    )


def reachable(lengths: list[int], free: list[int], goal: int) -> dict[int, int]:
    """Bounded knapsack: how many of each length to take so that their sum is the greatest one not above ``goal``.

    Sums are the bits of one integer; the counts of a length are split in powers of two, so a step is a shift and an or.
    """
    mask = (1 << (goal + 1)) - 1
    sums, steps = 1, []
    for length, most in zip(lengths, free):
        most, part = min(most, goal // length), 1
        while most > 0:
            take = min(part, most)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            most, part = most - take, part * 2
        if sums >> goal & 1:
            break
    at, taken = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, once each at most, for a sum as near below ``budget`` as can be.

    A budget of up to 4 * ``window`` is met as nearly as any choice meets it. Of a larger one the lengths' proportions take all but
    the last ``window`` tokens; where no choice among the documents still free meets these exactly, taken ones are
    given back, until one does or 4 * ``window`` tokens are chosen anew.
    """
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    order = np.argsort(lengths, kind="stable")
    lengths_, index = lengths[order].tolist(), {int(x): i for i, x in enumerate(lengths)}
    taken = (counts * (max(budget - window, 0) / whole)).astype(np.int64) if budget > 4 * window else counts * 0
    left = budget - int((lengths * taken).sum())
    while left > 2 * window and budget > 4 * window:  # what rounding down left over: one more of each length, longest first
        before = left
        for i in np.argsort(-lengths, kind="stable"):
            more = min(int(counts[i] - taken[i]), max(left - window, 0) // int(lengths[i]), max(1, left // (2 * whole // max(len(lengths), 1) + 1)))
            taken[i] += more
            left -= more * int(lengths[i])
        if left == before:
            break
    while True:
        chosen = reachable(lengths_, (counts - taken)[order].tolist(), left if left <= 4 * window else 4 * window)
        rest = left - sum(length * n for length, n in chosen.items())
        give = np.flatnonzero(taken)
        if rest == 0 or not len(give) or left >= 3 * window:
            break
        for i in give[np.argsort(-(lengths * (taken > 0))[give], kind="stable")]:
            taken[i] -= 1
            left += int(lengths[i])
            if left >= 3 * window or rest == 0:
                break
    for length, n in chosen.items():
        taken[index[length]] += n
    return taken


def budgets(lengths: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target: documents, tokens, feasible share, budget, ``passes`` over the whole source and ``rest`` of the budget."""
    have = lengths.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    t = targets.join(have, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens")]
    )
    every = Window.partitionBy()  # over the targets: one row a source
    usable = (F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    share = F.when(usable, F.try_divide("target_share", F.sum(F.when(usable, F.col("target_share"))).over(every))).otherwise(0.0)
    most = F.min(F.when(usable, F.col("tokens") * F.col("max_repeats") / F.col("feasible_share"))).over(every)
    total = F.lit(float(total_tokens)) if total_tokens is not None else most
    budget = F.least(F.floor(F.col("feasible_share") * F.col("total") + F.lit(1e-6)), F.col("tokens") * F.col("max_repeats"))
    return (
        t.withColumn("feasible_share", share)
        .withColumn("total", F.coalesce(total, F.lit(0.0)))
        .withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long"))
        .withColumn("passes", F.coalesce(F.try_divide("budget", "tokens").cast("long"), F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .drop("total")
    )


def take_by_length(lengths: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, tokens, n, passes, take``. A group is one source's distinct lengths, which the longest document bounds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tokens")
        rows["take"] = fit_budget(rows["tokens"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rows["rest"].iloc[0]))
        return rows[["source", "tokens", "n", "passes", "take"]]

    return (
        lengths.join(plan.where("budget > 0").select("source", "passes", "rest"), "source")
        .groupBy("source")
        .applyInPandas(run, "source string, tokens long, n long, passes long, take long")
    )


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """``doc_id, source, tokens, uses``: every document that could be drawn and how often it is (0: left out)."""
    return _draw(*_prepare(documents, targets, vocabulary), total_tokens, seed)


def _prepare(documents: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wanted = clean_targets(targets)
    docs = P.kept(sized(documents, wanted, vocabulary))  # three numbers a document; texts are tokenised once
    return docs, docs.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), wanted


def _draw(docs: DataFrame, lengths: DataFrame, wanted: DataFrame, total_tokens: int | None, seed: int) -> DataFrame:
    take = take_by_length(lengths, budgets(lengths, wanted, total_tokens))
    # documents of one length in the order of their hash; a length with very many documents is cut into slices of the hash's
    # range, and only the slice in which the count is reached is sorted
    slices = F.ceil(F.col("n") / RANKED_AT_ONCE)
    keyed = docs.join(take, ["source", "tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("slice", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * slices).cast("long"))
    per_slice = keyed.groupBy("source", "tokens", "slice").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("source", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.join(per_slice.select("source", "tokens", "slice", F.coalesce(before, F.lit(0)).alias("before")), ["source", "tokens", "slice"])
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "slice").orderBy("h", "doc_id")) + F.col("before")
    uses = F.col("passes") + (F.col("rank") <= F.col("take")).cast("long")
    return placed.withColumn("rank", rank).withColumn("uses", F.greatest(uses, F.lit(0))).select("doc_id", "source", "tokens", "uses")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a target: target, feasible and actual share, budget, tokens and documents drawn, most uses of a document."""
    docs, lengths, wanted = _prepare(documents, targets, vocabulary)
    plan = budgets(lengths, wanted, total_tokens)
    drawn = (
        take_by_length(lengths, plan)
        .groupBy("source")
        .agg(
            F.sum(F.col("tokens") * (F.col("passes") * F.col("n") + F.col("take"))).alias("drawn_tokens"),
            F.sum(F.when(F.col("passes") > 0, F.col("n")).otherwise(F.col("take"))).alias("drawn_documents"),
            F.max(F.col("passes") + (F.col("take") > 0).cast("long")).alias("most_uses"),
        )
    )
    joined = plan.join(drawn, "source", "left")
    every = Window.partitionBy()  # one row a target
    return joined.select(
        "source",
        F.round("target_share", 9).alias("target_share"),
        F.round("feasible_share", 9).alias("feasible_share"),
        "documents",
        F.col("tokens").alias("source_tokens"),
        "budget",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("drawn_tokens", "drawn_documents", "most_uses")],
        F.round(F.coalesce(F.try_divide(F.coalesce("drawn_tokens", F.lit(0)), F.sum("drawn_tokens").over(every)), F.lit(0.0)), 9).alias("actual_share"),
        "max_repeats",
    )
