"""Problem 8: reading level of each document, from vocabulary coverage and sentence complexity.

Method: the words of all English documents are ranked by frequency. The coverage rank of a stretch of text is the size of the
smallest frequency-ranked vocabulary that covers ``COVER`` of its words. It is taken, with words per sentence and characters
per word, for each sentence of the document's own prose, and for these sentences together; graded documents give, in SQL, the
middle and spread of the measures for each level. A sentence gets the level it lies nearest to; the document gets the level with the
greatest part of its words, less ``WEIGHT`` times the distance of the document's own coverage rank from that level's.

A word's rank is the number of words that are at least as frequent. The ``RANKED`` most frequent words are sent to the tasks; where a
coverage rank lies beyond them, the words concerned are joined with the ranks of all words.

Own prose: sentences that begin with a capital letter and end with a final mark, on lines that are no list items. Headings,
footers and paraphrase lines fail this; passages from elsewhere stay a minority of the words. A document without any such
sentence is taken as it is.

Defined cases: several grades of one document count as their median, NULL grades don't count; NULL text, other languages and
texts under ``LEAST_WORDS`` give no row; without any grade the level is NULL; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from primeloom.llm import words as W
from primeloom.sources.storage import kept

COVER, LEAST_WORDS, RANKED, HELD, WEIGHT, FURTHEST = 0.8, 60, 50_000, 500_000, 0.02, 16.0
_BETWEEN = re.compile(r"(?<=[.!?])[\"”’)]?\s+")
_OPENING, _CLOSING, _FINAL = "\"“‘(«", "\"”’)»", (".", "!", "?")
MEASURES = ("words", "rank", "chars")


def english(documents: DataFrame) -> DataFrame:
    return documents.where((F.lower(F.trim("lang")) == "en") & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``; counted per task before the shuffle."""

    def send(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(W.words(" \n".join(batch.column(0).to_pylist())))
            if len(held) > HELD:
                yield send(held)
                held = Counter()
        yield send(held)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_ranks(docs: DataFrame) -> DataFrame:
    """``word, rank`` of all words. Ranks come from how many words have each count, of which there are few."""
    counts = kept(word_counts(docs))
    as_frequent = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).select("n", F.sum("words").over(as_frequent).alias("rank"))
    return counts.join(by_count, "n").select("word", "rank")


def own_sentences(text: str) -> list[str]:
    found, rest = [], []
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        rest.append(line)
        if not line.lstrip(_OPENING)[:1].isupper():
            continue
        for part in _BETWEEN.split(line):
            head = part[:1] if part[:1].isalpha() else part.lstrip(_OPENING)[:1]
            if head.isupper() and (part.endswith(_FINAL) or part.rstrip(_CLOSING).endswith(_FINAL)):
                found.append(part)
    return found or rest


def coverage_rank(ranks: np.ndarray, group: np.ndarray, cover: float = COVER) -> np.ndarray:
    """For each group (sorted, from 0, none empty): size of the smallest vocabulary that covers ``cover`` of its words."""
    order = np.lexsort((ranks, group))
    begin = W.starts(group)
    size = np.diff(np.append(begin, len(group)))
    return ranks[order][begin + np.ceil(cover * size - 1e-9).astype(np.int64) - 1]


def sentence_measures(docs: DataFrame, ranks: DataFrame, least_words: int = LEAST_WORDS, ranked: int = RANKED) -> DataFrame:
    """``doc_id, n_words, doc_rank, sentences``: array of ``words, rank, chars`` of own sentences; ``doc_rank`` is theirs together.

    ``n_words`` counts the own sentences, or the whole text where they hold fewer than ``least_words``.
    """
    rank_of = {r["word"]: r["rank"] for r in ranks.where(F.col("rank") <= ranked).collect()}  # no more than ``ranked``
    beyond = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, totals, counts, per_doc, found, chars, flat = [], [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [w for w in (W.words(s) for s in own_sentences(text)) if w]
                n = sum(map(len, own))
                n = n if n >= least_words else len(W.words(text))
                if n < least_words or not own:
                    continue
                keys.append(key)
                totals.append(n)
                per_doc.append(len(own))
                for w in own:
                    counts.append(len(w))
                    chars.append(sum(map(len, w)) / len(w))
                    found += [rank_of.get(x, beyond) for x in w]
                    flat += w
            counts_, ranks_ = np.array(counts, np.int64), np.array(found, np.int64)
            sentence = np.repeat(np.arange(len(counts_)), counts_)
            doc_of = np.repeat(np.arange(len(keys)), per_doc)
            rank = coverage_rank(ranks_, sentence) if len(keys) else ranks_
            doc_rank = coverage_rank(ranks_, doc_of[sentence]) if len(keys) else ranks_
            # of sentences and documents whose rank lies beyond the table: their rarer words, to be ranked by a join
            rarer: list[list[str]] = [[] for _ in counts_]
            late = (rank == beyond) | (doc_rank == beyond)[doc_of] if len(keys) else rank == beyond
            for i in np.flatnonzero((ranks_ == beyond) & late[sentence]).tolist() if len(keys) else ():
                rarer[sentence[i]].append(flat[i])
            columns = [pa.array(counts_, pa.int64()), pa.array(np.where(rank == beyond, -1, rank), pa.int64()), pa.array(chars, pa.float64()), pa.array(rarer, pa.list_(pa.string()))]
            structs = pa.StructArray.from_arrays(columns, [*MEASURES, "rarer"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(per_doc))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(totals, pa.int64()), pa.array(np.where(doc_rank == beyond, -1, doc_rank), pa.int64()), pa.ListArray.from_arrays(offsets, structs)],
                ["doc_id", "n_words", "doc_rank", "sentences"],
            )

    made = docs.mapInArrow(run, "doc_id long, n_words long, doc_rank long, sentences array<struct<words:long,rank:long,chars:double,rarer:array<string>>>")
    return _ranked_beyond(kept(made), ranks)


def _ranked_beyond(made: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks of -1 replaced by the exact ones: the n-th rarest word of a sentence or document decides, so its rarer words are enough."""
    plain = F.transform("sentences", lambda s: F.struct(*[s[c].alias(c) for c in MEASURES]))
    done = F.col("doc_rank") > 0
    whole = made.where(done & ~F.exists("sentences", lambda s: s["rank"] < 0)).select("doc_id", "n_words", "doc_rank", plain.alias("sentences"))
    late = made.where(~done | F.exists("sentences", lambda s: s["rank"] < 0)).withColumn("_row", F.monotonically_increasing_id())
    words = late.select("_row", F.posexplode("sentences").alias("_s", "s")).select("_row", "_s", F.explode("s.rarer").alias("word"))
    held = words.join(ranks, "word").groupBy("_row", "_s").agg(F.sort_array(F.collect_list("rank"), asc=False).alias("r"))  # a sentence's words
    nth = lambda n: (n - F.ceil(F.lit(COVER) * n - 1e-9) + 1).cast("int")  # noqa: E731  its place from the rarest
    per_doc = held.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_s", "r"))).alias("m"), F.sort_array(F.flatten(F.collect_list("r")), asc=False).alias("all"))
    fixed = late.join(per_doc, "_row", "left")
    ranked = F.transform(
        "sentences",
        lambda s, i: F.struct(s["words"].alias("words"), F.when(s["rank"] < 0, F.try_element_at(F.try_element_at("m", i), nth(s["words"]))).otherwise(s["rank"]).alias("rank"), s["chars"].alias("chars")),
    )
    total = F.aggregate("sentences", F.lit(0).cast("long"), lambda acc, s: acc + s["words"])
    doc_rank = F.when(done, F.col("doc_rank")).otherwise(F.try_element_at("all", nth(total)))
    return whole.unionByName(fixed.select("doc_id", "n_words", doc_rank.alias("doc_rank"), ranked.alias("sentences")))


def _scaled() -> dict[str, Column]:
    return {"words": F.log("s.words"), "rank": F.log("s.rank"), "chars": F.log(F.greatest("s.chars", F.lit(1.0)))}


def _middle(columns: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Aggregates of each column's quarters, and from these its middle and spread."""
    quarters = [F.percentile_approx(k, [0.25, 0.5, 0.75]).alias(k) for k in columns]
    return quarters, [x for k in columns for x in (F.col(k)[1].alias(f"{k}_mid"), F.greatest((F.col(k)[2] - F.col(k)[0]) / 1.349, F.lit(0.1)).alias(f"{k}_spread"))]


def calibrate(docs: DataFrame, labels: DataFrame, ranks: DataFrame) -> DataFrame:
    """``level`` and, for each measure, middle and spread over the sentences of the documents graded so, and for ``doc`` over
    their coverage ranks. At most one row a level."""
    grade = (
        labels.where("doc_id IS NOT NULL AND reading_level IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.round(F.median("reading_level")).cast("int").alias("level"))
    )
    graded = sentence_measures(docs.join(grade.select("doc_id"), "doc_id", "left_semi"), ranks).join(grade, "doc_id")
    each = graded.select("level", F.explode("sentences").alias("s")).select("level", *[c.alias(k) for k, c in _scaled().items()])
    (quarters, spread), (whole, far) = _middle(MEASURES), _middle(("doc",))
    of_documents = graded.select("level", F.log("doc_rank").alias("doc")).groupBy("level").agg(*whole).select("level", *far)
    return each.groupBy("level").agg(*quarters).select("level", *spread).join(of_documents, "level")


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, reading_level, n_words, coverage_rank, words_per_sentence, share`` of every English document of 60 words or more.

    ``share`` is the part of its own prose that has the level; ties go to the lower level.
    """
    docs = english(documents)
    ranks = kept(word_ranks(docs))
    fits = calibrate(docs, labels, ranks).orderBy("level").collect()  # at most one row a level
    each = sentence_measures(docs, ranks).select("doc_id", "n_words", "doc_rank", F.explode("sentences").alias("s"))
    scaled = each.select("doc_id", "n_words", "doc_rank", F.col("s.words").alias("w"), *[c.alias(k) for k, c in _scaled().items()])
    distance = [
        F.struct(
            sum((F.pow((F.col(k) - r[f"{k}_mid"]) / r[f"{k}_spread"], 2) + 2 * float(np.log(r[f"{k}_spread"])) for k in MEASURES), F.lit(0.0)).alias("d"),
            F.lit(r["level"]).alias("level"),
        )
        for r in fits
    ]
    nearest = (F.least(*distance) if len(distance) > 1 else distance[0])["level"] if distance else F.lit(None).cast("int")
    far = F.lit(0.0)
    for r in fits:
        far = F.when(F.col("level") == r["level"], F.least(F.pow((F.log("doc_rank") - r["doc_mid"]) / r["doc_spread"], 2), F.lit(FURTHEST))).otherwise(far)
    per_level = scaled.withColumn("level", nearest).groupBy("doc_id", "n_words", "doc_rank", "level").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("doc_id", "n_words", "doc_rank")  # at most one row a level
    scored = per_level.withColumn("all", F.sum("w").over(every)).withColumn("score", F.col("w") / F.col("all") - WEIGHT * far)
    best = F.max(F.struct("score", (-F.col("level")).alias("o"), "w"))
    return scored.groupBy("doc_id").agg(best.alias("b"), F.first("n_words").alias("n_words"), F.first("doc_rank").alias("coverage_rank"), F.sum("w").alias("all"), F.sum("n").alias("n")).select(
        "doc_id",
        (-F.col("b.o")).alias("reading_level"),
        "n_words",
        "coverage_rank",
        F.round(F.col("all") / F.col("n"), 4).alias("words_per_sentence"),
        F.round(F.col("b.w") / F.col("all"), 4).alias("share"),
    )


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, reading_level``."""
    return levels(documents, labels).select("doc_id", "reading_level")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``source, reading_level, documents, words, coverage_rank, words_per_sentence``."""
    named = documents.select("doc_id", F.lower(F.trim("source")).alias("source"))
    return (
        levels(documents, labels)
        .join(named, "doc_id")
        .groupBy("source", "reading_level")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum("n_words").alias("words"),
            F.round(F.avg("coverage_rank"), 2).alias("coverage_rank"),
            F.round(F.avg("words_per_sentence"), 2).alias("words_per_sentence"),
        )
    )
