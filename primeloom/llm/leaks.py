"""Problem 6: corpus documents that hold held-out evaluation texts, fully or in large part.

Method: each task indexes shards of its documents once (an FM-index over words) and searches the phrases of three words of all
items, block by block, by backward search through wavelet ranks; hits are located by sampled suffix positions, counted per
document and item, and merged to spans. A document is indexed whole in one shard; words no item holds become one separator
number, and stretches between separators that are too short for a phrase are left out, so the index covers exactly what a phrase can match.

The documents are read once, however many items there are: what is broadcast is the items' vocabulary (at most ``PASS_WORDS``
numbers of 8 bytes; only items with more words together need a further pass) and blocks of about ``BLOCK_WORDS`` words of items, of which
a task holds one at a time. Occurrences are reduced to documents and phrases before the items of a phrase are looked
up, and these are expanded in slices of about ``SLICE`` rows.

Defined cases: NULL text, NULL keys and items of fewer than three words match nothing; equal texts under several ids count for
each id; equal (doc_id, text) rows count once; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from primeloom.llm import words as W
from primeloom.llm.fm_index import FMIndex
from primeloom.sources.storage import kept

PHRASE, SHARE, BLOCK_WORDS, PASS_WORDS, SHARD_WORDS, SLICE = 3, 0.5, 500_000, 8_000_000, 1_000_000, 2_000_000
HITS = "doc_id long, item_id long, hits long, phrases long, spans array<struct<first:int,last:int>>"


class Numbers(dict):
    """The number of each word, from 1 by its hash's place among the vocabulary's, 0 for others; emptied when it is large."""

    def __init__(self, vocabulary: np.ndarray, limit: int = 1_000_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        i = int(np.searchsorted(self.vocabulary, h))
        self[word] = n = i + 1 if i < len(self.vocabulary) and self.vocabulary[i] == h else 0
        return n


class Phrases:
    """Distinct phrases of a block of items over numbered words, and which items hold each."""

    def __init__(self, items: list[int], runs: list[np.ndarray], k: int = PHRASE):
        """``runs``: for each item its distinct phrases, k numbers each, one after the other."""
        self.items = np.array(items, np.int64)
        self.total = np.array([len(r) // k for r in runs], np.int64)
        every = (np.concatenate(runs) if runs else np.zeros(0, np.int64)).reshape(-1, k)
        self.phrases, phrase = np.unique(every, axis=0, return_inverse=True)
        holder = np.repeat(np.arange(len(items)), self.total)
        order = np.argsort(phrase.ravel(), kind="stable")
        self.holders, self.begin = holder[order], np.searchsorted(phrase.ravel()[order], np.arange(len(self.phrases) + 1))


def reduced(ids: np.ndarray, doc: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keeps stretches of at least k numbered words within one document, each closed by a 0."""
    n = len(ids)
    if not n:
        return ids, doc, word
    broken = np.append(True, (doc[1:] != doc[:-1]) | ((ids[1:] == 0) != (ids[:-1] == 0)))
    begin = np.flatnonzero(broken)
    size = np.diff(np.append(begin, n))
    keep = (ids[begin] > 0) & (size >= k)
    kept_ = np.repeat(keep, size)
    ends = np.cumsum(size[keep])
    return tuple(np.insert(x[kept_], ends, fill) for x, fill in ((ids, 0), (doc, -1), (word, -1)))


def _ranges(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    """low, low + 1 ... of each range, so many times each, one after the other."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)


def spans(first: np.ndarray, k: int) -> list[dict[str, int]]:
    """Merged stretches of words (first and last, from 0) covered by phrases of k words."""
    first = np.unique(first)
    cut = np.flatnonzero(np.append(True, first[1:] > first[:-1] + k))
    ends = np.append(cut[1:], len(first)) - 1
    return [{"first": int(a), "last": int(b) + k - 1} for a, b in zip(first[cut], first[ends])]


def search(index: FMIndex, doc: np.ndarray, word: np.ndarray, of: Phrases, k: int, share: float, size: int = SLICE) -> Iterator[tuple]:
    """``document number, item_id, hits, phrases, spans`` of the pairs in a shard that share enough phrases of a block of items."""
    low, high = index.search(of.phrases)
    times = high - low
    place = index.locate(_ranges(low, times))  # no more than the shard has words: one phrase begins at each
    at, phrase, first = doc[place], np.repeat(np.arange(len(times)), times), word[place]
    order = np.lexsort((first, phrase, at))
    at, phrase, first = at[order], phrase[order], first[order]
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (phrase[1:] != phrase[:-1]))) if len(at) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(at))
    held = of.begin[phrase[begin] + 1] - of.begin[phrase[begin]] if len(begin) else begin
    # whole documents are expanded together, as many as fit a slice
    documents = np.flatnonzero(np.append(True, at[begin][1:] != at[begin][:-1])) if len(begin) else begin
    weight = np.cumsum(held)
    start = 0
    while start < len(documents):
        done = weight[documents[start]] - held[documents[start]]
        last = max(int(np.searchsorted(weight, done + size)), documents[start])
        stop = max(start + 1, int(np.searchsorted(documents, last, "right")) - 1)
        stop = len(documents) if last >= len(begin) else stop
        part = np.arange(documents[start], documents[stop] if stop < len(documents) else len(begin))
        start = stop
        item = of.holders[_ranges(of.begin[phrase[begin[part]]], held[part])]
        row = np.repeat(part, held[part])
        order = np.lexsort((row, item, at[begin[row]]))
        row, item = row[order], item[order]
        pair = at[begin[row]] * len(of.items) + item
        a = W.starts(pair)
        hits = np.diff(np.append(a, len(pair)))
        for p in np.flatnonzero(hits >= share * of.total[item[a]]).tolist():
            rows = row[a[p] : a[p] + hits[p]]
            places = first[_ranges(begin[rows], ends[rows] - begin[rows])]
            yield int(at[begin[rows[0]]]), int(of.items[item[a[p]]]), int(hits[p]), int(of.total[item[a[p]]]), spans(places, k)


def _block(b: Broadcast) -> Phrases:
    """A block of items, not kept in the worker's memory beside the next."""
    return b.load_from_path(b._path) if getattr(b, "_path", None) and not hasattr(b, "_value") else b.value


def item_hashes(items: DataFrame, k: int) -> DataFrame:
    """``item_id, text, words, h``: number and hashes of the distinct words of items of k words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordHash()
        for batch in batches:
            said = [W.words(t) for t in batch.column(1).to_pylist()]
            use = [i for i, w in enumerate(said) if len(w) >= k]
            hashes = [W.signed(np.unique(np.fromiter(map(known.__getitem__, said[i]), np.uint64, len(said[i])))).tolist() for i in use]
            words = pa.array([len(said[i]) for i in use], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(use, pa.int64())) for c in batch.columns), words, pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "text", "words", "h"])

    return items.mapInArrow(run, "item_id long, text string, words long, h array<long>")


def item_phrases(items: DataFrame, vocabulary: np.ndarray, k: int) -> DataFrame:
    """``item_id, runs``: the distinct phrases of each item, k numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(vocabulary)
        for batch in batches:
            runs = [[n for p in sorted(W.shingle_set([numbers[w] for w in W.words(t)], k)) for n in p] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.int32()))], ["item_id", "runs"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, runs array<int>")


def leaks(documents: DataFrame, items: DataFrame, k: int = PHRASE, share: float = SHARE, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """``doc_id, item_id, hits, phrases, spans``: pairs in which at least ``share`` of the item's distinct phrases occur."""
    own = kept(item_hashes(items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct(), k))
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    words = own.agg(F.sum("words")).first()[0] or 0
    passes = max(1, -(-words // pass_words))
    blocks = max(1, -(-words // (passes * block_words)))
    placed = own.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    return reduce(DataFrame.unionAll, [_search(docs, placed.where(F.col("pass") == p), blocks, k, share) for p in range(passes)])


def _search(docs: DataFrame, own: DataFrame, blocks: int, k: int, share: float) -> DataFrame:
    hashes = own.select(F.explode("h").alias("h")).distinct().toPandas()["h"]  # no more than a pass has words
    vocabulary = np.sort(hashes.to_numpy(np.int64).view(np.uint64))
    context = own.sparkSession.sparkContext
    phrases = kept(item_phrases(own, vocabulary, k).withColumn("block", F.pmod(F.xxhash64("item_id", "runs"), F.lit(blocks))))
    sent = context.broadcast(vocabulary)
    held = []
    for b in range(blocks):
        rows = phrases.where(F.col("block") == b).select("item_id", "runs").toPandas()
        rows = rows.sort_values("item_id", kind="stable")
        held.append(context.broadcast(Phrases(rows["item_id"].tolist(), [np.asarray(r, np.int64) for r in rows["runs"]], k)))

    def shard(keys: list[int], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, doc, word = (np.concatenate(x) for x in zip(*parts))
        if not len(ids):
            return
        index = FMIndex(ids, len(sent.value) + 1)
        for b in held:
            of = _block(b)
            got = [(keys[d], *rest) for d, *rest in search(index, doc, word, of, k, share)] if len(of.phrases) else []
            columns = list(zip(*got)) if got else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "hits", "phrases", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(sent.value)
        keys: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            said = [W.words(t) for t in batch.column(1).to_pylist()]
            counts = np.fromiter(map(len, said), np.int64, len(said))
            total = int(counts.sum())
            ids = np.fromiter((n for w in said for n in map(numbers.__getitem__, w)), np.int64, total)
            doc = np.repeat(np.arange(len(said)), counts)
            word = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            part = reduced(ids, doc + len(keys), word, k)
            keys += batch.column(0).to_pylist()
            parts.append(part)
            size += len(part[0])
            if size >= SHARD_WORDS:
                yield from shard(keys, parts)
                keys, parts, size = [], [], 0
        if parts:
            yield from shard(keys, parts)

    return docs.mapInArrow(run, HITS)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, first_word, last_word, items``: what to remove from each document, spans of all its items merged.

    Words are counted from 0, as this package defines words. A document's spans are sorted (and spilt), never held in a list.
    """
    each = leaks(documents, items).select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", "s.first", "s.last")
    order = Window.partitionBy("doc_id").orderBy("first", "last", "item_id")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = each.withColumn("_new", (before.isNull() | (F.col("first") > before + 1)).cast("int"))
    return (
        fresh.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_span")
        .agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.sort_array(F.collect_set("item_id")).alias("items"))
        .drop("_span")
    )


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, documents, best_share``: every item that leaked."""
    return leaks(documents, items).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("documents"), F.round(F.max(F.col("hits") / F.col("phrases")), 6).alias("best_share")
    )
