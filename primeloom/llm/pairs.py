"""Steps shared by the near-copy operators: one row a record, classes of equal texts, candidate pairs from buckets.

Buckets may be of any size. A bucket of more than ``BLOCK`` members is split by a hash of the member into blocks, and every
two blocks meet in a group of their own that is shuffled by itself, so no task has to hold a bucket and no pair is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from primeloom.sources.storage import kept, stored  # noqa: F401

BLOCK = 256
#: most ids that are broadcast: 8 bytes each, so 16 MB; more are shuffled
BROADCAST_IDS = 2_000_000
#: bits of a text's bit set of runs, and the longs that hold them
BITS, LONGS = 512, 8


def latest(df: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """One row of each non-null key: the last delivered, then the one with the least content hash (re-deliveries are equal).

    Only the columns asked for are read and hashed.
    """
    loaded = F.col("loaded_at") if "loaded_at" in df.columns else F.lit(None).cast("timestamp")
    asked = df.where(F.col(key).isNotNull()).select(key, loaded.alias("_loaded"), *columns)
    content = [c for c in asked.columns if c not in (key, "_loaded")]
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_loaded").desc_nulls_last(), F.xxhash64(*content) if content else F.lit(0)))
    return asked.withColumn("_turn", turn).where("_turn = 1").select(key, *content)


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (``id, digest, text`` and more) with equal text as classes: representatives and members.

    Representatives are the rows of the least id of each digest; members are all rows without text, with ``rep``. Only digests
    and ids meet per class, combined before the shuffle; texts are joined by the ids that stay.
    """
    first = records.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = records.join(first.select(F.col("rep").alias("id")), "id", "left_semi").drop("digest").withColumnRenamed("id", "rep")
    return reps, records.drop("text").join(first, "digest").drop("digest")


def meetings(rows: DataFrame, also: str = "true", block: int = BLOCK) -> DataFrame:
    """Every two members of a bucket, once a bucket: structs ``x`` and ``y`` of their columns, x.id < y.id.

    ``rows``: ``key, id`` and more, each key once an id. ``also``: a condition on x and y. Both sides come from one shuffle as
    long as ``also`` needs the same columns of both and has no part that can be moved to one of them. ``block``: members of a
    block; a member of a larger bucket is sent once a block of it.
    """
    carried = [c for c in rows.columns if c != "key"]
    every = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    # a bucket of one block is paired where it lies; only larger ones are shuffled again
    one, other = (every.where(f"_n > 1 AND _n <= {block}").select("key", F.struct(*carried).alias(s)) for s in "xy")
    small = one.join(other.hint("merge"), "key").where(f"x.id < y.id AND ({also})").select("x", "y")
    sized = every.where(f"_n > {block}")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    blocked = (
        sized.withColumn("_blocks", blocks)
        .withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("key", F.least("_blk", "_other").alias("_lo"), F.greatest("_blk", "_other").alias("_hi"), "_blk", *carried)
    )
    left, right = (
        blocked.select("key", "_lo", "_hi", F.col("_blk").alias(f"_{s}"), F.struct(*carried).alias(s)) for s in "xy"
    )
    met = left.join(right, ["key", "_lo", "_hi"]).where(f"x.id < y.id AND (_lo = _hi OR _x <> _y) AND ({also})")
    return small.unionAll(met.select("x", "y"))


def bit_set(value: np.ndarray, record: np.ndarray, n: int, size: int = BITS) -> np.ndarray:
    """For each of n records the bits its runs' hashes point at, of ``size`` bits (a power of two), as signed numbers of 64."""
    bits = np.zeros((n, size), np.uint8)
    bits[record, (value >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def promising(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a, b`` and more) whose sets of runs may agree by ``threshold`` or more; none that does is dropped.

    ``facts``: ``rep, runs`` (distinct runs), ``bits`` (their bit set). Each bit that only the one text has set stands for at
    least one run that only this text has, so the runs in common are at most all others.
    """
    left, right = (facts.select(F.col("rep").alias(s), F.col("runs").alias(f"_n{s}"), F.col("bits").alias(f"_s{s}")) for s in "ab")
    joined = pairs.join(left, "a").join(right, "b")

    def others(n: str, own: str, other: str) -> Column:
        return F.col(n) - reduce(Column.__add__, [F.bit_count(F.col(own)[i].bitwiseAND(F.bitwise_not(F.col(other)[i]))) for i in range(LONGS)])

    shared = F.least(others("_na", "_sa", "_sb"), others("_nb", "_sb", "_sa"))
    return joined.where(shared >= (F.col("_na") + F.col("_nb")) * (threshold / (1 + threshold)) - 1e-6).select(*pairs.columns)


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids`` (one column, each once). These are counted, and broadcast if they are few enough, so
    that rows with texts are left out where they are read, not shuffled first."""
    wanted = kept(ids.toDF(key))
    few = wanted.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def with_texts(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of representatives (``a, b`` and more) with both texts: ``ta, tb``. Only texts of some pair are shuffled."""
    held = kept(pairs)
    texts = only(reps.select("rep", "text"), held.select(F.explode(F.array("a", "b"))).distinct(), "rep")
    left, right = (texts.select(F.col("rep").alias(s), F.col("text").alias(f"t{s}")) for s in "ab")
    return held.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", *[c for c in pairs.columns if c not in ("a", "b")])


def expand(links: DataFrame, members: DataFrame, *kept: str) -> DataFrame:
    """Pairs of records from links between classes, and the pairs within each class. ``members``: ``rep, id`` and more.

    Large classes are split in blocks as buckets are, so the pairs of a class are made in many tasks.
    """
    fields = [c for c in members.columns if c != "rep"]
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    blocked = members.join(sizes, "rep").withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    within = meetings(blocked.where("_n > 1").select(F.col("rep").alias("key"), *fields)).select("x", "y", *[F.lit(1.0).alias(c) for c in kept])
    side = {s: blocked.select(F.col("rep").alias(s), F.col("_blk").alias(f"_{s}"), F.struct(*fields).alias(m)) for s, m in (("a", "x"), ("b", "y"))}
    split = links
    for s in "ab":
        split = split.join(sizes.select(F.col("rep").alias(s), F.col("_blocks").alias(f"_{s}s")), s)
    split = split.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_as") - 1))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1)))
    across = split.join(side["a"], ["a", "_a"]).join(side["b"], ["b", "_b"]).select("x", "y", *kept)
    ordered = F.col("x.id") < F.col("y.id")
    return across.unionByName(within).select(
        F.when(ordered, F.col("x")).otherwise(F.col("y")).alias("x"),
        F.when(ordered, F.col("y")).otherwise(F.col("x")).alias("y"),
        *kept,
    )
