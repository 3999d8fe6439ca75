"""Grading conditions: every scorable passage without explication, and with each explication in five slots.

Slots: -1 passage alone; 0 passage and explication; 1, 2 explication without its last lines; 3, 4 passage without its first
sentences. Variants are computed once per explication and passage, before they are joined on the entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.functions import truncate as T


def conditions(explications: DataFrame, passages: DataFrame) -> DataFrame:
    """``entry_id, passage_id, expl_id, model, slot, lines_removed, passage, explication``.

    ``explications``: ``expl_id, entry_id, model, text``; ``passages``: ``entry_id, passage_id, text``. Passages without mask
    and explications without scorable passage give no row.
    """
    masked = passages.where(T.scorable(F.col("text"))).select(
        "entry_id", "passage_id", F.col("text").alias("passage"), T.passage_variants(F.col("text")).alias("passages")
    )
    described = explications.where("entry_id IS NOT NULL").select(
        "expl_id", "entry_id", "model", F.coalesce("text", F.lit("")).alias("explication"), T.explication_variants(F.col("text")).alias("shorter")
    )
    slot = "struct<slot:int,lines_removed:int,passage:string,explication:string>"

    def row(n, removed, passage, explication):
        return F.struct(n.alias("slot"), removed.alias("lines_removed"), passage.alias("passage"), explication.alias("explication")).cast(slot)

    slots = F.concat(
        F.array(row(F.lit(0), F.lit(0), F.col("passage"), F.col("explication"))),
        F.transform("shorter", lambda v: row(v["r"], v["r"], F.col("passage"), v["text"])),
        F.transform("passages", lambda v: row(v["r"] + 2, v["r"], v["text"], F.col("explication"))),
    )
    paired = described.join(masked, "entry_id").select("entry_id", "passage_id", "expl_id", "model", F.explode(slots).alias("s"))
    full = paired.select("entry_id", "passage_id", "expl_id", "model", "s.slot", "s.lines_removed", "s.passage", "s.explication")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("expl_id", "long"), ("model", "string"))]
    base = masked.select("entry_id", "passage_id", *none, F.lit(-1).alias("slot"), F.lit(None).cast("int").alias("lines_removed"), "passage", F.lit(None).cast("string").alias("explication"))
    return base.unionByName(full)
