"""Circularity by a table of lemmas: any number of forms, joined, not looked up row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: suffixes that a form may have beyond its lemma, tried in this order, and the least letters of a lemma
SUFFIXES, LEAST = ("ing", "ed", "es", "s"), 3


def lemma_table(forms: DataFrame) -> DataFrame:
    """``form, lemma`` of the words (``form``, each once) that are another of the words with a suffix. A plain rule where no
    table of a language's lemmas is at hand."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SUFFIXES)]))
    stems = forms.select("form", each.alias("e")).where(F.col("form").endswith(F.col("e.s")) & (F.length("form") - F.length("e.s") >= LEAST))
    stems = stems.select("form", "e.i", F.expr("left(form, length(form) - length(e.s))").alias("lemma"))
    known = stems.join(forms.select(F.col("form").alias("lemma")), "lemma", "left_semi")
    return known.groupBy("form").agg(F.min_by("lemma", "i").alias("lemma"))


def circular(rows: DataFrame, table: DataFrame, key: str = "expl_id") -> DataFrame:
    """``key, uses_original_word``: whether a token has the lemma of the target's first token; NULL without a target.

    ``rows``: ``key, target, toks``; ``table``: ``form, lemma``, each form once; forms it lacks are their own lemma.
    """
    lemma = lambda c: F.coalesce("lemma", F.col(c))
    said = rows.select(key, F.explode(F.array_distinct("toks")).alias("form")).join(table, "form", "left").select(key, lemma("form").alias("l"))
    wanted = rows.select(key, F.try_element_at("target", F.lit(1)).alias("form")).join(table, "form", "left").select(key, lemma("form").alias("w"))
    hit = said.join(wanted.where("w IS NOT NULL"), key).where("l = w").select(key).distinct().withColumn("hit", F.lit(True))
    return wanted.join(hit, key, "left").select(key, F.when(F.col("w").isNotNull(), F.coalesce("hit", F.lit(False))).alias("uses_original_word"))
