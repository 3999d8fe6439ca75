"""Shortened variants of explications and passages, as arrays that a caller explodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from primeloom.functions.text import strip

MASK = "<UNK>"


def explication_variants(text: Column, most: int = 2) -> Column:
    """``r, text``: without the last r lines, r from 1 to ``most`` (or the number of lines). One line gives one empty variant."""
    lines = F.split(strip(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(lines), F.lit(most))),
        lambda r: F.struct(r.alias("r"), F.array_join(F.slice(lines, F.lit(1), F.size(lines) - r), "\n").alias("text")),
    )


def passage_variants(text: Column, most: int = 2, mask: str = MASK) -> Column:
    """``r, text``: without the first r sentences that lack the mask; masked sentences stay. No such sentence, no variant."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), strip), lambda s: s != "")
    plain = F.filter(F.transform(sentences, lambda s, i: F.when(~F.contains(s, F.lit(mask)), i)), lambda i: i.isNotNull())
    steps = F.when(F.size(plain) > 0, F.sequence(F.lit(1), F.least(F.size(plain), F.lit(most)))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        steps,
        lambda r: F.struct(
            r.alias("r"),
            F.array_join(F.filter(sentences, lambda s, i: ~F.array_contains(F.slice(plain, F.lit(1), r), i)), ". ").alias("text"),
        ),
    )


def scorable(text: Column, mask: str = MASK) -> Column:
    return F.coalesce(F.contains(text, F.lit(mask)), F.lit(False))
