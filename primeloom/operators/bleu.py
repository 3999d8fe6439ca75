"""Sentence BLEU from clipped n-gram counts: order 4, effective order, exponential smoothing, 0 to 100.

The definition is this library's own: default tokens, one reference; 0 where no n-gram agrees; NULL texts count as empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.functions.text import tokens

ORDER = 4


def grams(words: Sequence[str], order: int = ORDER) -> list[Counter]:
    """How often each n-gram stands in a token list, for each n from 1 on."""
    return [Counter(zip(*(words[s:] for s in range(n)))) for n in range(1, order + 1)]


def score(hypothesis: Sequence[str], reference: Sequence[str], order: int = ORDER, known: list[Counter] | None = None) -> float:
    """BLEU of two token lists; each n-gram is counted once, so the work grows with their lengths. ``known``: ``grams`` of the reference."""
    known = known or grams(reference, order)
    hits, logs, used, missed = 0, 0.0, 0, 0
    for n in range(1, order + 1):
        total = len(hypothesis) - n + 1
        if total <= 0:
            break
        own = Counter(zip(*(hypothesis[s:] for s in range(n))))
        other = known[n - 1]
        clipped = sum(min(c, other[g]) for g, c in own.items() if g in other)
        hits += clipped
        missed += clipped == 0
        logs += math.log(clipped / total if clipped else 1.0 / (2.0**missed * total))
        used += 1
    if not hits:
        return 0.0
    brevity = math.exp(1 - len(reference) / len(hypothesis)) if len(hypothesis) < len(reference) else 1.0
    return 100.0 * brevity * math.exp(logs / used)


def sentence_bleu(pairs: DataFrame, hypothesis: str, reference: str, name: str = "bleu", order: int = ORDER) -> DataFrame:
    """The rows with ``name`` added; made in Arrow batches within the row, without a shuffle."""

    @F.pandas_udf("double")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, r in batches:
            yield pd.Series([score(list(x), list(y), order) for x, y in zip(h, r)])

    return pairs.withColumn(name, made(tokens(F.col(hypothesis)), tokens(F.col(reference))))
