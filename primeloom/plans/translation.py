"""Round-trip translation as an evaluation: texts by language, there and back, and how much of them is left.

Scores are a long table, one row a text and language; arrays by language are made only where a result file asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primeloom.functions.text import tokens
from primeloom.operators import bleu, plugins

METRICS = ("bleu", "embed", "metric")


def by_language(texts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Each text once a language: ``lang_ord, lang`` beside its columns. No language gives no row."""
    if not languages:
        return texts.select("*", F.lit(0).alias("lang_ord"), F.lit("").alias("lang")).where(F.lit(False))
    return texts.select("*", F.posexplode(F.array(*map(F.lit, languages))).alias("lang_ord", "lang"))


def round_trip(texts: DataFrame, languages: Sequence[str], translator: Callable, size: int | None = None) -> DataFrame:
    """``by_language`` with ``back``; a batch whose translation fails gives "", as does a NULL text. A batch is of one language where rows come so."""
    return plugins.translate(by_language(texts, languages), translator, size)


def cosines(a: Sequence, b: Sequence) -> list[float]:
    """Row-wise cosine; 0 for a zero vector, for none, and for vectors of unlike lengths."""
    fit = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and len(x) == len(y) > 0]
    made = np.zeros(len(a))
    by_length: dict[int, list[int]] = {}
    for i in fit:
        by_length.setdefault(len(a[i]), []).append(i)
    for at in by_length.values():
        x, y = (np.array([v[i] for i in at], np.float64) for v in (a, b))
        norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        made[at] = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(at)), where=norm != 0)
    return made.tolist()


def in_parts(step: Callable, frame: pd.DataFrame, size: int | None) -> list:
    return [v for at in range(0, len(frame), size or max(1, len(frame))) for v in step(frame.iloc[at : at + (size or len(frame))])]


def scores(back: DataFrame, embedder: Callable, metric: Callable, size: int | None = None) -> DataFrame:
    """Adds ``bleu, embed, metric`` of ``text`` and ``back``: sentence BLEU, cosine of the two vectors (0 for a zero vector), the metric.

    All three are made in one pass, to which only the two texts are sent. A text that stands several times in an Arrow batch, as one does
    for its languages, is embedded once, and its n-grams are counted once; texts that came back as they were need neither tokens nor counts.
    """
    if size is not None and size < 1:
        raise ValueError("the batch size must be 1 or more")

    @F.pandas_udf("bleu double, embed double, metric double")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        embedded, measured = embedder(), metric()
        for batch in batches:
            text, other, said, meant = ([x if isinstance(x, str) else None for x in c] for c in batch)
            vectors: dict = dict.fromkeys([*text, *other])
            vectors = dict(zip(vectors, in_parts(embedded, pd.DataFrame({"text": list(vectors)}, dtype=object), size)))
            got, last, reference, known = [], None, [], None
            for h, r in zip(said, meant):
                if h is None:  # the same text
                    got.append(100.0 if r else 0.0)
                    continue
                if r != last:
                    last, reference = r, r.split(" ") if r else []
                    known = bleu.grams(reference)
                got.append(bleu.score(h.split(" ") if h else [], reference, known=known))
            frame = pd.DataFrame({"text": text, "back": other, "hypothesis": other, "reference": text}, dtype=object)
            embeds = cosines([vectors[x] for x in text], [vectors[x] for x in other])
            yield pd.DataFrame({"bleu": got, "embed": embeds, "metric": in_parts(measured, frame, 64)})

    same = F.col("text").eqNullSafe(F.col("back"))
    joined = {c: F.array_join(tokens(F.col(c)), " ") for c in ("text", "back")}
    any_token = F.when(F.coalesce("text", F.lit("")).rlike(r"(?U)[\p{L}\p{N}_]"), "x").otherwise("")
    said, meant = F.when(~same, joined["back"]), F.when(same, any_token).otherwise(joined["text"])
    return back.withColumn("_s", made("text", "back", said, meant)).select(*back.columns, "_s.bleu", "_s.embed", "_s.metric")


def means(scored: DataFrame) -> DataFrame:
    """``model, lang_ord, lang, avg_bleu, avg_embed, avg_metric``."""
    return scored.groupBy("model", "lang_ord", "lang").agg(*[F.avg(c).alias(f"avg_{c}") for c in METRICS])


def ordered(value: Column) -> Column:
    """Aggregate: the values of a group in the order of their languages."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("lang_ord"), value.alias("v")))), lambda x: x["v"])


def arrays(scored: DataFrame, key: str = "expl_id") -> DataFrame:
    """``key, bleu_scores, embed_scores, comet_scores``: the n-th value is that of the n-th language."""
    return scored.groupBy(key).agg(ordered(F.col("bleu")).alias("bleu_scores"), ordered(F.col("embed")).alias("embed_scores"), ordered(F.col("metric")).alias("comet_scores"))


def mean_arrays(averages: DataFrame) -> DataFrame:
    """``model, avg_bleu, avg_emb, avg_comet`` as arrays by language."""
    return averages.groupBy("model").agg(ordered(F.col("avg_bleu")).alias("avg_bleu"), ordered(F.col("avg_embed")).alias("avg_emb"), ordered(F.col("avg_metric")).alias("avg_comet"))
