"""Substitutability scores: from graded conditions to deltas, adjusted scores, and averages per explication and model.

A key graded more than once counts with its greatest log-probability. Missing slots only lose the differences they take part
in: every mean is over differences that exist. A score without any is NULL and takes no part in averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primeloom.sources.schemas import PREDICTION, PREDICTION_FIELDS

CAP = 40.0


def model_key(c: str = "model") -> Column:
    return F.lower(F.trim(c))


def slot_table(predictions: DataFrame) -> DataFrame:
    """``grader, entry_id, model, passage_id, base, s0 .. s4, matches``; one group-by for the slots, one for the baselines."""
    rows = predictions.select("grader", "entry_id", model_key().alias("model"), "passage_id", "slot", "answer_logprob", "is_match")
    base = rows.where("slot = -1").groupBy("grader", "entry_id", "passage_id").agg(F.max("answer_logprob").alias("base"))
    slot = F.col("slot")
    hit = [F.coalesce(F.max(F.when(slot == i, F.col("is_match").cast("int"))), F.lit(0)) for i in range(5)]
    scored = (
        rows.where("slot BETWEEN 0 AND 4 AND model IS NOT NULL")
        .groupBy("grader", "entry_id", "model", "passage_id")
        .agg(*[F.max(F.when(slot == i, F.col("answer_logprob"))).alias(f"s{i}") for i in range(5)], sum(hit[1:], hit[0]).cast("long").alias("matches"))
    )
    return scored.join(base, ["grader", "entry_id", "passage_id"], "left")


def pooled_mean(*differences: Column) -> Column:
    """Mean of all differences of all rows together."""
    total = sum((F.coalesce(d, F.lit(0.0)) for d in differences[1:]), F.coalesce(differences[0], F.lit(0.0)))
    return F.try_divide(F.sum(total), sum((F.count(d) for d in differences[1:]), F.count(differences[0])))


def sub_scores(predictions: DataFrame, cap: float = CAP) -> DataFrame:
    """``grader, entry_id, model, avg_delta_log, avg_min_delta_log, avg_ent_delta_log, adj_score, total_match``."""
    s = {i: F.col(f"s{i}") for i in range(5)}
    scored = (
        slot_table(predictions)
        .groupBy("grader", "entry_id", "model")
        .agg(
            F.avg(s[0] - F.col("base")).alias("avg_delta_log"),
            pooled_mean(s[1] - s[0], s[2] - s[1]).alias("avg_min_delta_log"),
            pooled_mean(s[3] - s[0], s[4] - s[3]).alias("avg_ent_delta_log"),
            F.sum("matches").alias("total_match"),
        )
    )
    raw = F.col("avg_delta_log") - F.col("avg_min_delta_log") + F.col("avg_ent_delta_log")
    return scored.withColumn("adj_score", F.when(raw.isNotNull(), F.least(F.lit(cap), raw)))


def best_predictions(predictions: DataFrame) -> DataFrame:
    """``grader, entry_id, model, passage_id, slot, p``: of a key graded more than once the most probable prediction."""
    order = ("answer_logprob", "prediction", "is_match", "lines_removed", "answer_ranks")
    top = F.max(F.struct(*order))
    fields = F.struct(*[F.col(f"t.{c}").cast(k).alias(c) for c, k in PREDICTION_FIELDS.items()])
    keys = ("grader", "entry_id", "model", "passage_id", "slot")
    return predictions.withColumn("model", model_key()).groupBy(*keys).agg(top.alias("t")).select(*keys, fields.alias("p"))


def score_details(predictions: DataFrame) -> DataFrame:
    """``sub_scores`` with the predictions they come from: ``baselines``, ``exp_baselines`` by passage, and for each passage the
    graded shortenings of the explication (``minimality``) and of the passage (``entailments``), none where there are none.

    The predictions of one entry, grader and model meet in one row; its passages bound them.
    """
    best = best_predictions(predictions)
    slot = F.col("slot")
    by_passage = best.where("slot BETWEEN 0 AND 4 AND model IS NOT NULL").groupBy("grader", "entry_id", "model", "passage_id").agg(
        *[F.max(F.when(slot == i, F.col("p"))).alias(f"p{i}") for i in range(5)]
    )
    base = best.where("slot = -1").groupBy("grader", "entry_id").agg(F.array_sort(F.collect_list(F.struct("passage_id", "p"))).alias("b"))
    graded = lambda *places: F.filter(F.array(*[F.col(f"p{i}") for i in places]), lambda p: p.isNotNull())
    row = F.struct("passage_id", F.col("p0").alias("own"), graded(1, 2).alias("shorter"), graded(3, 4).alias("less"))
    listed = by_passage.groupBy("grader", "entry_id", "model").agg(F.array_sort(F.collect_list(row)).alias("r"))
    none = F.array().cast(f"array<{PREDICTION}>")
    joined = sub_scores(predictions).join(listed, ["grader", "entry_id", "model"]).join(base, ["grader", "entry_id"], "left")
    return joined.select(
        "grader", "entry_id", "model", "avg_delta_log", "avg_min_delta_log", "avg_ent_delta_log", "adj_score", "total_match",
        F.coalesce(F.transform("b", lambda x: x["p"]), none).alias("baselines"),
        F.transform(F.filter("r", lambda x: x["own"].isNotNull()), lambda x: x["own"]).alias("exp_baselines"),
        F.transform("r", lambda x: x["shorter"]).alias("minimality"),
        F.transform("r", lambda x: x["less"]).alias("entailments"),
    )


def legality_total(score: Column, primes: Column, molecules: Column, circular: Column) -> Column:
    return F.when(F.coalesce(circular, F.lit(False)), 0.0).otherwise(2 * (score + 10 * primes - 10 * molecules))


def legality_alternative(primes: Column, molecules: Column) -> Column:
    """The dispersion script's variant, which weighs molecules once."""
    return 10 * primes - molecules


def explication_scores(explications: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds ``avg_delta, avg_delta_min, avg_delta_ent, score_exp`` (0 without any grader) and ``total_score``.

    ``explications`` holds ``entry_id, model``, the ratios and ``uses_original_word``.
    """
    means = scores.groupBy("entry_id", "model").agg(
        *[
            F.avg(c).alias(n)
            for c, n in (("avg_delta_log", "avg_delta"), ("avg_min_delta_log", "avg_delta_min"), ("avg_ent_delta_log", "avg_delta_ent"), ("adj_score", "score_exp"))
        ]
    )
    joined = explications.join(means, ["entry_id", "model"], "left")
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in ("avg_delta", "avg_delta_min", "avg_delta_ent", "score_exp")}
    return joined.withColumns(filled).withColumn("total_score", legality_total(F.col("score_exp"), F.col("primes_ratio"), F.col("molecules_ratio"), F.col("uses_original_word")))


MODEL_MEANS = ("total_score", "score_exp", "primes_ratio", "molecules_ratio", "avg_delta", "avg_delta_min", "avg_delta_ent", "length", "primes", "stop_words", "molecules")


def model_averages(scored: DataFrame) -> DataFrame:
    """Unweighted means of each model and the share of circular explications."""
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("num_examples"),
        *[F.avg(c).alias(c if c.startswith("avg_") else f"avg_{c}") for c in MODEL_MEANS],
        F.avg(F.coalesce("uses_original_word", F.lit(False)).cast("int")).alias("avg_circularity"),
    )
