"""The report on one word: what an interactive caller asks for, as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeloom.functions import text as X
from primeloom.plans import prompts


def score_one(spark: SparkSession, word: str, examples: list[str], explication: str) -> DataFrame:
    """Prompt, counts, ratios and bands of one explication. A word and at least one example that isn't blank are needed."""
    shown = [e for e in examples if e and e.strip()]
    if not word or not word.strip() or not shown:
        raise ValueError("a word and at least one example are needed")
    one = spark.createDataFrame([(word.strip(), shown, explication)], "word string, examples array<string>, text string").withColumn("toks", X.tokens(F.col("text")))
    counted = one.withColumns(X.legality(F.col("toks"))).withColumn("uses_original_word", X.circular_exact(F.col("word"), F.col("toks")))
    made = X.bands({c: F.col(c) for c in ("primes_ratio", "molecules_ratio", "stop_words", "length")}, F.col("uses_original_word"))
    return counted.withColumn("prompt", prompts.base_prompt(F.col("word"), F.col("examples"), "plain")).withColumns(made).drop("toks")
