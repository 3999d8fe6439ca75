"""A whole evaluation from its configuration: generate, grade, translate, score.

What plug-ins return is stored before it is used, so sampled texts stay the same and no lost executor costs a second inference.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeloom.functions import text as X
from primeloom.operators import plugins
from primeloom.plans import fanout, prompts, scoring
from primeloom.plans import translation as R
from primeloom.sources.readers import Config
from primeloom.sources.schemas import EXPLICATION_FIELDS, MODEL_FIELDS
from primeloom.sources.storage import stored

BASELINE = "wordnet_definitions"


def explications(entries: DataFrame, bank: DataFrame, config: Config, generators: Mapping[str, Callable], decoding: plugins.Decoding = plugins.Decoding()) -> DataFrame:
    """``expl_id, model, model_ord, entry_id, target_word, text``: one text an entry and model, after the definitions as the first model.

    ``bank``: one row with the few-shot pairs. A model gets ``num_examples`` of them (all if it names no number), its system
    instruction native only if ``use_system_prompt``; ``generators``: by model name, or by its route.
    """
    rows = [entries.select(F.lit(BASELINE).alias("model"), F.lit(0).alias("model_ord"), "entry_id", F.col("word").alias("target_word"), F.col("def").alias("text"))]
    for i, m in enumerate(config.models, 1):
        pairs = prompts.first_pairs(F.col("bank"), m.get("num_examples"))
        mode = "native" if m.get("use_system_prompt", True) else "emulated"
        user = prompts.explication_user(F.col("word"), F.col("examples"))
        asked = entries.crossJoin(F.broadcast(bank)).select(  # one row of pairs
            F.lit(m["model"]).alias("model"), F.lit(i).alias("model_ord"), "entry_id", F.col("word").alias("target_word"),
            prompts.messages(F.lit(prompts.DEFAULT.explain_system), user, pairs, mode).alias("messages"), user.alias("prompt"),
        )
        made = generators.get(m["model"]) or generators[next(n for n in generators if n in m["model"].lower())]
        rows.append(plugins.generate(asked, made, m.get("max_batch_size"), decoding).select(rows[0].columns))
    every = reduce(DataFrame.unionByName, rows)
    return stored(every.select(F.xxhash64("model", "entry_id").alias("expl_id"), "*"))


def predictions(texts: DataFrame, entries: DataFrame, passages: DataFrame, config: Config, graders: Mapping[str, Callable]) -> DataFrame:
    """Every condition graded by every grader, in the long form of the ``predictions`` table."""
    conditions = fanout.conditions(texts, passages).join(entries.select("entry_id", "word"), "entry_id")
    system, user = prompts.recovery(F.col("passage"), F.col("explication"))
    rows = []
    for g in config.graders:
        name = F.lit(g["model"])
        asked = conditions.select(
            name.alias("grader"), "entry_id", "model", "passage_id", "slot", "lines_removed", "word",
            prompts.messages(system, user, mode=prompts.grader_mode(name, F.col("slot"))).alias("messages"), user.alias("prompt"),
        )
        rows.append(plugins.grade(asked, graders[g["model"]], g.get("max_batch_size")).drop("messages", "prompt", "word"))
    return stored(reduce(DataFrame.unionByName, rows))


def evaluate(
    entries: DataFrame, passages: DataFrame, bank: DataFrame, config: Config, generators: Mapping[str, Callable], graders: Mapping[str, Callable],
    translator: Callable | None = None, embedder: Callable | None = None, metric: Callable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Explications and models of a run with all fields of result files; what no language was asked for is NULL."""
    texts = explications(entries, bank, config, generators)
    graded = predictions(texts.select("expl_id", "entry_id", F.lower(F.trim("model")).alias("model"), "text"), entries, passages, config, graders)
    counted = texts.withColumn("model", scoring.model_key()).withColumn("toks", X.tokens(F.col("text")))
    counted = counted.withColumns(X.legality(F.col("toks"))).withColumn("uses_original_word", X.circular_exact(F.col("target_word"), F.col("toks"))).drop("toks")
    details = scoring.score_details(graded)
    each = F.struct("grader", *[c for c in details.columns if c not in ("grader", "entry_id")])  # one a grader
    nested = details.groupBy("entry_id", "model").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x.dropFields("grader")).alias("sub_scores"))
    scored = scoring.explication_scores(counted, scoring.sub_scores(graded)).join(nested, ["entry_id", "model"], "left")
    models = scoring.model_averages(scored)
    if config.languages:
        back = stored(R.scores(R.round_trip(counted.select("expl_id", "model", "text"), config.languages, translator), embedder, metric))
        scored, models = scored.join(R.arrays(back), "expl_id", "left"), models.join(R.mean_arrays(R.means(back)), "model", "left")

    def whole(rows: DataFrame, fields: Mapping[str, str], *keys: str) -> DataFrame:
        return rows.select(*keys, *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items() if c not in keys])

    return whole(scored, EXPLICATION_FIELDS, "expl_id", "entry_id", "model"), whole(models, MODEL_FIELDS, "model")
