"""Writers and serialised forms: predictions, scores, explications and models as JSON, request lines, reports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primeloom.sources.schemas import EXPLICATION_FIELDS, MODEL_FIELDS, PREDICTION_FIELDS, SUB_SCORE_FIELDS

_ALL = {"ignoreNullFields": "false"}
#: what a result file written here begins with, and what stands between its pieces: white space that no JSON string holds as it is
FIRST_PIECE, BETWEEN = "{ ", "\t"


def typed(fields: Mapping[str, str], have: Mapping[str, Column] | None = None) -> Column:
    """A struct of the fields from columns of their names, or as ``have`` names them; NULL where it says so."""
    own = have or {}
    return F.struct(*[own.get(n, F.col(n)).cast(t).alias(n) for n, t in fields.items()])


def prediction() -> Column:
    return typed(PREDICTION_FIELDS)


def prediction_json() -> Column:
    return F.to_json(prediction(), _ALL)


def sub_score_json() -> Column:
    return F.to_json(typed(SUB_SCORE_FIELDS), _ALL)


def explication(have: Mapping[str, Column] | None = None, swapped: bool = False) -> Column:
    """``swapped`` exchanges the two partial deltas, as older result files have them."""
    other = {"avg_delta_min": F.col("avg_delta_ent"), "avg_delta_ent": F.col("avg_delta_min")} if swapped else {}
    return typed(EXPLICATION_FIELDS, {**other, **(have or {})})


def explication_json(have: Mapping[str, Column] | None = None, swapped: bool = False) -> Column:
    return F.to_json(explication(have, swapped), _ALL)


def model_json(have: Mapping[str, Column] | None = None) -> Column:
    return F.to_json(typed(MODEL_FIELDS, have), _ALL)


def prediction_text() -> Column:
    return F.format_string("%s (log-prob %.4f, match %s)", F.coalesce("prediction", F.lit("")), F.coalesce("answer_logprob", F.lit(0.0)), F.coalesce("is_match", F.lit(False)).cast("string"))


def prediction_line() -> Column:
    """All of a prediction in one line, for a reader."""
    ranks = F.concat(F.lit("["), F.array_join(F.coalesce("answer_ranks", F.array().cast("array<int>")), ", "), F.lit("]"))
    match = F.when(F.coalesce("is_match", F.lit(False)), "yes").otherwise("no")
    return F.format_string(
        "word %s; log-prob %.4f; ranks %s; match %s; lines removed %d",
        F.coalesce("prediction", F.lit("")), F.coalesce("answer_logprob", F.lit(0.0)), ranks, match, F.coalesce("lines_removed", F.lit(0)),
    )


def result_lines(scored: DataFrame, swapped: bool = False, have: Mapping[str, Column] | None = None) -> DataFrame:
    """``model, value``: one JSON line an explication; any number of them, in any number of tasks."""
    return scored.select("model", explication_json(have, swapped).alias("value"))


def model_lines(models: DataFrame, have: Mapping[str, Column] | None = None) -> DataFrame:
    """``model, value``: one JSON line a model, its averages without its explications."""
    return models.select("model", model_json(have).alias("value"))


def write_results(scored: DataFrame, models: DataFrame, path: str, graders: list[str], languages: list[str]) -> None:
    """A run: explications and averages as JSON lines by model, and the run's metadata beside them.

    ``scored`` and ``models`` hold the columns of ``EXPLICATION_FIELDS`` and ``MODEL_FIELDS``.
    """
    result_lines(scored).write.mode("overwrite").partitionBy("model").text(f"{path}/explications")
    model_lines(models).write.mode("overwrite").partitionBy("model").text(f"{path}/models")
    spark = scored.sparkSession
    spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd_HH-mm-ss").alias("timestamp"),
        F.array(*map(F.lit, graders)).cast("array<string>").alias("graders"),
        F.array(*map(F.lit, languages)).cast("array<string>").alias("languages"),
    ).write.mode("overwrite").json(f"{path}/metadata")


def result_file(scored: DataFrame, models: DataFrame, path: str, graders: list[str], languages: list[str], swapped: bool = True) -> None:
    """One JSON object of a run as other tools read it: a key for each model, and ``timestamp``, ``graders``, ``languages``.

    The object is one line of one file, so one task writes it, but in pieces of an explication or a model's averages, which it takes from a
    sort that may spill: no run is ever held in memory. ``readers.results`` reads the pieces in as many tasks as there are blocks.
    Models without explications, and explications without their model, are left out.
    """
    meta = F.to_json(
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd_HH-mm-ss").alias("timestamp"),
            F.array(*map(F.lit, graders)).cast("array<string>").alias("graders"),
            F.array(*map(F.lit, languages)).cast("array<string>").alias("languages"),
        )
    )
    name = F.to_json(F.array("model"))
    head = F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":"), F.regexp_replace(model_json(), r"\}$", ""), F.lit(',"explications":['))
    none = F.lit(None).cast("long")
    rows = [
        models.where("model IS NOT NULL").select(F.lit(0).alias("kind"), "model", F.lit(0).alias("turn"), none.alias("entry_id"), none.alias("expl_id"), head.alias("value")),
        scored.where("model IS NOT NULL").select(F.lit(0), "model", F.lit(1), F.col("entry_id").cast("long"), F.col("expl_id").cast("long"), explication_json(swapped=swapped)),
        scored.sparkSession.range(1).select(F.lit(1), F.lit(None).cast("string"), F.lit(0), none, none, meta.substr(F.lit(2), F.length(meta) - 1)),
    ]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of, begun = None, None, False  # the model's head until its first explication, the model, whether its list is open
        made = [FIRST_PIECE]
        for batch in batches:
            for kind, model, turn, value in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if begun and (kind or (turn == 0 and model != of)):
                    made.append("]},")
                    begun = False
                if kind:
                    made.append(value)
                elif turn == 0:
                    if model != of:
                        head, of = value, model
                elif model == of:
                    if begun:
                        made.append("," + value)
                    else:
                        made += (head, value)
                        begun = True
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])
            made = []

    every = rows[0].unionAll(rows[1]).unionAll(rows[2]).repartition(1).sortWithinPartitions("kind", "model", "turn", "entry_id", "expl_id", "value")
    every.mapInArrow(pieces, "value string").write.mode("overwrite").option("lineSep", BETWEEN).text(path)


def publish(data: DataFrame, path: str, message: str) -> None:
    """The table as Parquet by split, and a note of what was published."""
    data.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    data.sparkSession.createDataFrame([(message,)], "message string").write.mode("overwrite").json(f"{path}/note")


def lines(rows: DataFrame, column: str, path: str) -> None:
    """One request line a row."""
    rows.select(column).write.mode("overwrite").text(path)


def model_report() -> Column:
    return F.format_string("%s: total %.2f, primes %.3f, molecules %.3f", F.col("model"), F.col("avg_total_score"), F.col("avg_primes_ratio"), F.col("avg_molecules_ratio"))


def language_report() -> Column:
    """The means of one model and language in one line."""
    return F.format_string("[%s] %s: BLEU %.2f, embedding %.2f, metric %.2f", F.col("lang"), F.col("model"), F.col("avg_bleu"), F.col("avg_embed"), F.col("avg_metric"))


def deviation_report() -> Column:
    return F.format_string("%s, %s: deviation %.4f, error bar %.4f", F.col("model"), F.col("measure"), F.col("std"), F.col("bar"))
