"""Readers: tables with declared schemas, splits, in-memory rows, few-shot banks, configuration and result files."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from primeloom.sources import sinks
from primeloom.sources.schemas import EXPLICATION, EXPLICATION_FIELDS, MODEL, MODEL_FIELDS, PREDICTION, SCHEMAS, SUB_SCORE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; with the declared schema where there is one, so a missing column reads as NULL."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def split(data: DataFrame, name: str, subset: str = "") -> DataFrame:
    """The rows of one split, and of one subset where the data has that column and one is asked for."""
    rows = data.where(F.col("split") == name)
    return rows.where(F.col("subset") == subset) if subset and "subset" in data.columns else rows


def from_rows(spark: SparkSession, rows: list[dict], schema: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """In-memory rows; ``renamed`` maps column names of the rows to those of the schema."""
    names = renamed or {}
    return spark.createDataFrame([{names.get(k, k): v for k, v in r.items()} for r in rows], schema)


def few_shot_bank(spark: SparkSession, path: str) -> DataFrame:
    """``ord, user, assistant`` of a JSON list of [user, assistant] pairs."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("pairs"))
    return parsed.select(F.posexplode("pairs").alias("ord", "p")).select("ord", F.get("p", F.lit(0)).alias("user"), F.get("p", F.lit(1)).alias("assistant"))


def results(spark: SparkSession, path: str, swapped: bool = True) -> DataFrame:
    """``model, place, explication`` of result files: JSON objects of model name to ``{"explications": [...]}``.

    Keys that hold no object (run metadata) are left out. ``swapped``: the file has the two partial deltas exchanged.
    """
    own, others = _files(spark, path)
    made = []
    if own:
        pieces, heads = _pieces(spark, own)
        spots = spark.createDataFrame(heads, "file string, start long, shift long, heads array<struct<at: long, model: string>>")
        # a piece belongs to the last model that begins before it
        placed = pieces.join(F.broadcast(spots), ["file", "start"]).where(F.col("value").rlike(r'^,?\{"')).withColumn("at", F.col("id") + F.col("shift"))
        last = placed.withColumn("head", F.element_at(F.filter("heads", lambda h: h["at"] < F.col("at")), -1))
        text = F.regexp_replace("value", "^,", "")
        made.append(last.select(F.col("head.model").alias("model"), (F.col("at") - F.col("head.at") - 1).cast("int").alias("place"), F.from_json(text, EXPLICATION).alias("explication")))
    if others or not made:
        raw = spark.read.text(others or path, wholetext=True)
        # metadata values aren't objects: each key's value is parsed on its own
        keyed = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("model", "body")).where(F.col("body").startswith("{"))
        parsed = keyed.select("model", F.from_json("body", f"struct<explications:array<{EXPLICATION}>>").alias("r"))
        made.append(parsed.select("model", F.posexplode("r.explications").alias("place", "explication")))
    return reduce(DataFrame.unionAll, made).withColumn("explication", _ordered("explication", swapped))


def _files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files that ``sinks.result_file`` wrote in pieces, and all others, told by how they begin."""
    own: list[str] = []
    others: list[str] = []
    jvm, begin = spark._jvm, (sinks.FIRST_PIECE + sinks.BETWEEN).encode()
    for name in spark.read.text(path).inputFiles():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
        first = [stream.read() for _ in begin]
        stream.close()
        (own if first == list(begin) else others).append(file.toString())
    return own, others


def _pieces(spark: SparkSession, files: list[str]) -> tuple[DataFrame, list[tuple]]:
    """``file, start, id, value`` of all pieces, and for each block of a file what added to ``id`` gives the piece's place in the file, with
    the places and names of the file's models. Only the models' pieces reach the driver."""
    raw = spark.read.option("lineSep", sinks.BETWEEN).text(files)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    head = F.when(F.col("value").startswith('"') & F.col("value").endswith('"explications":['), F.struct("id", "value"))
    blocks = pieces.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.collect_list(head).alias("heads")).collect()
    spots, heads, before = [], defaultdict(list), Counter()
    for b in sorted(blocks, key=lambda b: (b["file"], b["start"])):
        shift = before[b["file"]] - b["first"]
        before[b["file"]] += b["n"]
        spots.append((b["file"], b["start"], shift))
        heads[b["file"]] += [(h["id"] + shift, h["value"]) for h in sorted(b["heads"])]
    named = {f: [(at, next(iter(json.loads(f"{{{v}]}}}}")))) for at, v in each] for f, each in heads.items()}
    return pieces, [(*s, named[s[0]]) for s in spots]


def model_results(spark: SparkSession, path: str) -> DataFrame:
    """The averages of each model of result files, as columns."""
    own, others = _files(spark, path)
    made = []
    if own:
        raw = spark.read.option("lineSep", sinks.BETWEEN).text(own).where(F.col("value").startswith('"') & F.col("value").endswith('"explications":['))
        made.append(raw.select(F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("]}}")), "map<string,string>")).alias("name", "body")))
    if others or not made:
        raw = spark.read.text(others or path, wholetext=True)
        made.append(raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "body")).where(F.col("body").startswith("{")))
    keyed = reduce(DataFrame.unionAll, made)
    return keyed.select("name", F.from_json("body", MODEL).alias("m")).select(F.coalesce("m.model", "name").alias("model"), *[f"m.{c}" for c in MODEL_FIELDS if c != "model"])


def result_lines(spark: SparkSession, path: str, swapped: bool = False) -> DataFrame:
    """``model, explication`` of the JSON lines ``sinks.write_results`` writes."""
    rows = spark.read.schema("value string, model string").text(f"{path}/explications")
    return rows.select("model", F.from_json("value", EXPLICATION).alias("explication")).withColumn("explication", _ordered("explication", swapped))


def _ordered(column: str, swapped: bool) -> Column:
    other = {"avg_delta_min": "avg_delta_ent", "avg_delta_ent": "avg_delta_min"} if swapped else {}
    made = F.struct(*[F.col(f"{column}.{other.get(c, c)}").alias(c) for c in EXPLICATION_FIELDS])
    return F.when(F.col(column).isNotNull(), made)


def read_prediction(json_text: Column) -> Column:
    """A prediction from JSON; what it lacks is "", 0, none, false."""
    return prediction_defaults(F.from_json(json_text, PREDICTION))


def prediction_defaults(p: Column) -> Column:
    return F.struct(
        F.coalesce(p["prediction"], F.lit("")).alias("prediction"),
        F.coalesce(p["answer_logprob"], F.lit(0.0)).alias("answer_logprob"),
        F.coalesce(p["answer_ranks"], F.array().cast("array<int>")).alias("answer_ranks"),
        F.coalesce(p["is_match"], F.lit(False)).alias("is_match"),
        F.coalesce(p["lines_removed"], F.lit(0)).alias("lines_removed"),
    )


def read_sub_score(json_text: Column) -> Column:
    """A score of one grader from JSON; what it lacks is 0 or none, and so in its predictions."""
    s = F.from_json(json_text, SUB_SCORE)
    flat = lambda c: F.transform(F.coalesce(s[c], F.array().cast(f"array<{PREDICTION}>")), prediction_defaults)
    pairs = lambda c: F.transform(F.coalesce(s[c], F.array().cast(f"array<array<{PREDICTION}>>")), lambda x: F.transform(x, prediction_defaults))
    numbers = [F.coalesce(s[c], F.lit(0.0)).alias(c) for c in ("adj_score", "avg_delta_log", "avg_min_delta_log", "avg_ent_delta_log")]
    return F.struct(
        s["model"].alias("model"), *numbers, F.coalesce(s["total_match"], F.lit(0)).alias("total_match"),
        flat("baselines").alias("baselines"), flat("exp_baselines").alias("exp_baselines"), pairs("minimality").alias("minimality"), pairs("entailments").alias("entailments"),
    )


@dataclass(frozen=True)
class Config:
    """Evaluation configuration; every model's batch size must be a positive number."""

    dataset: str
    split: str
    output_path: str
    models: list[dict] = field(default_factory=list)
    graders: list[dict] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)


def config(path: str) -> Config:
    raw = json.loads(Path(path).read_text())
    for m in [*raw.get("models", []), *raw.get("grader_models", [])]:
        if not m.get("model"):
            raise ValueError("each model needs a name")
        if m.get("max_batch_size") is not None and m["max_batch_size"] < 1:
            raise ValueError(f"max_batch_size of {m['model']} must be 1 or more")
    return Config(raw["dataset"]["name"], raw["dataset"]["split"], raw["output_path"], raw.get("models", []), raw.get("grader_models", []), raw.get("languages", []))
