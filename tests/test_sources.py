import json

import pytest
from pyspark.sql import functions as F

from primeloom.plans import prompts
from primeloom.sources import readers, sinks
from primeloom.sources import schemas as C
from primeloom.streaming import scoring as S


def test_result_files_round_trip(spark, tmp_path):
    body = {"explications": [{"text": "a", "total_score": 1.5, "bleu_scores": [1.0, 2.0]}, {"text": "b"}]}
    (tmp_path / "run.json").write_text(json.dumps({"m1": body, "m2": {"explications": []}, "timestamp": "2024-01-01", "graders": ["g"]}))
    got = [(r.model, r.place, r.explication.text, r.explication.total_score) for r in readers.results(spark, str(tmp_path / "run.json")).orderBy("place").collect()]
    assert got == [("m1", 0, "a", 1.5), ("m1", 1, "b", None)]


def run(spark):
    """Explications and models with all fields of a result file, most of them NULL."""
    fields = ", ".join(f"{n} {t}" for n, t in C.EXPLICATION_FIELDS.items())
    own = {"text": "t", "target_word": "w", "avg_delta_min": 0.2, "avg_delta_ent": 0.3, "total_score": 4.5, "bleu_scores": [1.0]}
    rows = [("m \"q\"", e, 5 - e, *({**own, "text": f"t{e}"}.get(c) for c in C.EXPLICATION_FIELDS)) for e in (2, 1)]
    models = spark.createDataFrame([tuple({"model": "m \"q\"", "avg_total_score": 4.5}.get(c) for c in C.MODEL_FIELDS)], ", ".join(f"{n} {t}" for n, t in C.MODEL_FIELDS.items()))
    return spark.createDataFrame(rows, f"model string, entry_id long, expl_id long, {fields}"), models


def test_write_results(spark, tmp_path):
    scored, models = run(spark)
    sinks.write_results(scored, models, str(tmp_path / "out"), ["g"], ["de"])
    back = readers.result_lines(spark, str(tmp_path / "out")).select("model", "explication.*")
    assert {(r.model, r.text, r.avg_delta_min, r.total_score) for r in back.collect()} == {('m "q"', "t1", 0.2, 4.5), ('m "q"', "t2", 0.2, 4.5)}
    assert spark.read.json(str(tmp_path / "out/metadata")).first().languages == ["de"]


def test_result_file_is_one_json_object(spark, tmp_path):
    sinks.result_file(*run(spark), str(tmp_path / "file"), ["g"], [])
    whole = json.loads(spark.read.text(str(tmp_path / "file")).first().value)
    assert set(whole) == {'m "q"', "timestamp", "graders", "languages"} and whole["graders"] == ["g"]
    body = whole['m "q"']
    assert [e["text"] for e in body["explications"]] == ["t1", "t2"] and body["avg_total_score"] == 4.5
    assert set(body) == set(C.MODEL_FIELDS) | {"explications"} and set(body["explications"][0]) == set(C.EXPLICATION_FIELDS)
    assert (body["explications"][0]["avg_delta_min"], body["explications"][0]["avg_delta_ent"]) == (0.3, 0.2)  # exchanged in the file
    first = readers.results(spark, str(tmp_path / "file")).where("place = 0").first().explication
    assert (first.avg_delta_min, first.avg_delta_ent) == (0.2, 0.3)
    assert readers.model_results(spark, str(tmp_path / "file")).first().avg_total_score == 4.5
    sinks.result_file(run(spark)[0].limit(0), run(spark)[1], str(tmp_path / "none"), [], ["de"])
    assert set(json.loads(spark.read.text(str(tmp_path / "none")).first().value)) == {"timestamp", "graders", "languages"}


def test_result_file_is_written_and_read_in_pieces(spark, tmp_path):
    """No row holds a model's explications; blocks cut anywhere give every explication its model and place."""
    (_, models), path = run(spark), str(tmp_path / "file")
    fields = ", ".join(f"{n} {t}" for n, t in C.EXPLICATION_FIELDS.items())
    rows = [(m, e, e, *({"text": f"{m} {e}\t\n{{"}.get(c) for c in C.EXPLICATION_FIELDS)) for m in ("a", 'm "q"', "z") for e in range(200)]
    every = models.unionAll(models.withColumn("model", F.lit("z"))).unionAll(models.withColumn("model", F.lit("unused")))
    sinks.result_file(spark.createDataFrame(rows, f"model string, entry_id long, expl_id long, {fields}"), every, path, ["g"], [])
    assert spark.read.option("lineSep", sinks.BETWEEN).text(path).agg(F.max(F.length("value"))).first()[0] < 1500
    whole = json.loads(spark.read.text(path).first().value)
    assert set(whole) == {'m "q"', "z", "timestamp", "graders", "languages"} and len(whole["z"]["explications"]) == 200
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        got = {(r.model, r.place): r.explication.text for r in readers.results(spark, path).collect()}
        assert {r.model for r in readers.model_results(spark, path).collect()} == {'m "q"', "z"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(m, e): f"{m} {e}\t\n{{" for m in ('m "q"', "z") for e in range(200)}


def test_missing_fields_have_defaults(spark):
    df = spark.createDataFrame([('{"prediction": "w"}', '{"model": "m", "minimality": [[{}], []]}')], "p string, s string")
    r = df.select(readers.read_prediction(F.col("p")).alias("p"), readers.read_sub_score(F.col("s")).alias("s")).first()
    assert tuple(r.p) == ("w", 0.0, [], False, 0)
    assert r.s.adj_score == 0 and r.s.total_match == 0 and r.s.baselines == [] and [[tuple(p) for p in x] for x in r.s.minimality] == [[("", 0.0, [], False, 0)], []]


def test_few_shot_bank_config_and_publish(spark, tmp_path):
    (tmp_path / "bank.json").write_text(json.dumps([["u1", "a1"], ["u2", "a2"]]))
    assert [(r.ord, r.user, r.assistant) for r in readers.few_shot_bank(spark, str(tmp_path / "bank.json")).collect()] == [(0, "u1", "a1"), (1, "u2", "a2")]
    good = {"dataset": {"name": "d", "split": "test"}, "output_path": "o", "models": [{"model": "m", "max_batch_size": 8}]}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert readers.config(str(tmp_path / "c.json")).split == "test"
    (tmp_path / "c.json").write_text(json.dumps(good | {"models": [{"model": "m", "max_batch_size": 0}]}))
    with pytest.raises(ValueError):
        readers.config(str(tmp_path / "c.json"))
    sinks.publish(spark.createDataFrame([("train", "w")], "split string, word string"), str(tmp_path / "pub"), "first")
    assert spark.read.parquet(str(tmp_path / "pub/data")).count() == 1


def test_messages_and_lines(spark):
    one = spark.createDataFrame([("w", ["e1", None, "e2"])], "word string, examples array<string>")
    user = prompts.explication_user(F.col("word"), F.col("examples"))
    for mode, n in (("native", 2), ("emulated", 3), ("inline", 1)):
        assert one.select(F.size(prompts.messages(F.lit("s"), user, mode=mode)).alias("n")).first().n == n
    line = json.loads(one.select(prompts.parts_line(F.lit("k"), prompts.messages(F.lit("s"), user)).alias("x")).first().x)
    assert line["request"]["system_instruction"]["parts"][0]["text"] == "s" and line["request"]["contents"][0]["role"] == "user"
    assert line["request"]["generationConfig"]["response_mime_type"] == "text/plain"
    plain = json.loads(one.select(prompts.parts_line(F.lit("k"), prompts.messages(F.lit("s"), user, mode="emulated")).alias("x")).first().x)
    assert set(plain["request"]) == {"contents"} and [t["role"] for t in plain["request"]["contents"]] == ["user", "model", "user"]
    assert one.select(prompts.messages(F.lit(None).cast("string"), user).alias("m")).first().m[0].role == "user"
    with pytest.raises(ValueError):
        prompts.messages(F.lit("s"), user, mode="other")
    with pytest.raises(Exception, match="no such role"):
        one.select(prompts.parts_line(F.lit("k"), F.array(prompts.message("tool", user)))).collect()


def test_mode_of_each_grader(spark):
    rows = [("acme/Gemma", -1, "native"), ("acme/Gemma", 0, "emulated"), ("acme/gemma", -1, "emulated"), ("other", 2, "native")]
    df = spark.createDataFrame(rows, "grader string, slot int, want string")
    msgs = prompts.messages(F.lit("s"), F.lit("u"), mode=prompts.grader_mode(F.col("grader"), F.col("slot")))
    for r in df.select("want", msgs.alias("m")).collect():
        assert [m.role for m in r.m] == (["system", "user"] if r.want == "native" else ["user", "assistant", "user"])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "M", "you see this", "2024-01-01 00:00:00"), (1, "M", "you see this", "2024-01-02 00:00:00"), (2, "m ", "cat", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "expl_id long, model string, text string, loaded_at string").withColumn("loaded_at", F.to_timestamp("loaded_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.legality_stream(S.explication_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("legality").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.expl_id, r.model, r.length, r.primes) for r in spark.table("legality").collect())
    assert got == [(1, "m", 3, 3), (2, "m", 1, 0)]
