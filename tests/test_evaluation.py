import json

import pytest

from primeloom.operators import plugins
from primeloom.plans import evaluation
from primeloom.sources import readers, sinks


@pytest.mark.parametrize("languages", [[], ["de", "fr"]])
def test_a_run_from_its_configuration(spark, tmp_path, languages):
    raw = {
        "dataset": {"name": "d", "split": "test"}, "output_path": "o", "languages": languages,
        "models": [{"model": "Acme/GPT", "num_examples": 1, "use_system_prompt": True, "max_batch_size": 2}, {"model": "acme/plain", "use_system_prompt": False}],
        "grader_models": [{"model": "acme/gemma", "max_batch_size": 3}, {"model": "acme/other"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(raw))
    config = readers.config(str(tmp_path / "c.json"))
    entries = spark.createDataFrame([(1, "glow", "something warm. people see it", ["The coals glow."]), (2, "hush", None, [])], "entry_id long, word string, def string, examples array<string>")
    passages = spark.createDataFrame([(1, 0, "The <UNK> stayed. It was late.", None), (1, 1, "no mask", None)], "entry_id long, passage_id int, text string, src string")
    bank = spark.createDataFrame([([("u", "a"), ("v", "b")],)], "bank array<struct<user:string,assistant:string>>")
    graders = {g["model"]: plugins.fake_grader for g in raw["grader_models"]}
    made = {"gpt": plugins.fake_generator, "acme/plain": plugins.fake_generator}
    scored, models = evaluation.evaluate(entries, passages, bank, config, made, graders, plugins.fake_translator, plugins.fake_embedder, plugins.fake_metric)
    rows = {(r.model, r.entry_id): r for r in scored.collect()}
    assert set(rows) == {(m, e) for m in (evaluation.BASELINE, "acme/gpt", "acme/plain") for e in (1, 2)}
    one = rows["acme/gpt", 1]
    assert one.text == "this is something like glow." and one.uses_original_word and one.total_score == 0.0
    assert len(one.sub_scores) == 2 and len(one.sub_scores[0].baselines) == 1 and [len(x) for x in one.sub_scores[0].entailments] == [1]
    assert rows["acme/gpt", 2].sub_scores is None and rows[evaluation.BASELINE, 2].length == 0
    assert (len(one.bleu_scores) == 2 and one.bleu_scores[0] < 100) if languages else one.bleu_scores is None
    assert {r.model: len(r.avg_bleu or []) for r in models.collect()} == dict.fromkeys((evaluation.BASELINE, "acme/gpt", "acme/plain"), len(languages))
    sinks.write_results(scored, models, str(tmp_path / "run"), [g["model"] for g in config.graders], config.languages)
    assert readers.result_lines(spark, str(tmp_path / "run")).count() == 6
