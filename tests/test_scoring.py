import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from primeloom.functions import logits as G
from primeloom.operators import bleu, plugins
from primeloom.plans import dispersion as D
from primeloom.plans import fanout, scoring
from primeloom.plans import translation as R

SCHEMA = "grader string, entry_id long, model string, passage_id int, slot int, answer_logprob double, is_match boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_hand_worked_scores(spark):
    rows = [("g", 1, None, 0, -1, -10.0, False)] + [("g", 1, "M ", 0, s, v, s == 0) for s, v in enumerate((-4.0, -5.0, -7.0, -6.0, -5.0))]
    r = scoring.sub_scores(table(spark, rows)).first()
    assert (r.model, r.avg_delta_log, r.avg_min_delta_log, r.avg_ent_delta_log, r.adj_score, r.total_match) == ("m", 6, -1.5, -0.5, 7, 1)
    e = spark.createDataFrame([(1, "m", 0.75, 0.25, False), (1, "m", 0.75, 0.25, True), (2, "m", 0.5, 0.0, None)], "entry_id long, model string, primes_ratio double, molecules_ratio double, uses_original_word boolean")
    got = sorted(x.total_score for x in scoring.explication_scores(e, scoring.sub_scores(table(spark, rows))).collect())
    assert got == [0.0, 10.0, 24.0]


def test_cap_holes_and_missing_baseline(spark):
    rows = [("g", 1, None, 0, -1, -99.0, False), ("g", 1, "m", 0, 0, -1.0, True), ("g", 1, "m", 0, 1, -2.0, True), ("g", 1, "m", 0, 3, -1.0, None), ("g", 2, "m", 0, 0, -1.0, True)]
    got = {r.entry_id: r for r in scoring.sub_scores(table(spark, rows)).collect()}
    assert got[1].adj_score == 40.0 and got[1].total_match == 2
    assert got[2].avg_delta_log is None and got[2].adj_score is None


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(3)
    rows = []
    for e in range(12):
        for p in range(3):
            rows.append(("g", e, None, p, -1, rng.uniform(-9, 0), False))
            rows += [("g", e, "m", p, s, rng.uniform(-9, 0), rng.random() < 0.5) for s in range(5) if rng.random() < 0.8]
    want = {}
    by = defaultdict(dict)
    for _, e, m, p, s, v, _ in rows:
        by[e, p][s] = v
    for e in range(12):
        d, a, b = [], [], []
        for p in range(3):
            v = by[e, p]
            d += [v[0] - v[-1]] if 0 in v else []
            a += [v[x] - v[y] for x, y in ((1, 0), (2, 1)) if x in v and y in v]
            b += [v[x] - v[y] for x, y in ((3, 0), (4, 3)) if x in v and y in v]
        want[e] = [np.mean(x) if x else None for x in (d, a, b)]
    for r in scoring.sub_scores(table(spark, rows)).collect():
        for got, w in zip((r.avg_delta_log, r.avg_min_delta_log, r.avg_ent_delta_log), want[r.entry_id]):
            assert got is None if w is None else abs(got - w) < 1e-9


def test_fan_out_counts(spark):
    e = spark.createDataFrame([(1, 7, "m", "a\nb\nc"), (2, 8, "m", "x"), (3, None, "m", "y")], "expl_id long, entry_id long, model string, text string")
    p = spark.createDataFrame([(7, 0, "A. The <UNK>. B."), (7, 1, "no mask"), (8, 0, "<UNK>.")], "entry_id long, passage_id int, text string")
    got = sorted((r.entry_id, r.slot) for r in fanout.conditions(e, p).collect())
    assert got == [(7, -1), (7, 0), (7, 1), (7, 2), (7, 3), (7, 4), (8, -1), (8, 0), (8, 1)]


def test_logits(spark):
    x = [1.0, 3.0, 3.0, -500.0]
    r = spark.createDataFrame([(x, 1)], "l array<double>, a int").select(G.log_prob(F.col("l"), F.col("a")).alias("p"), G.rank(F.col("l"), F.col("a")).alias("r"), G.argmax(F.col("l")).alias("m")).first()
    assert abs(r.p - (3 - np.log(np.exp(x).sum()))) < 1e-12 and (r.r, r.m) == (1, 1)


def test_bleu(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b", "c d"), (3, "", "a"), (4, "the cat", "the cat sat down"), (5, None, None)]
    got = {r.k: r.bleu for r in bleu.sentence_bleu(spark.createDataFrame(rows, "k int, h string, r string"), "h", "r").collect()}
    assert abs(got[1] - 100) < 1e-9 and got[2] == 0 and got[3] == 0 and abs(got[4] - 100 * np.exp(-1)) < 1e-9 and got[5] == 0


def test_words_of_several_tokens(spark):
    steps = [[2.0, 1.0, 0.0], [0.0, 0.0, 3.0]]
    rows = [(1, steps, [0, 2], [1, 0]), (2, steps, [1], [0]), (3, steps, [0, 2, 1], [0]), (4, steps, [], [1])]
    df = spark.createDataFrame(rows, "k int, steps array<array<double>>, lower array<int>, capital array<int>")
    got = {r.k: r.g for r in df.select("k", G.graded_word(F.col("steps"), F.col("lower"), F.col("capital")).alias("g")).collect()}
    one, two = (x - np.log(np.exp(x).sum()) for x in (np.array(s) for s in steps))
    assert got[1].form == "lower" and abs(got[1].answer_logprob - (one[0] + two[2])) < 1e-12 and got[1].answer_ranks == [1, 1] and got[1].is_match
    assert got[2].form == "capital" and abs(got[2].answer_logprob - one[0]) < 1e-12 and not got[2].is_match  # two tokens were made, one is asked
    assert got[3].form == "capital" and got[4].form == "capital"


def test_round_trip_scores(spark):
    texts = spark.createDataFrame([(1, "m", "this thing"), (2, "m", None)], "expl_id long, model string, text string")
    scored = R.scores(R.round_trip(texts, ["de", "xx"], plugins.fake_translator, 1), plugins.fake_embedder, plugins.fake_metric)
    got = {(r.expl_id, r.lang): r for r in scored.collect()}
    assert got[1, "de"].back == "that thing" and got[1, "xx"].back == "" and got[1, "xx"].bleu == 0 and got[1, "xx"].embed == 0 and got[2, "de"].metric == 1.0
    assert len(R.arrays(scored).where("expl_id = 1").first().bleu_scores) == 2
    assert R.round_trip(texts, [], plugins.fake_translator).count() == 0


def test_dispersion_and_splice(spark):
    r = D.deviations(spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 4.0)], "model string, v double"), "model", ["v"]).first()
    assert abs(r.v_std - 1.247219128924647) < 1e-12 and abs(r.v_bar - 0.008370598) < 1e-8
    a = spark.createDataFrame([("m", 1, [1.0, 2.0, 3.0, 4.0, 5.0])], "model string, entry_id long, s array<double>")
    b = spark.createDataFrame([("m", 1, [9.0]), ("m", 2, [8.0])], "model string, entry_id long, s array<double>")
    assert [x.s for x in D.splice(a, b, ["model", "entry_id"], "s").collect()] == [[1, 2, 3, 4, 0, 0, 0, 9]]


def test_plugins(spark):
    rows = spark.createDataFrame([(1, "some text", "de"), (2, "other", "xx")], "id long, text string, lang string")
    assert {r.id: r.back for r in plugins.translate(rows, plugins.fake_translator, 1).collect()} == {1: "some text", 2: ""}
    assert all(len(r.vector) == 8 for r in plugins.embed(rows, plugins.fake_embedder).collect())
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "hypothesis string, reference string")
    assert max(r.metric for r in plugins.measure(pairs, plugins.fake_metric).collect()) == 1.0
    try:
        plugins.generate(rows, plugins.fake_generator, 0)
        raise AssertionError
    except ValueError:
        pass


@pytest.mark.parametrize("wrong", [{"max_new_tokens": 0}, {"top_k": -1}, {"top_p": 0.0}, {"temperature": 0.0}])
def test_decoding_is_checked(wrong):
    with pytest.raises(ValueError):
        plugins.Decoding(**wrong)
    assert plugins.GREEDY.max_new_tokens == 512


def test_position_deviations(spark):
    df = spark.createDataFrame([("m", [1.0, 5.0]), ("m", [3.0]), ("m", None)], "model string, b array<double>")
    got = {r.position: (r.std, r.bar) for r in D.position_deviations(df, "model", {"bleu": "b"}, (0, 1, 7), 2.0).collect()}
    assert got == {0: (1.0, 0.5), 1: (0.0, 0.0)}


def test_scores_embed_a_text_once_for_all_languages(spark, tmp_path):
    """A text's vector doesn't depend on the language, and a text that came back as it was is no other text."""

    def counting():
        def run(batch):
            with open(tmp_path / "texts", "a") as f:
                f.writelines(f"{t}\n" for t in batch["text"])
            return plugins.fake_embedder()(batch)

        return run

    texts = spark.createDataFrame([(1, "See this. People are here"), (2, " . "), (3, None)], "expl_id long, text string").coalesce(1)
    scored = R.scores(R.round_trip(texts, list(plugins.FAKE_LOSSES), plugins.fake_translator), counting, plugins.fake_metric, 2)
    got = {(r.expl_id, r.lang): (r.bleu, r.embed) for r in scored.collect()}
    assert got[1, "hi"] == (100.0, pytest.approx(1.0)) and 0 < got[1, "de"][0] < 100 and got[2, "de"] == got[3, "de"] == (0.0, 0.0)
    embedded = (tmp_path / "texts").read_text().splitlines()
    assert len(embedded) == len(set(embedded))
