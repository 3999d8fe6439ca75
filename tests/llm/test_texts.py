import datetime as dt
import random
import time
from collections import Counter

import numpy as np
import pytest

from primeloom.llm import answers as A
from primeloom.llm import leaks as K
from primeloom.llm import mixing as M
from primeloom.llm import pairs as P
from primeloom.llm import reading_level as R
from primeloom.llm import term_counts as T
from primeloom.llm import truncated as C
from primeloom.llm import words as W
from primeloom.llm.fm_index import FMIndex, suffix_array


# ---- terms


def test_terms_equal_a_count(frame):
    rng = random.Random(4)
    said = [" ".join(rng.choice(["turn", "Turn,", "see", "x" + str(rng.randrange(40)), "né"]) for _ in range(rng.randrange(0, 30))) for _ in range(80)] + [None, "", " \n", "turn " * 5000]
    e = frame("explications", [{"expl_id": i, "text": t} for i, t in enumerate(said)] + [{"expl_id": 3, "text": said[3]}, {"expl_id": None, "text": "lost"}])
    n = frame("nsm_dataset", [{"row_id": i, "explication": t} for i, t in enumerate(said[:40])])
    occurrences, records = Counter(), Counter()
    full = [t for t in said + said[:40] if t is not None]
    for t in full:
        occurrences.update(W.words(t))
        records.update(set(W.words(t)))
    mark = {w: "rare" if records[w] < 3 else "common" if records[w] > 0.25 * len(full) else None for w in occurrences}
    got = {r.term: (r.occurrences, r.records, r.mark) for r in T.terms(e, n).collect()}
    assert got == {w: (occurrences[w], records[w], mark[w]) for w in occurrences}
    assert T.terms(frame("explications", []), frame("nsm_dataset", [])).count() == 0


# ---- leaks


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    for n, k in ((1, 2), (50, 2), (300, 3), (400, 200), (64, 1)):
        s = rng.integers(0, k, n)
        assert suffix_array(s, k).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        index = FMIndex(s, k)
        phrases = rng.integers(0, k, (30, 3)) if k > 1 else np.zeros((1, 3), np.int64)
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(n - 2) if s[i : i + 3].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(K, "SHARD_WORDS", 300)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [{"item_id": i, "text": " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))} for i in range(30)] + [{"item_id": 90, "text": None}, {"item_id": 91, "text": "one two"}]
    docs = []
    for i in range(120):
        said = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            other = rng.choice(items[:30])["text"].split()
            cut = rng.randrange(0, len(other) + 1)
            said = said + other[cut:] + ["other"] + other[:cut]
        docs.append({"doc_id": i, "text": " ".join(said)})
    docs += [{"doc_id": 200, "text": None}, {"doc_id": 201, "text": docs[0]["text"]}, {"doc_id": None, "text": "w1 w2 w3"}, {"doc_id": 202, "text": "w1 " * 30_000}]
    want = set()
    for d in docs:
        if d["text"] and d["doc_id"] is not None:
            own = W.shingle_set(W.words(d["text"]), 3)
            for i in items:
                s = W.shingle_set(W.words(i["text"]), 3)
                if s and len(s & own) >= 0.5 * len(s):
                    want.add((d["doc_id"], i["item_id"]))
    df, it = frame("documents", docs), frame("benchmark_items", items)
    got = [tuple(r) for r in K.found(df, it).collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(K, "SLICE", 50)
    for words in (dict(block_words=60), dict(pass_words=120, block_words=50)):
        assert {tuple(r) for r in K.leaks(df, it, **words).select("doc_id", "item_id").collect()} == want
    covered = {}
    for d, i in want:
        said, own = W.words(next(x["text"] for x in docs if x["doc_id"] == d)), W.shingle_set(W.words(items[i]["text"]), 3)
        for p in range(len(said) - 2):
            if tuple(said[p : p + 3]) in own:
                for w in (p, p + 1, p + 2):
                    covered.setdefault((d, w), set()).add(i)
    got = {}
    for r in K.removal_spans(df, it).collect():
        assert not any((r.doc_id, w) in covered for w in (r.first_word - 1, r.last_word + 1))
        assert set(r["items"]) == set().union(*(covered[r.doc_id, w] for w in range(r.first_word, r.last_word + 1)))
        got |= {(r.doc_id, w): 1 for w in range(r.first_word, r.last_word + 1)}
    assert set(got) == set(covered)
    for a, b in ((df, frame("benchmark_items", [])), (frame("documents", []), it)):
        assert K.found(a, b).count() == K.leaked_items(a, b).count() == K.removal_spans(a, b).count() == 0


def test_a_phrase_that_all_items_hold(frame):
    items = [{"item_id": i, "text": f"the same opening words item{i} goes on like this{i} here"} for i in range(500)]
    docs = [{"doc_id": d, "text": " and ".join(["the same opening words"] * 40)} for d in range(30)] + [{"doc_id": 100, "text": "x " + items[7]["text"]}]
    assert [tuple(r) for r in K.found(frame("documents", docs), frame("benchmark_items", items)).collect()] == [(100, 7)]


# ---- truncation and answers

LINES = ["it is like a weary cobweb, but it is not heavy", "someone small wants a painted ring", "people can do many things with a shallow flask", "this thing is above this place and dry", "because of this, someone can feel something bad"]


def corpus(rng, n):
    rows = []
    for i in range(n):
        lines = rng.sample(LINES, rng.randrange(2, 5))
        rows.append({"row_id": i, "source": "s", "word": "lampstone", "examples": ["The lampstone lay under a kettle in the meadow."], "explication": "\n".join(x + "." for x in lines)})
    return rows


def test_truncated_and_defects(frame):
    rng = random.Random(8)
    rows = corpus(rng, 120)
    sound = {900: "someone small wants a painted ring\npeople can do many things with a shallow flask", 901: "This thing is above this place and dry"}
    cut = {910: "someone small wants a painted ring\npeople can do many thi", 911: "someone small wants a painted ring\nit is like a", 912: "because of this, someone can feel something bad. people can do many things wit…"}
    other = {
        920: (None, "empty"), 921: ("  ", "empty"), 922: ("Paraphrase:", "empty"), 923: ("n/a", "empty"),
        930: ("I'm sorry, but I can't help with this request.", "refusal"), 931: ("Which sense do you mean? Please provide more context.", "refusal"),
        940: ("The lampstone lay under a kettle in the meadow.", "copy"), 941: ("lampstone, lampstone", "copy"), 942: ("Word: lampstone\nExamples:\nThe lampstone lay under a kettle in the meadow.", "copy"),
        950: ("Das ist etwas kleines, nicht wie den Spiegel. Niemand weiß, warum das so ist.", "language"), 951: ("Это что-то маленькое, люди видят это.", "language"),
    }
    fine = {960: "someone thinks: “sorry, I can’t do this for you”\nthis thing is above this place and dry.", 961: "I am not able to move, because of this I feel something bad.", 962: "people can say this: “The lampstone lay under a kettle in the meadow.”\nsomeone small wants a painted ring.\nthis thing is above this place and dry."}
    base = {"source": "S ", "word": "Lampstone", "examples": ["The lampstone lay under a kettle in the meadow.", None, ""]}
    rows += [base | {"row_id": k, "explication": t} for k, t in {**sound, **cut, **fine}.items()] + [base | {"row_id": k, "explication": t} for k, (t, _) in other.items()]
    rows += [dict(rows[-1])] + [base | {"row_id": 970, "word": None, "examples": None, "explication": "not one, not many."}]
    df = frame("nsm_dataset", rows)
    got = {r.row_id: r.defect for r in A.found(df).collect()}
    assert got == {k: d for k, (_, d) in other.items()} | dict.fromkeys(cut, "truncated")
    e = frame("explications", [{"expl_id": r["row_id"], "model": "M", "entry_id": 1, "text": r["explication"], "target_word": "lampstone"} for r in rows])
    entries = frame("entries", [{"entry_id": 1, "examples": base["examples"]}, {"entry_id": 1, "examples": None}])
    found = sorted(tuple(r) for r in C.found(e, df, entries).collect())
    assert found == sorted((t, k) for t in ("explications", "nsm_dataset") for k in cut)
    rate = {(r.tab, r.origin): r.cut for r in C.rates(e, df, entries).collect()}
    assert rate["explications", "m"] == 3 and rate["nsm_dataset", "s"] == 3
    none = frame("explications", []), frame("nsm_dataset", []), frame("entries", [])
    assert C.found(*none).count() == 0 and A.defects(none[1]).count() == 0 and A.by_source(none[1]).count() == 0


def told_by_copies(texts):
    return {(r.id, r.early) for r in C.told(C.prepared(texts)).collect() if r.early is not None}


def test_copy_verdict():
    whole = "someone small wants a painted ring. it is like a weary cobweb, but it is not heavy. people can do many things with a shallow flask."
    assert C.copy_verdict(whole[:-4], whole) is True
    assert C.copy_verdict(whole[: whole.index(" people")].rstrip("."), whole) is False
    assert C.copy_verdict("something else was said here and there and now", whole) is None
    assert C.copy_verdict(whole, whole + " more") is None
    assert C.copy_verdict("a " * 20_000 + "a", "a " * 20_001 + "b.") is not None


def test_every_longer_copy_is_compared(spark):
    """The longest texts of the end's buckets don't hold its last words; a shorter copy does, and a twin of the end tells nothing."""
    rng = random.Random(3)
    said = [rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(60)]
    end, copy = " ".join(said), " ".join([*said, "and", "more."])
    longer = [" ".join([*said[:54], *(f"z{i}x{j}" for j in range(12))]) + "." for i in range(300)]
    texts = spark.createDataFrame([(1, end), (2, copy), (3, end), *((10 + i, t) for i, t in enumerate(longer))], "id long, text string")
    assert told_by_copies(texts) == {(1, True), (3, True)}
    assert C.copy_verdict(end, end) is None


def test_nearest_copy_decides(spark):
    said = [f"w{i}" for i in range(60)]
    far = " ".join(["x", *said[1:30], "y", *said[31:], "on", "and", "on."])
    texts = spark.createDataFrame([(1, " ".join(said)), (2, " ".join(said) + ". It goes on."), (3, far)], "id long, text string")
    assert told_by_copies(texts) == {(1, False)}


def test_copy_met_on_common_bands_alone_is_compared(spark):
    """The end's rarest bands stand only in a text that is no copy; the copy, delivered often, has that part misspelt."""
    rng = random.Random(12)
    part, rest = ([f"w{rng.randrange(3000)}" for _ in range(n)] for n in (26, 160))
    copy = [w + "x" if i % 3 == 0 else w for i, w in enumerate(part)] + rest
    texts = {1: " ".join(part + rest[:150]), 2: " ".join(part) + " and this is all.", **dict.fromkeys(range(3, 9), " ".join(copy) + ".")}
    assert told_by_copies(spark.createDataFrame(list(texts.items()), "id long, text string")) == {(1, True)}


def test_bands_of_equal_texts_alone_are_not_shared(spark):
    """Copies of a table's rows add no band that is looked up, and a band goes to one task with all that meets on it."""
    said = [[f"w{k}x{i}" for i in range(40)] for k in range(3)]
    texts = [" ".join(said[0])] * 20 + [" ".join(said[1]), " ".join(said[1]) + " and more."]
    held = C.prepared(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    ends = held.where("c IS NOT NULL")
    counts = C.closing_counts(held, C.wanted_filter(ends.selectExpr("explode(concat(c, bands)) AS value")), [3])
    shared = {r[0] for r in counts.where("n IS NULL").select("context").collect()}
    asked = [{k for r in ends.where(f"id {at}").select("bands").collect() for k in r[0]} for at in ("< 20", "= 20")]
    assert not shared & asked[0] and shared == asked[1]
    rows = C.band_rows(held, C.wanted_filter(ends.selectExpr("explode(bands) AS value")))
    met = {r["id"] for r in rows.where("asks").select("id").collect()}
    assert met == set(range(21)) and {r["id"] for r in rows.select("id").distinct().collect()} == set(range(22))


def test_an_end_met_by_more_texts_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(C, "MET", 4)
    said = [f"w{i}" for i in range(40)]
    texts = [" ".join(said), *(" ".join([*said, f"z{i}", "more."]) for i in range(20))]
    assert told_by_copies(spark.createDataFrame(list(enumerate(texts)), "id long, text string")) == {(0, True)}


def test_kept_tables_leave_no_shuffle_files(spark):
    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for keep in (P.kept, P.stored):
        got = keep(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
        assert sorted(r["count"] for r in got.collect()) == [142] + [143] * 6
    left, until = files() - before, time.time() + 10
    while left and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
        left = files() - before
    assert not left and spark.conf.get(name) == "false"


@pytest.mark.parametrize("texts_a_part", [1, 40])
def test_bands_in_parts_tell_the_same(spark, monkeypatch, texts_a_part):
    rng = random.Random(5)
    whole = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(30)]
    rows = [(2 * i + j, " ".join(said[:n]) + end) for i, said in enumerate(whole) for j, (n, end) in enumerate(((60, "."), (20 + i, "")))]
    texts = spark.createDataFrame(rows, "id long, text string")
    at_once = told_by_copies(texts)
    monkeypatch.setattr(C, "PART_TEXTS", texts_a_part)
    assert told_by_copies(texts) == at_once == {(2 * i + 1, True) for i in range(30)}


@pytest.mark.parametrize("part", [0.25, 0.5, 0.9])
def test_strongly_cut_texts_meet_their_copies(spark, part):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        said = [f"w{rng.randrange(3000)}" for _ in range(80)]
        rows.append((2 * i, " ".join(said) + "."))
        copy = [w + "x" if j % 19 == 7 and 20 < j < 60 * part else w for j, w in enumerate(said)]
        rows.append((2 * i + 1, " ".join(copy[: int(80 * part)])))
    texts = spark.createDataFrame(rows, "id long, text string")
    assert {k for k, early in told_by_copies(texts) if early} >= {2 * i + 1 for i in range(60)}


def test_long_words_and_notes_are_read_whole(spark):
    word, note = "x" * 90, "(" + "n" * 100 + ")"
    assert C.open_end(f"it is like a {note}") == "it is like a" and C.open_end(f"it is. {note}") is None
    rows = [(i, f"it is {word} here. it is said {word} here.") for i in range(8)] + [(50, f"it is here. it is {word[:45]}")]
    texts = spark.createDataFrame(rows, "id long, text string")
    assert {r.id: r.cut for r in C.told(C.prepared(texts)).collect()} == {50: True}


@pytest.mark.parametrize("kilobytes", [1, 140, 700])
def test_copies_of_any_length_are_told(kilobytes):
    rng = random.Random(kilobytes)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(kilobytes * 150))
    assert A.is_copy("w", [long], long) and A.is_copy("w", ["first example", long, "a last one"], long)
    assert not A.is_copy("w", [long], " ".join(str(rng.randrange(10**6)) for _ in range(kilobytes * 150)))


def test_languages_without_a_dictionary():
    for text in (
        "Bu küçük bir şey, insanlar onu her gün evde görüyor.", "Tämä on jokin pieni asia, jonka ihmiset näkevät kotona.",
        "Ini sesuatu yang kecil, orang melihatnya setiap hari.", "Acesta este un lucru mic, oamenii îl văd acasă.",
    ):
        assert A.label("w", [], text) == "language"
    assert A.label("w", [], "someone small wants a painted ring because of this") is None


def test_long_texts_have_labels():
    assert A.label("w", ["e"], "x" * 200_000) is None
    assert A.label("w", [], "- " * 100_000) == "empty"


# ---- mixing


@pytest.mark.parametrize("seed", range(6))
def test_budget_is_met_where_it_can_be(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 60, 12))
    counts = rng.integers(1, 9, len(lengths))
    sums = {0}
    for length, n in zip(lengths.tolist(), counts.tolist()):
        sums = {s + j * length for s in sums for j in range(n + 1)}
    for budget in rng.integers(0, int((lengths * counts).sum()) + 5, 12).tolist():
        for window in (40, 16_384):
            taken = M.fit_budget(lengths, counts, budget, window)
            total = int((taken * lengths).sum())
            assert (taken >= 0).all() and (taken <= counts).all() and total <= budget
            nearest = max(s for s in sums if s <= budget)
            assert total == nearest if budget <= 4 * window else total >= nearest - lengths.max()


def test_mixture(frame):
    rng = random.Random(2)
    docs = [{"doc_id": i, "source": ("A", " a", "b", "c", None)[i % 5], "text": "word " * rng.randrange(1, 60)} for i in range(300)]
    docs += [{"doc_id": 900, "source": "a", "text": None}, {"doc_id": 901, "source": "a", "text": ""}, {"doc_id": 902, "source": "tiny", "text": "one two three"}, {"doc_id": None, "source": "a", "text": "x"}]
    targets = [{"source": "a", "target_share": 0.5, "max_repeats": 1}, {"source": "B ", "target_share": 0.3, "max_repeats": 2}, {"source": "tiny", "target_share": 0.1, "max_repeats": 50}, {"source": "none", "target_share": 0.1, "max_repeats": 3}, {"source": None, "target_share": 0.2, "max_repeats": 1}]
    d, t = frame("documents", docs), frame("mix_targets", targets)
    share = {r.source: r for r in M.shares(d, t).collect()}
    drawn = M.mixture(d, t).collect()
    uses = Counter()
    for r in drawn:
        uses[r.source] += r.tokens * r.uses
    assert len({r.doc_id for r in drawn}) == len(drawn) and {r.source for r in drawn} == {"a", "b", "tiny"}
    total = sum(uses.values())
    for name, most in (("a", 1), ("b", 2), ("tiny", 50)):
        assert max(r.uses for r in drawn if r.source == name) <= most
        assert share[name].drawn_tokens == uses[name] and abs(uses[name] / total - share[name].feasible_share) < 0.05
    assert share["none"].actual_share == 0 and share["none"].feasible_share == 0
    assert [r.asDict() for r in M.mixture(d, t).orderBy("doc_id").collect()] == [r.asDict() for r in sorted(drawn, key=lambda r: r.doc_id)]
    assert M.mixture(frame("documents", []), t).count() == 0 and M.shares(d, frame("mix_targets", [])).count() == 0
    fixed = {r.source: r.budget for r in M.shares(d, t, total_tokens=200).collect()}
    assert sum(fixed.values()) <= 200


# ---- reading level


def level_text(rng, level):
    if level == 1:
        return "The {} is red. I see a {}. We like the {}.".format(*rng.sample(["cat", "dog", "bus", "hat", "pig"], 3))
    if level == 2:
        return "The {} carried the wooden {} because the children were hungry.".format(*rng.sample(["potter", "farmer", "kettle", "basket", "window"], 2))
    if level == 3:
        return "Although the {} was explained in many older books, several readers noticed that the second paragraph explains the difference between the two examples because the guests had already gone home.".format(rng.choice(["custom", "lesson", "honour"]))
    return "Notwithstanding considerable methodological disagreement concerning {}, comprehensive reconsideration necessitates fundamentally terminological interpretations of historically sedimented conventionalisation and differentiation.".format(rng.choice(["incommensurability", "intertranslatability", "compositionality"]))


def test_levels(frame):
    rng = random.Random(9)
    docs, labels, want = [], [], {}
    for i in range(160):
        level = i % 4 + 1
        own = [level_text(rng, level) for _ in range(18 if level == 1 else 8)]
        own.insert(3, level_text(rng, rng.randrange(1, 5)))
        docs.append({"doc_id": i, "lang": "en" if i % 8 else "EN ", "text": "# Heading\r\n\r\n" + " ".join(own) + "\n\n- someone small wants a ring\nPage 3 of 9"})
        want[i] = level
        if i % 3 == 0:
            labels.append({"doc_id": i, "reading_level": level if i % 15 else None, "rater": "a"})
    labels += [dict(labels[2]), {"doc_id": 999, "reading_level": 4}, {"doc_id": None, "reading_level": 1}]
    docs += [{"doc_id": 500, "lang": "en", "text": "Too short."}, {"doc_id": 501, "lang": "de", "text": "Das ist ein Wort. " * 40}, {"doc_id": 502, "lang": "en", "text": None}, {"doc_id": 503, "lang": None, "text": "The cat. " * 60}]
    docs += [{"doc_id": 504, "lang": "en", "text": "the cat is here " * 40_000}]
    d, lab = frame("documents", docs), frame("level_labels", labels)
    got = {r.doc_id: r.reading_level for r in R.found(d, lab).collect()}
    assert set(got) == set(want) | {504}
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert {r.reading_level for r in R.found(d, frame("level_labels", [])).collect()} == {None}
    assert R.found(frame("documents", []), lab).count() == 0
    assert R.profile(d, lab).count() >= 4


def test_coverage_rank():
    ranks, group = np.array([0, 5, 9, 1, 2, 3, 4, 100]), np.array([0, 0, 0, 1, 1, 1, 1, 1])
    assert R.coverage_rank(ranks, group).tolist() == [9, 4]


def test_ranks_beyond_the_table_are_exact(spark):
    rng = random.Random(5)
    texts = [" ".join(" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(4, 14))).capitalize() + "." for _ in range(9)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = R.word_ranks(docs)
    counts = Counter(w for t in texts for w in W.words(t))
    want = {w: sum(m >= n for m in counts.values()) for w, n in counts.items()}
    assert {r.word: r["rank"] for r in ranks.collect()} == want
    rows = lambda ranked: {r.doc_id: (r.doc_rank, [tuple(s) for s in r.sentences]) for r in R.sentence_measures(docs, ranks, 10, ranked).collect()}
    assert rows(10) == rows(60) == rows(50_000)


def test_last_delivery_counts(frame):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    df = frame("nsm_dataset", [{"row_id": 1, "explication": "older text", "loaded_at": old}, {"row_id": 1, "explication": "newer text", "loaded_at": new}])
    assert {r.term for r in T.terms(frame("explications", []), df).collect()} == {"newer", "text"}
