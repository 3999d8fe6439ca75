import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from primeloom.functions import lexicon as L
from primeloom.functions import text as X
from primeloom.functions import truncate as T
from primeloom.plans.report import score_one


def words(s):
    return re.sub(r"[^\w\s]", "", s.lower()).split()


@pytest.mark.parametrize(
    "text, length, primes, stops, rest, unique",
    [
        ("", 0, 0, 0, 0, 0),
        (None, 0, 0, 0, 0, 0),
        ("I don't want this.", 4, 3, 0, 1, 1),
        ("the same thing", 3, 1, 2, 0, 0),
        ("a long time", 3, 1, 1, 1, 1),
        ("naïve ²", 2, 0, 0, 2, 2),
        ("cat cat cat", 3, 0, 0, 3, 1),
    ],
)
def test_counts(spark, text, length, primes, stops, rest, unique):
    row = spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("k")).select(*[c.alias(n) for n, c in X.legality(F.col("k")).items()]).first()
    assert (row.length, row.primes, row.stop_words, row.molecules, row.unique_molecules) == (length, primes, stops, rest, unique)
    assert row.primes_ratio == (primes / length if length else 0)


def test_lexicons():
    assert len(L.PRIMES) == 70 and len(L.STOP_WORDS) == 127 and not set(L.PRIMES) & set(L.STOP_WORDS) and len(L.LEGAL_PUNCTUATION) == 12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cc", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Lm", "Lo"))), min_size=1, max_size=12))
def test_tokens_equal_the_definition(spark, texts):
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.tokens(F.col("t")).alias("k")).collect()]
    assert got == [words(t) for t in texts]


def test_circularity(spark):
    rows = [("Bank", "a bank is here"), ("bank note", "this bank"), ("note", "bank"), (None, "bank"), ("", "bank")]
    df = spark.createDataFrame(rows, "w string, t string").select(X.circular_exact(F.col("w"), X.tokens(F.col("t"))).alias("c"))
    assert [r.c for r in df.collect()] == [True, True, False, None, None]
    lemma = spark.createDataFrame([("feels", "they feel")], "w string, t string").select(X.circular_lemma(F.col("w"), X.tokens(F.col("t")), {"feels": "feel"}).alias("c"))
    assert lemma.first().c


def test_capitalise_route_and_bands(spark):
    one = spark.range(1)
    assert one.select(X.capitalise(F.lit("o'NEIL abc")).alias("x")).first().x == "O'neil abc"
    names = {"Acme/GPT-llama": "gpt", "x/mistral-demo": "mistral", "acme/Demo-1b": "demo", "other": None}
    for name, want in names.items():
        assert one.select(X.route(F.lit(name)).alias("x")).first().x == want
    assert [one.select(X.band(F.lit(v), 0.6, 0.4, True).alias("x")).first().x for v in (0.6, 0.5, 0.1)] == ["good", "fair", "poor"]


@pytest.mark.parametrize("text, want", [("l1\nl2\nl3", ["l1\nl2", "l1"]), ("one", [""]), ("a\nb", ["a", ""]), ("", [""]), (" \n x \n\n", [""]), (None, [""])])
def test_explication_variants(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(T.explication_variants(F.col("t")).alias("v")).first()
    assert [v.text for v in row.v] == want


@pytest.mark.parametrize(
    "text, want",
    [("A b. The <UNK> c. D e. F.", ["The <UNK> c. D e. F", "The <UNK> c. F"]), ("<UNK>.", []), ("", []), (None, []), ("a. b. <UNK> c", ["b. <UNK> c", "<UNK> c"]), ("a. b", ["b", ""])],
)
def test_passage_variants(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(T.passage_variants(F.col("t")).alias("v")).first()
    assert [v.text for v in row.v] == want


def test_score_one(spark):
    r = score_one(spark, " glow ", ["The coals glow.", " "], "you can see this").first()
    assert (r.length, r.primes, r.primes_band, r.circularity) == (4, 4, "good", "no") and "glow" in r.prompt
    for word, examples in (("", ["x"]), ("x", []), ("x", [" "])):
        with pytest.raises(ValueError):
            score_one(spark, word, examples, "y")
