"""The registered queries of the core, each beside its DuckDB form where SQL can express it.

Each takes whole tables. Explications count once: the last delivery of each ``expl_id``, with the model's name in lower case
without outer blanks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from primeloom.functions import lexicon as L
from primeloom.functions import logits as G
from primeloom.functions import text as X
from primeloom.functions import truncate as T
from primeloom.operators import plugins
from primeloom.operators.batching import by_length
from primeloom.operators.bleu import sentence_bleu
from primeloom.plans import dispersion as D
from primeloom.plans import fanout, prompts, scoring
from primeloom.plans.prompts import DEFAULT
from primeloom.plans import lemmas
from primeloom.plans import translation as R
from primeloom.sources import readers, sinks, storage
from primeloom.sources.schemas import EXPLICATION, EXPLICATION_FIELDS, MODEL, MODEL_FIELDS
from primeloom.streaming import scoring as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ---- shared forms, Spark


def _explications(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """The last delivery of each explication with ``columns`` besides its keys; re-deliveries are equal, so no other column is read."""
    rows = readers.table(spark, d, "explications").where("expl_id IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("expl_id").orderBy(F.col("loaded_at").desc_nulls_last()))
    return rows.withColumn("_t", turn).where("_t = 1").select("expl_id", scoring.model_key().alias("model"), "entry_id", *columns)


def _scored_texts(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Explications with their counts and the circularity flag. Tokens are made once a row."""
    rows = _explications(spark, d, "text", "target_word", *columns).withColumn("toks", X.tokens(F.col("text")))
    circular = X.circular_exact(F.col("target_word"), F.col("toks"))
    return rows.withColumns(X.legality(F.col("toks"))).withColumn("uses_original_word", circular).drop("toks")


def _final_scores(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return scoring.explication_scores(_scored_texts(spark, d, *columns), scoring.sub_scores(readers.table(spark, d, "predictions")))


def _records(spark: SparkSession, d: str, *splits: str) -> DataFrame:
    """The last delivery of each record, of some splits where named: these are chosen in the scan."""
    rows = readers.table(spark, d, "nsm_dataset").where("row_id IS NOT NULL")
    rows = rows.where(F.col("split").isin(*splits)) if splits else rows
    turn = F.row_number().over(Window.partitionBy("row_id").orderBy(F.col("loaded_at").desc_nulls_last()))
    return rows.withColumn("_t", turn).where("_t = 1").drop("_t")


def _bank(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """One row: the first n sound training records as an array of pairs."""
    rows = _records(spark, d, "train").where("word IS NOT NULL AND explication IS NOT NULL AND trim(explication) <> ''")
    first = rows.orderBy("row_id").limit(n)
    pair = F.struct("row_id", F.concat(F.lit("Word: "), F.col("word")).alias("user"), F.col("explication").alias("assistant"))
    return first.agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.struct(p["user"].alias("user"), p["assistant"].alias("assistant"))).alias("bank"))


def _flat(msgs: Column) -> list[Column]:
    """A message list as comparable columns."""
    return [
        F.size(msgs).cast("long").alias("n"),
        F.array_join(F.transform(msgs, lambda m: m["role"]), ",").alias("roles"),
        F.array_join(F.transform(msgs, lambda m: m["content"]), "\n--\n").alias("content"),
    ]


# ---- shared forms, SQL

_LIST = "[" + ", ".join(f"'{w}'" for w in L.PRIMES) + "]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "]"


def words_sql(x: str) -> str:
    """The tokens of a text as a DuckDB list."""
    return (
        r"list_filter(string_split_regex(regexp_replace(lower(coalesce(" + x + r", '')), '[^\p{L}\p{N}_\s\x{0085}\p{Z}]', '', 'g'), '[\s\x{0085}\p{Z}]+'), lambda t: t <> '')"
    )


def _strip(x: str) -> str:
    return r"regexp_replace(" + x + r", '^[\s\x{0085}\p{Z}]+|[\s\x{0085}\p{Z}]+$', '', 'g')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_E = "e AS (SELECT * REPLACE (lower(trim(model)) AS model) FROM explications WHERE expl_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY expl_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_R = "r AS (SELECT * FROM nsm_dataset WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_K = f"{_E}, k AS (SELECT *, {words_sql('text')} AS toks, {words_sql('target_word')} AS tt FROM e)"
_C = (
    f"{_K}, c AS (SELECT expl_id, model, entry_id, run_id, text, target_word, bleu_scores, len(toks) AS len_, len(list_filter(toks, lambda t: list_contains({_LIST}, t))) AS primes, "
    f"len(list_filter(toks, lambda t: list_contains({_STOPS}, t))) AS stop_words, list_filter(toks, lambda t: NOT list_contains({_LIST}, t) AND NOT list_contains({_STOPS}, t)) AS mol, "
    "CASE WHEN target_word IS NULL OR len(tt) = 0 THEN NULL ELSE list_contains(toks, tt[1]) END AS circ FROM k), "
    "l AS (SELECT *, len(mol) AS molecules, CASE WHEN len_ > 0 THEN primes / len_ ELSE 0.0 END AS pr, CASE WHEN len_ > 0 THEN len(mol) / len_ ELSE 0.0 END AS mr FROM c)"
)
_S = (
    "p AS (SELECT grader, entry_id, lower(trim(model)) AS model, passage_id, slot, answer_logprob AS lp, is_match FROM predictions), "
    "b AS (SELECT grader, entry_id, passage_id, max(lp) AS base FROM p WHERE slot = -1 GROUP BY ALL), "
    "s AS (SELECT grader, entry_id, model, passage_id, "
    + ", ".join(f"max(lp) FILTER (slot = {i}) AS s{i}" for i in range(5))
    + ", "
    + " + ".join(f"coalesce(max(is_match::INT) FILTER (slot = {i}), 0)" for i in range(5))
    + " AS matches FROM p WHERE slot BETWEEN 0 AND 4 AND model IS NOT NULL GROUP BY ALL), "
    "d AS (SELECT grader, entry_id, model, avg(s0 - base) AS ad, "
    "sum(coalesce(s1 - s0, 0) + coalesce(s2 - s1, 0)) / nullif(count(s1 - s0) + count(s2 - s1), 0) AS am, "
    "sum(coalesce(s3 - s0, 0) + coalesce(s4 - s3, 0)) / nullif(count(s3 - s0) + count(s4 - s3), 0) AS ae, sum(matches)::BIGINT AS tm "
    "FROM s LEFT JOIN b USING (grader, entry_id, passage_id) GROUP BY ALL), "
    "a AS (SELECT *, CASE WHEN ad - am + ae IS NOT NULL THEN least(40.0, ad - am + ae) END AS adj FROM d)"
)
_X = (
    f"{_C}, {_S}, m AS (SELECT entry_id, model, avg(ad) AS ad, avg(am) AS am, avg(ae) AS ae, avg(adj) AS se FROM a GROUP BY ALL), "
    "x AS (SELECT l.*, coalesce(m.ad, 0) AS ad, coalesce(m.am, 0) AS am, coalesce(m.ae, 0) AS ae, coalesce(m.se, 0) AS se, "
    "CASE WHEN coalesce(circ, false) THEN 0.0 ELSE 2 * (coalesce(m.se, 0) + 10 * pr - 10 * mr) END AS ts FROM l LEFT JOIN m USING (entry_id, model))"
)
_BANK = f"{_R}, bank AS (SELECT list({{'u': 'Word: ' || word, 'a': explication}} ORDER BY row_id) AS bank FROM (SELECT * FROM r WHERE split = 'train' AND word IS NOT NULL AND explication IS NOT NULL AND trim(explication) <> '' ORDER BY row_id LIMIT 5))"
_USER = "'Word: ' || coalesce(word, '') || chr(10) || 'Examples:' || chr(10) || coalesce(array_to_string(examples, chr(10) || chr(10)), '')"


# ---- tables (IO)


@_query("SELECT entry_id, word, def, len(examples)::BIGINT AS n_examples, len(ambig_examples)::BIGINT AS n_ambiguous FROM entries")
def io_eval_scan(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return readers.table(spark, d, "entries").select("entry_id", "word", "def", size("examples").alias("n_examples"), size("ambig_examples").alias("n_ambiguous"))


@_query(f"WITH {_R} SELECT split, count(*) AS records, count(DISTINCT word) AS words FROM r WHERE split IN ('train', 'validation') GROUP BY split")
def io_train_scan(spark: SparkSession, d: str) -> DataFrame:
    data = _records(spark, d, "train", "validation")
    both = readers.split(data, "train").unionByName(readers.split(data, "validation"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("word").alias("words"))


@_query("SELECT * FROM (VALUES ('glow', 1, 'something warm'), ('hush', 0, NULL)) AS t(word, n_examples, explication)")
def io_in_memory(spark: SparkSession, d: str) -> DataFrame:
    rows = [{"word": "glow", "examples": ["The coals glow."], "ns_metalanguage": "something warm"}, {"word": "hush", "examples": [], "ns_metalanguage": None}]
    made = readers.from_rows(spark, rows, "word string, examples array<string>, explication string", {"ns_metalanguage": "explication"})
    return made.select("word", F.size("examples").alias("n_examples"), "explication")


@_query(f"WITH {_BANK} SELECT (i - 1)::INT AS ord, bank[i].u AS \"user\", bank[i].a AS assistant FROM bank, range(1, len(bank) + 1) AS t(i)")
def io_few_shot_bank(spark: SparkSession, d: str) -> DataFrame:
    """A bank file, written as a list of pairs and read."""
    path = storage.new_path(spark, "bank")
    _bank(spark, d).select(F.to_json(F.transform("bank", lambda p: F.array(p["user"], p["assistant"])))).write.text(path)
    return readers.few_shot_bank(spark, path)


# ---- tokens and lexicons (TX, JN7, SO1, BD)


@_query(f"WITH {_C} SELECT expl_id, len_ AS length, primes, stop_words, molecules FROM l")
def tx_legality_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scored_texts(spark, d).select("expl_id", "length", "primes", "stop_words", "molecules")


@_query(f"WITH {_C} SELECT expl_id, round(pr, 9) AS primes_ratio, round(mr, 9) AS molecules_ratio FROM l")
def tx_legality_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _scored_texts(spark, d).select("expl_id", F.round("primes_ratio", 9).alias("primes_ratio"), F.round("molecules_ratio", 9).alias("molecules_ratio"))


@_query(f"WITH {_C} SELECT expl_id, len(list_distinct(mol)) AS unique_molecules FROM l")
def tx_unique_molecules(spark: SparkSession, d: str) -> DataFrame:
    return _scored_texts(spark, d).select("expl_id", "unique_molecules")


@_query(f"WITH {_C} SELECT expl_id, circ AS uses_original_word FROM l")
def tx_circularity_exact(spark: SparkSession, d: str) -> DataFrame:
    return _scored_texts(spark, d).select("expl_id", "uses_original_word")


_STEM = "LEFT JOIN f {a} ON ends_with(f.form, '{s}') AND len({a}.form) >= 3 AND {a}.form = left(f.form, len(f.form) - {n})"
_LEMMAS = (
    "f AS (SELECT DISTINCT unnest(list_concat(toks, tt)) AS form FROM k), lem AS (SELECT f.form, coalesce(f1.form, f2.form, f3.form, f4.form, f.form) AS lemma FROM f "
    + " ".join(_STEM.format(a=f"f{i}", s=x, n=len(x)) for i, x in enumerate(lemmas.SUFFIXES, 1))
    + ")"
)


@_query(
    f"WITH {_K}, {_LEMMAS}, h AS (SELECT DISTINCT expl_id FROM (SELECT expl_id, tt[1] AS w, unnest(list_distinct(toks)) AS t FROM k WHERE len(tt) > 0) x JOIN lem a ON a.form = x.w JOIN lem b ON b.form = x.t WHERE a.lemma = b.lemma) "
    "SELECT k.expl_id, CASE WHEN target_word IS NULL OR len(tt) = 0 THEN NULL ELSE h.expl_id IS NOT NULL END AS uses_original_word FROM k LEFT JOIN h ON h.expl_id = k.expl_id"
)
def tx_circularity_lemma(spark: SparkSession, d: str) -> DataFrame:
    """By a table of all forms of the texts and targets that are another with a suffix."""
    rows = _explications(spark, d, X.tokens(F.col("text")).alias("toks"), X.tokens(F.col("target_word")).alias("target"))
    forms = rows.select(F.explode(F.concat("toks", "target")).alias("form")).distinct()
    return lemmas.circular(rows, lemmas.lemma_table(forms))


@_query("SELECT word, upper(substr(word, 1, 1)) || lower(substr(word, 2)) AS capitalised FROM nsm_dataset WHERE word IS NOT NULL GROUP BY word")
def tx_capitalise(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "nsm_dataset").where("word IS NOT NULL").select("word").distinct().select("word", X.capitalise(F.col("word")).alias("capitalised"))


@_query(f"SELECT row_id, {_strip('explication')} AS stripped FROM (WITH {_R} SELECT * FROM r) WHERE explication IS NOT NULL")
def tx_strip(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("explication IS NOT NULL").select("row_id", X.strip(F.col("explication")).alias("stripped"))


@_query(
    "SELECT model, CASE WHEN contains(lower(model), 'gpt') THEN 'gpt' WHEN contains(lower(model), 'gemini') THEN 'gemini' WHEN contains(lower(model), 'llama') THEN 'llama' "
    "WHEN contains(lower(model), 'mistral') THEN 'mistral' WHEN contains(lower(model), 'demo') THEN 'demo' END AS route FROM explications GROUP BY model"
)
def tx_dispatch_route(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "explications").select("model").distinct().select("model", X.route(F.col("model")).alias("route"))


@_query("SELECT unnest([" + ", ".join(f"'{w}'" for w in L.ENGLISH_STOP_WORDS) + f"]) AS word EXCEPT SELECT unnest({_LIST}) AS word")
def so_stopwords_minus_primes(spark: SparkSession, d: str) -> DataFrame:
    lists = spark.range(1).select(F.array(*map(F.lit, L.ENGLISH_STOP_WORDS)).alias("s"), F.array(*map(F.lit, L.PRIMES)).alias("p"))
    return lists.select(F.explode(F.array_except("s", "p")).alias("word"))


@_query(
    f"WITH {_K}, t AS (SELECT model, unnest(toks) AS t FROM k) SELECT model, count(*) FILTER (list_contains({_LIST}, t)) AS in_primes, "
    f"count(*) FILTER (NOT list_contains({_LIST}, t)) AS outside FROM t GROUP BY model"
)
def jn_lexicon_membership(spark: SparkSession, d: str) -> DataFrame:
    """Tokens joined with the lexicon as a table; tokens are counted per model before the join, so little is shuffled."""
    words = _explications(spark, d, F.explode(X.tokens(F.col("text"))).alias("t")).groupBy("model", "t").agg(F.count(F.lit(1)).alias("n"))
    lexicon = spark.range(1).select(F.explode(F.array(*map(F.lit, L.PRIMES))).alias("t"), F.lit(True).alias("prime"))
    hit = F.col("prime").isNotNull()
    joined = words.join(F.broadcast(lexicon), "t", "left")  # a fixed list
    return joined.groupBy("model").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("in_primes"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("outside"))


@_query(
    f"WITH {_C} SELECT expl_id, CASE WHEN pr >= 0.6 THEN 'good' WHEN pr >= 0.4 THEN 'fair' ELSE 'poor' END AS primes_band, CASE WHEN mr <= 0.2 THEN 'good' WHEN mr <= 0.4 THEN 'fair' ELSE 'poor' END AS molecules_band, "
    "CASE WHEN CASE WHEN len_ > 0 THEN stop_words / len_ ELSE 0 END <= 0.3 THEN 'good' WHEN CASE WHEN len_ > 0 THEN stop_words / len_ ELSE 0 END <= 0.5 THEN 'fair' ELSE 'poor' END AS stop_words_band, "
    "CASE WHEN coalesce(circ, false) THEN 'yes' ELSE 'no' END AS circularity FROM l"
)
def bd_report_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored_texts(spark, d)
    made = X.bands({c: F.col(c) for c in ("primes_ratio", "molecules_ratio", "stop_words", "length")}, F.col("uses_original_word"))
    return rows.select("expl_id", *[c.alias(n) for n, c in made.items()])


# ---- truncation and filters (TR, FL)


@_query(
    f"WITH {_E}, x AS (SELECT expl_id, string_split({_strip('coalesce(text, chr(32))')}, chr(10)) AS l FROM e) "
    "SELECT expl_id, r::INT AS r, array_to_string(l[1:len(l) - r], chr(10)) AS text FROM x, LATERAL (SELECT unnest(range(1, least(len(l), 2) + 1)) AS r)"
)
def tr_explication_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _explications(spark, d, F.explode(T.explication_variants(F.col("text"))).alias("v")).select("expl_id", "v.r", "v.text")


@_query(
    f"WITH x AS (SELECT entry_id, passage_id, list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda s: {_strip('s')}), lambda s: s <> '') AS ss FROM passages), "
    "y AS (SELECT *, list_filter(range(1, len(ss) + 1), lambda i: NOT contains(ss[i], '<UNK>')) AS pl FROM x) "
    "SELECT entry_id, passage_id, r::INT AS r, array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda i: NOT list_contains(pl[1:r], i)), lambda i: ss[i]), '. ') AS text "
    "FROM y, LATERAL (SELECT unnest(range(1, least(len(pl), 2) + 1)) AS r)"
)
def tr_passage_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "passages").select("entry_id", "passage_id", F.explode(T.passage_variants(F.col("text"))).alias("v"))
    return rows.select("entry_id", "passage_id", "v.r", "v.text")


@_query("SELECT entry_id, passage_id, text FROM passages WHERE contains(text, '<UNK>')")
def fl_scorable_passages(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "passages").where(T.scorable(F.col("text"))).select("entry_id", "passage_id", "text")


@_query("SELECT e.entry_id, coalesce(n, 0) AS scorable FROM entries e LEFT JOIN (SELECT entry_id, count(*) AS n FROM passages WHERE contains(text, '<UNK>') GROUP BY entry_id) p USING (entry_id) WHERE len(ambig_examples) > 0")
def fl_entries_with_passages(spark: SparkSession, d: str) -> DataFrame:
    scorable = readers.table(spark, d, "passages").where(T.scorable(F.col("text"))).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    kept = readers.table(spark, d, "entries").where(F.size("ambig_examples") > 0)
    return kept.join(scorable, "entry_id", "left").select("entry_id", F.coalesce("n", F.lit(0)).alias("scorable"))


# ---- prompts (PR, IO9, IO10)


def _entry_messages(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = readers.table(spark, d, "entries").crossJoin(F.broadcast(_bank(spark, d)))  # one row of five pairs
    msgs = prompts.messages(F.lit(DEFAULT.explain_system), prompts.explication_user(F.col("word"), F.col("examples")), F.col("bank"), mode)
    return rows.select("entry_id", msgs.alias("m")).select("entry_id", *_flat(F.col("m")))


_SHOTS = "list_transform(bank, lambda p: p.u || chr(10) || '--' || chr(10) || p.a)"
_SEP = "chr(10) || '--' || chr(10)"


@_query(
    f"WITH {_BANK} SELECT entry_id, 2 + 2 * len(bank) AS n, 'system,' || repeat('user,assistant,', len(bank)) || 'user' AS roles, "
    f"{_q(DEFAULT.explain_system)} || {_SEP} || array_to_string({_SHOTS}, {_SEP}) || {_SEP} || {_USER} AS content FROM entries, bank"
)
def pr_messages_native(spark: SparkSession, d: str) -> DataFrame:
    return _entry_messages(spark, d, "native")


@_query(
    f"WITH {_BANK} SELECT entry_id, 3 + 2 * len(bank) AS n, 'user,assistant,' || repeat('user,assistant,', len(bank)) || 'user' AS roles, "
    f"'<SYS>' || {_q(DEFAULT.explain_system)} || '</SYS>' || {_SEP} || 'Understood.' || {_SEP} || array_to_string({_SHOTS}, {_SEP}) || {_SEP} || {_USER} AS content FROM entries, bank"
)
def pr_messages_emulated(spark: SparkSession, d: str) -> DataFrame:
    return _entry_messages(spark, d, "emulated")


@_query(
    f"WITH {_BANK} SELECT entry_id, 1::BIGINT AS n, 'user' AS roles, '<SYS>' || {_q(DEFAULT.explain_system)} || '</SYS>' || chr(10) || "
    f"array_to_string(list_transform(bank, lambda p: '<USER>' || p.u || '</USER>' || chr(10) || '<ASSISTANT>' || p.a || '</ASSISTANT>' || chr(10)), '') || '<USER>' || {_USER} || '</USER>' AS content FROM entries, bank"
)
def pr_messages_inline(spark: SparkSession, d: str) -> DataFrame:
    return _entry_messages(spark, d, "inline")


@_query(f"WITH {_BANK} SELECT n::INT AS most, len(bank[1:n])::BIGINT AS pairs, array_to_string(list_transform(bank[1:n], lambda p: p.u), '|') AS users FROM bank, (VALUES (0), (2), (5)) AS t(n)")
def pr_few_shot_limit(spark: SparkSession, d: str) -> DataFrame:
    cuts = F.explode(F.array(*[F.struct(F.lit(n).alias("most"), prompts.first_pairs(F.col("bank"), n).alias("b")) for n in (0, 2, 5)]))
    return _bank(spark, d).select(cuts.alias("c")).select("c.most", F.size("c.b").cast("long").alias("pairs"), F.array_join(F.transform("c.b", lambda p: p["user"]), "|").alias("users"))


@_query(f"SELECT entry_id, {_USER} AS prompt FROM entries")
def pr_explication(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "entries").select("entry_id", prompts.explication_user(F.col("word"), F.col("examples")).alias("prompt"))


@_query(
    f"SELECT p.entry_id, passage_id, CASE WHEN def IS NULL THEN {_q(DEFAULT.recover_system)} ELSE {_q(DEFAULT.recover_with_system)} END AS system, "
    "CASE WHEN def IS NULL THEN 'Passage: ' || coalesce(text, '') ELSE 'Description: ' || def || chr(10) || 'Passage: ' || coalesce(text, '') END AS prompt FROM passages p JOIN entries e ON p.entry_id = e.entry_id"
)
def pr_recovery(spark: SparkSession, d: str) -> DataFrame:
    joined = readers.table(spark, d, "passages").join(readers.table(spark, d, "entries").select("entry_id", "def"), "entry_id")
    system, user = prompts.recovery(F.col("text"), F.col("def"))
    return joined.select("entry_id", "passage_id", system.alias("system"), user.alias("prompt"))


_BASE = "'Paraphrase the word below.' || chr(10) || 'Word: ' || coalesce(word, '') || chr(10) || 'Examples:' || chr(10) || coalesce(array_to_string(examples, chr(10)), '') || chr(10) || 'Paraphrase:'"


@_query(f"SELECT entry_id, '    ' || replace({_BASE}, chr(10), chr(10) || '    ') AS batch, {_BASE} AS plain, {_BASE} || chr(10) AS newline FROM entries")
def pr_base_variants(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "entries").select("entry_id", *[prompts.base_prompt(F.col("word"), F.col("examples"), v).alias(v) for v in ("batch", "plain", "newline")])


@_query(
    f"WITH {_R} SELECT row_id, '<|system|>' || chr(10) || {_q(DEFAULT.explain_system)} || chr(10) || '<|user|>' || chr(10) || {_USER} || chr(10) || '<|assistant|>' || chr(10) || coalesce(explication, '') || '<|end|>' AS text FROM r WHERE split = 'train'"
)
def pr_sft_format(spark: SparkSession, d: str) -> DataFrame:
    return readers.split(_records(spark, d, "train"), "train").select("row_id", prompts.training_text(F.col("word"), F.col("examples"), F.col("explication")).alias("text"))


@_query("SELECT grader, contains(lower(grader), 'gemma') AS any_case, contains(grader, 'gemma') AS exact_case FROM predictions WHERE grader IS NOT NULL GROUP BY grader")
def pr_system_flag(spark: SparkSession, d: str) -> DataFrame:
    names = readers.table(spark, d, "predictions").where("grader IS NOT NULL").select("grader").distinct()
    return names.select("grader", prompts.emulates_system(F.col("grader")).alias("any_case"), prompts.emulates_system(F.col("grader"), ignore_case=False).alias("exact_case"))


@_query(
    f"SELECT entry_id, to_json({{'custom_id': 'entry-' || entry_id, 'method': 'POST', 'url': '/v1/chat/completions', 'body': {{'model': 'stub-gpt', 'messages': [{{'role': 'system', 'content': {_q(DEFAULT.explain_system)}}}, {{'role': 'user', 'content': {_USER}}}]}}}})::VARCHAR AS line FROM entries"
)
def io_jsonl_chat_a(spark: SparkSession, d: str) -> DataFrame:
    msgs = prompts.messages(F.lit(DEFAULT.explain_system), prompts.explication_user(F.col("word"), F.col("examples")))
    key = F.concat(F.lit("entry-"), F.col("entry_id").cast("string"))
    return readers.table(spark, d, "entries").select("entry_id", prompts.chat_line(key, F.lit("stub-gpt"), msgs).alias("line"))


@_query(
    f"SELECT entry_id, to_json({{'id': 'entry-' || entry_id, 'request': {{'contents': [{{'role': 'user', 'parts': [{{'text': {_USER}}}]}}], 'system_instruction': {{'parts': [{{'text': {_q(DEFAULT.explain_system)}}}]}}, 'generationConfig': {{'response_mime_type': 'text/plain'}}}}}})::VARCHAR AS line FROM entries"
)
def io_jsonl_chat_b(spark: SparkSession, d: str) -> DataFrame:
    msgs = prompts.messages(F.lit(DEFAULT.explain_system), prompts.explication_user(F.col("word"), F.col("examples")))
    key = F.concat(F.lit("entry-"), F.col("entry_id").cast("string"))
    return readers.table(spark, d, "entries").select("entry_id", prompts.parts_line(key, msgs).alias("line"))


@_query(
    f"SELECT entry_id, to_json({{'id': 'entry-' || entry_id, 'request': {{'contents': [{{'role': 'user', 'parts': [{{'text': '<SYS>' || {_q(DEFAULT.explain_system)} || '</SYS>'}}]}}, "
    f"{{'role': 'model', 'parts': [{{'text': 'Understood.'}}]}}, {{'role': 'user', 'parts': [{{'text': {_USER}}}]}}]}}}})::VARCHAR AS line FROM entries"
)
def io_jsonl_chat_b_emulated(spark: SparkSession, d: str) -> DataFrame:
    """Without a system text there is neither its object nor a configuration."""
    msgs = prompts.messages(F.lit(DEFAULT.explain_system), prompts.explication_user(F.col("word"), F.col("examples")), mode="emulated")
    key = F.concat(F.lit("entry-"), F.col("entry_id").cast("string"))
    return readers.table(spark, d, "entries").select("entry_id", prompts.parts_line(key, msgs).alias("line"))


# ---- fan-out (FO1, JN1, JN3)

_V = (
    f"{_E}, ps AS (SELECT entry_id, passage_id, text FROM passages WHERE contains(text, '<UNK>')), "
    f"tv AS (SELECT expl_id, entry_id, model, coalesce(text, '') AS ft, string_split({_strip('coalesce(text, chr(32))')}, chr(10)) AS l FROM e WHERE entry_id IS NOT NULL), "
    f"pv AS (SELECT *, list_filter(list_transform(string_split(text, '.'), lambda s: {_strip('s')}), lambda s: s <> '') AS ss FROM ps), "
    "pw AS (SELECT *, list_filter(range(1, len(ss) + 1), lambda i: NOT contains(ss[i], '<UNK>')) AS pl FROM pv), "
    "f AS (SELECT entry_id, passage_id, NULL AS expl_id, NULL AS model, -1 AS slot, text AS passage, NULL AS explication FROM ps "
    "UNION ALL SELECT entry_id, passage_id, expl_id, model, 0, text, ft FROM tv JOIN ps USING (entry_id) "
    "UNION ALL SELECT entry_id, passage_id, expl_id, model, r, text, array_to_string(l[1:len(l) - r], chr(10)) FROM (SELECT *, unnest(range(1, least(len(l), 2) + 1)) AS r FROM tv) JOIN ps USING (entry_id) "
    "UNION ALL SELECT entry_id, passage_id, expl_id, model, r + 2, array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda i: NOT list_contains(pl[1:r], i)), lambda i: ss[i]), '. '), ft "
    "FROM tv JOIN (SELECT *, unnest(range(1, least(len(pl), 2) + 1)) AS r FROM pw) USING (entry_id))"
)


def _conditions(spark: SparkSession, d: str) -> DataFrame:
    return fanout.conditions(_explications(spark, d, "text"), readers.table(spark, d, "passages"))


@_query(f"WITH {_V} SELECT slot::INT AS slot, model, count(*) AS prompts FROM f GROUP BY slot, model")
def fo_fanout_counts(spark: SparkSession, d: str) -> DataFrame:
    return _conditions(spark, d).groupBy("slot", "model").agg(F.count(F.lit(1)).alias("prompts"))


@_query(
    f"WITH {_V} SELECT entry_id, passage_id, expl_id, slot::INT AS slot, CASE WHEN explication IS NULL THEN 'Passage: ' || passage ELSE 'Description: ' || explication || chr(10) || 'Passage: ' || passage END AS prompt FROM f"
)
def fo_fanout_prompts(spark: SparkSession, d: str) -> DataFrame:
    _, user = prompts.recovery(F.col("passage"), F.col("explication"))
    return _conditions(spark, d).select("entry_id", "passage_id", "expl_id", "slot", user.alias("prompt"))


_SYSTEM = f"CASE WHEN explication IS NULL THEN {_q(DEFAULT.recover_system)} ELSE {_q(DEFAULT.recover_with_system)} END"
_ASKED = "CASE WHEN explication IS NULL THEN 'Passage: ' || passage ELSE 'Description: ' || explication || chr(10) || 'Passage: ' || passage END"


@_query(
    f"WITH {_V}, g AS (SELECT DISTINCT grader FROM predictions WHERE grader IS NOT NULL), x AS (SELECT grader, f.*, contains(CASE WHEN slot = -1 THEN grader ELSE lower(grader) END, 'gemma') AS em, "
    f"{_SYSTEM} AS sys, {_ASKED} AS usr FROM f, g) SELECT grader, entry_id, passage_id, expl_id, slot::INT AS slot, CASE WHEN em THEN 3 ELSE 2 END::BIGINT AS n, CASE WHEN em THEN 'user,assistant,user' ELSE 'system,user' END AS roles, "
    f"CASE WHEN em THEN '<SYS>' || sys || '</SYS>' || {_SEP} || 'Understood.' ELSE sys END || {_SEP} || usr AS content FROM x"
)
def fo_grader_messages(spark: SparkSession, d: str) -> DataFrame:
    """The conditions as each grader gets them, its system instruction native or emulated by its name."""
    system, user = prompts.recovery(F.col("passage"), F.col("explication"))
    graders = readers.table(spark, d, "predictions").where("grader IS NOT NULL").select("grader").distinct()
    rows = _conditions(spark, d).crossJoin(F.broadcast(graders))  # a run's graders: a handful of names
    msgs = prompts.messages(system, user, mode=prompts.grader_mode(F.col("grader"), F.col("slot")))
    return rows.select("grader", "entry_id", "passage_id", "expl_id", "slot", msgs.alias("m")).select("grader", "entry_id", "passage_id", "expl_id", "slot", *_flat(F.col("m")))


# ---- model-backed steps (ML)


@_query("SELECT 'wordnet_definitions' AS model, entry_id, def AS text FROM entries")
def ml_definition_baseline(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "entries").select(F.lit("wordnet_definitions").alias("model"), "entry_id", F.col("def").alias("text"))


@_query("SELECT lower(trim(model)) AS model, min(model_ord) AS model_ord, max(expl_id) AS last_expl_id, arg_max(run_id, expl_id) AS last_run FROM explications WHERE expl_id IS NOT NULL GROUP BY 1")
def ml_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "explications").where("expl_id IS NOT NULL")
    return rows.groupBy(scoring.model_key().alias("model")).agg(F.min("model_ord").alias("model_ord"), F.max("expl_id").alias("last_expl_id"), F.max_by("run_id", "expl_id").alias("last_run"))


_Z = "z AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_LP = "x[{a} + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))))"


@_query(f"WITH {_Z} SELECT vec_id, round({_LP.format(a='label')}, 9) AS answer_logprob FROM z")
def ml_logprob(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "embeddings").select("vec_id", F.round(G.log_prob(F.col("embedding"), F.col("label")), 9).alias("answer_logprob"))


@_query(f"WITH {_Z} SELECT vec_id, 1 + len(list_filter(x, lambda v: v > x[label + 1])) AS answer_rank FROM z")
def ml_rank(spark: SparkSession, d: str) -> DataFrame:
    return readers.table(spark, d, "embeddings").select("vec_id", G.rank(F.col("embedding"), F.col("label")).alias("answer_rank"))


@_query(f"WITH {_Z} SELECT vec_id, CASE WHEN {_LP.format(a='label')} >= {_LP.format(a='((label + 1) % 10)')} THEN 'lower' ELSE 'capital' END AS form FROM z")
def ml_case_choice(spark: SparkSession, d: str) -> DataFrame:
    lower, capital = (G.log_prob(F.col("embedding"), a) for a in (F.col("label"), (F.col("label") + 1) % 10))
    return readers.table(spark, d, "embeddings").select("vec_id", G.choose_case(lower, capital).alias("form"))


@_query(f"WITH {_Z} SELECT vec_id, list_position(x, list_max(x))::BIGINT - 1 AS best, list_position(x, list_max(x)) - 1 = label AS is_match FROM z")
def ml_argmax_match(spark: SparkSession, d: str) -> DataFrame:
    best = G.argmax(F.col("embedding"))
    return readers.table(spark, d, "embeddings").select("vec_id", best.alias("best"), (best == F.col("label")).alias("is_match"))


_STEPS = (
    f"{_Z}, y AS (SELECT vec_id // 3 AS word_id, vec_id, {_LP.format(a='label')} AS lo, {_LP.format(a='((label + 1) % 10)')} AS hi, 1 + len(list_filter(x, lambda v: v > x[label + 1])) AS rl, "
    "1 + len(list_filter(x, lambda v: v > x[(label + 1) % 10 + 1])) AS rh, list_position(x, list_max(x)) - 1 = label AS ml, list_position(x, list_max(x)) - 1 = (label + 1) % 10 AS mh FROM z), "
    "g AS (SELECT word_id, sum(lo) AS lo, sum(hi) AS hi, string_agg(rl, ',' ORDER BY vec_id) AS rl, string_agg(rh, ',' ORDER BY vec_id) AS rh, bool_and(ml) AS ml, bool_and(mh) AS mh FROM y GROUP BY word_id)"
)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Words of up to three tokens: the logits of each step, and the tokens of their two forms."""
    rows = readers.table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 3)).alias("word_id"), F.struct("vec_id", "embedding", "label").alias("s"))
    listed = rows.groupBy("word_id").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)).alias("s"))
    pick = lambda f: F.transform("s", f)
    return listed.select("word_id", pick(lambda x: x["embedding"]).alias("steps"), pick(lambda x: x["label"].cast("int")).alias("lower"), pick(lambda x: ((x["label"] + 1) % 10).cast("int")).alias("capital"))


@_query(f"WITH {_STEPS} SELECT word_id, round(lo, 6) AS lower, round(hi, 6) AS capital, rl AS lower_ranks, rh AS capital_ranks FROM g")
def ml_word_logprob(spark: SparkSession, d: str) -> DataFrame:
    rows = _steps(spark, d)
    log_prob = [F.round(G.word_log_prob(F.col("steps"), F.col(c)), 6).alias(c) for c in ("lower", "capital")]
    ranks = [F.array_join(G.word_ranks(F.col("steps"), F.col(c)), ",").alias(f"{c}_ranks") for c in ("lower", "capital")]
    return rows.select("word_id", *log_prob, *ranks)


@_query(f"WITH {_STEPS} SELECT word_id, CASE WHEN lo >= hi THEN 'lower' ELSE 'capital' END AS form, round(greatest(lo, hi), 6) AS answer_logprob, CASE WHEN lo >= hi THEN rl ELSE rh END AS answer_ranks, CASE WHEN lo >= hi THEN ml ELSE mh END AS is_match FROM g")
def ml_graded_word(spark: SparkSession, d: str) -> DataFrame:
    graded = _steps(spark, d).select("word_id", G.graded_word(F.col("steps"), F.col("lower"), F.col("capital")).alias("g"))
    return graded.select("word_id", "g.form", F.round("g.answer_logprob", 6).alias("answer_logprob"), F.array_join("g.answer_ranks", ",").alias("answer_ranks"), "g.is_match")


@_query(f"SELECT grader, entry_id, passage_id, count(*) AS n FROM (SELECT p.*, {words_sql('p.prediction')} AS a, {words_sql('e.word')} AS b FROM predictions p JOIN entries e USING (entry_id)) WHERE a = b GROUP BY ALL")
def ml_exact_match(spark: SparkSession, d: str) -> DataFrame:
    joined = readers.table(spark, d, "predictions").join(readers.table(spark, d, "entries").select("entry_id", "word"), "entry_id")
    same = joined.where(G.same_tokens(X.tokens(F.col("prediction")), X.tokens(F.col("word"))))
    return same.groupBy("grader", "entry_id", "passage_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_Z} SELECT a.vec_id, round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 9) AS cosine FROM z a JOIN z b ON b.vec_id = a.vec_id + 1")
def ml_cosine_rowwise(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(G.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


def _bleu_sql(keys: str, source: str) -> str:
    """CTEs down to ``bl (keys, bleu)`` from a source of ``keys, h, r`` as token lists."""
    on = " AND ".join(f"w.{k} IS NOT DISTINCT FROM t.{k}" for k in keys.split(", "))
    mine = ", ".join(f"w.{k}" for k in keys.split(", "))
    gram = "SELECT {keys}, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, len({s}) - {n} + 2), lambda i: array_to_string({s}[i:i + {n} - 1], ' '))) AS g FROM w WHERE len({s}) >= {n}"
    return (
        f"w AS ({source}), grams AS ("
        + " UNION ALL ".join(gram.format(keys=keys, n=n, s=s) for s in "hr" for n in range(1, 5))
        + f"), gc AS (SELECT {keys}, n, g, count(*) FILTER (side = 'h') AS ch, count(*) FILTER (side = 'r') AS cr FROM grams GROUP BY ALL), "
        f"t AS (SELECT {keys}, " + ", ".join(f"sum(least(ch, cr)) FILTER (n = {n}) AS c{n}" for n in range(1, 5)) + f" FROM gc GROUP BY {keys}), "
        f"u AS (SELECT {mine}, len(h) AS hl, len(r) AS rl, " + ", ".join(f"coalesce(c{n}, 0) AS c{n}, greatest(len(h) - {n - 1}, 0) AS t{n}" for n in range(1, 5)) + f" FROM w LEFT JOIN t ON {on}), "
        "miss AS (SELECT *, " + ", ".join(" + ".join(f"(t{j} > 0 AND c{j} = 0)::INT" for j in range(1, n + 1)) + f" AS m{n}" for n in range(1, 5)) + " FROM u), "
        f"bl AS (SELECT {keys}, CASE WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0 ELSE 100 * CASE WHEN hl < rl THEN exp(1 - rl / nullif(hl, 0)) ELSE 1 END * exp(("
        + " + ".join(f"CASE WHEN t{n} = 0 THEN 0 WHEN c{n} > 0 THEN ln(c{n} / t{n}) ELSE ln(1 / (pow(2, m{n}) * t{n})) END" for n in range(1, 5))
        + ") / nullif((t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT + (t4 > 0)::INT, 0)) END AS bleu FROM miss)"
    )


@_query("WITH " + _E + ", " + _bleu_sql("expl_id", f"SELECT expl_id, {words_sql('text')} AS h, {words_sql('def')} AS r FROM e JOIN entries USING (entry_id)") + " SELECT expl_id, round(bleu, 6) AS bleu FROM bl")
def ml_bleu(spark: SparkSession, d: str) -> DataFrame:
    pairs = _explications(spark, d, "text").join(readers.table(spark, d, "entries").select("entry_id", "def"), "entry_id")
    return sentence_bleu(pairs, "text", "def").select("expl_id", F.round("bleu", 6).alias("bleu"))


@_query(f"WITH {_E}, v AS (SELECT model, (i - 1)::INT AS lang_ord, bleu_scores[i] AS v FROM e, range(1, 9) AS t(i) WHERE i <= len(bleu_scores)) SELECT model, lang_ord, count(v) AS n, round(avg(v), 6) AS avg_bleu FROM v GROUP BY ALL")
def ml_lang_arrays(spark: SparkSession, d: str) -> DataFrame:
    long = _explications(spark, d, F.posexplode("bleu_scores").alias("lang_ord", "v"))
    return long.groupBy("model", "lang_ord").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("avg_bleu"))


LANGUAGES = tuple(plugins.FAKE_LOSSES)
_LANGS = "(VALUES " + ", ".join(f"({i}, '{lang}', {_q(a)}, {_q(b)})" for i, (lang, (a, b)) in enumerate(plugins.FAKE_LOSSES.items())) + ") AS lg(lang_ord, lang, a, b)"
_TR = f"{_E}, tr AS (SELECT expl_id, model, coalesce(text, '') AS text, lang_ord::INT AS lang_ord, lang, replace(coalesce(text, ''), a, b) AS back FROM e, {_LANGS})"
_COUNTS = "[" + ", ".join(f"(len({{c}}) - len(replace({{c}}, '{x}', '')))::DOUBLE" for x in "aeiostnr") + "]"
_DOT = "list_dot_product({a}, {b})"
_TS = (
    f"{_TR}, {_bleu_sql('expl_id, lang_ord', f'SELECT expl_id, lang_ord, {words_sql("back")} AS h, {words_sql("text")} AS r FROM tr')}, "
    f"em AS (SELECT *, {_COUNTS.format(c='text')} AS va, {_COUNTS.format(c='back')} AS vb FROM tr), "
    f"ts AS (SELECT em.expl_id, model, em.lang_ord, lang, bleu, coalesce({_DOT.format(a='va', b='vb')} / nullif(sqrt({_DOT.format(a='va', b='va')}) * sqrt({_DOT.format(a='vb', b='vb')}), 0), 0) AS embed, "
    "1.0 - abs(len(back) - len(text)) / greatest(len(back), len(text), 1) AS metric FROM em JOIN bl ON bl.expl_id = em.expl_id AND bl.lang_ord = em.lang_ord)"
)


def _back(spark: SparkSession, d: str) -> DataFrame:
    return R.round_trip(_explications(spark, d, "text"), LANGUAGES, plugins.fake_translator, 512)


def _translated(spark: SparkSession, d: str) -> DataFrame:
    """All explications in all languages and back, through stand-ins, scored: no model's result."""
    return R.scores(_back(spark, d), plugins.fake_embedder, plugins.fake_metric, 512)


@_query(f"WITH {_TR} SELECT expl_id, lang, back FROM tr")
def ml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through a stand-in that loses something else in each language."""
    return _back(spark, d).select("expl_id", "lang", "back")


@_query(f"WITH {_TS} SELECT expl_id, lang, round(bleu, 6) AS bleu, round(embed, 6) AS embed, round(metric, 6) AS metric FROM ts")
def ml_translation_scores(spark: SparkSession, d: str) -> DataFrame:
    return _translated(spark, d).select("expl_id", "lang", *[F.round(c, 6).alias(c) for c in R.METRICS])


@_query(f"WITH {_TS} SELECT model, lang_ord, lang, round(avg(bleu), 6) AS avg_bleu, round(avg(embed), 6) AS avg_embed, round(avg(metric), 6) AS avg_metric FROM ts GROUP BY ALL")
def ag_translation_means(spark: SparkSession, d: str) -> DataFrame:
    return R.means(_translated(spark, d)).select("model", "lang_ord", "lang", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in R.METRICS])


@_query(f"WITH {_TS} SELECT expl_id, string_agg(printf('%.9f', bleu), ' ' ORDER BY lang_ord) AS bleu_scores, string_agg(printf('%.9f', embed), ' ' ORDER BY lang_ord) AS embed_scores, string_agg(printf('%.9f', metric), ' ' ORDER BY lang_ord) AS comet_scores FROM ts GROUP BY expl_id")
def ml_translation_arrays(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.9f", v)), " ").alias(c)
    return R.arrays(_translated(spark, d)).select("expl_id", *[shown(c) for c in ("bleu_scores", "embed_scores", "comet_scores")])


_POSITIONS = f"(VALUES {', '.join(f'({p})' for p in D.POSITIONS)}) AS ps(p)"
_DEVIATIONS = f"dv AS (SELECT model, 'bleu' AS metric, lang_ord AS position, stddev_pop(bleu) AS std FROM ts JOIN {_POSITIONS} ON p = lang_ord GROUP BY ALL UNION ALL SELECT model, 'embed', lang_ord, stddev_pop(embed) FROM ts JOIN {_POSITIONS} ON p = lang_ord GROUP BY ALL)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    scored = _translated(spark, d)
    arrays = R.arrays(scored.withColumn("k", F.struct("expl_id", "model")), "k").select("k.model", "bleu_scores", "embed_scores")
    return D.position_deviations(arrays, "model", {"bleu": "bleu_scores", "embed": "embed_scores"})


@_query(f"WITH {_TS}, {_DEVIATIONS} SELECT model, metric, position, round(std, 6) AS std, round(std / 149, 8) AS bar FROM dv")
def ag_position_deviations(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d).select("model", "metric", "position", F.round("std", 6).alias("std"), F.round("bar", 8).alias("bar"))


@_query(f"WITH {_TS}, mn AS (SELECT model, lang, avg(bleu) AS b, avg(embed) AS e, avg(metric) AS m FROM ts GROUP BY ALL) SELECT printf('[%s] %s: BLEU %.2f, embedding %.2f, metric %.2f', lang, model, round(b, 2), round(e, 2), round(m, 2)) AS line FROM mn")
def io_language_report(spark: SparkSession, d: str) -> DataFrame:
    averages = R.means(_translated(spark, d)).withColumns({f"avg_{c}": F.round(f"avg_{c}", 2) for c in R.METRICS})
    return averages.select(sinks.language_report().alias("line"))


_ANSWER = "'this is something like ' || coalesce(nullif(regexp_extract(prompt, '(\\S+)\\s*$', 1), ''), 'this')"


@_query(f"WITH q AS (SELECT entry_id, {_USER} AS prompt FROM entries) SELECT entry_id, {_ANSWER} AS text FROM q")
def plugin_generate_fake(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in generator over whole prompts, in batches of like length; no model's result."""
    rows = readers.table(spark, d, "entries").select("entry_id", prompts.explication_user(F.col("word"), F.col("examples")).alias("prompt"))
    batched = by_length(rows, F.length("prompt"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return plugins.generate(batched, plugins.fake_generator, 256).select("entry_id", "text")


@_query(f"WITH q AS (SELECT entry_id, {_USER} AS prompt FROM entries) SELECT entry_id, array_to_string(string_split({_ANSWER}, ' ')[1:3], ' ') AS text FROM q")
def plugin_generate_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The same, decoded without sampling and cut after three tokens."""
    rows = readers.table(spark, d, "entries").select("entry_id", prompts.explication_user(F.col("word"), F.col("examples")).alias("prompt"))
    return plugins.generate(rows, plugins.fake_generator, 256, replace(plugins.GREEDY, max_new_tokens=3)).select("entry_id", "text")


@_query(
    f"WITH {_V}, y AS (SELECT f.*, ((len({_ASKED}) * 31 + coalesce(len(word), 0)) % 997) / 997 AS v FROM f JOIN entries USING (entry_id)) "
    "SELECT entry_id, passage_id, expl_id, slot::INT AS slot, round(ln(v + 1e-6), 9) AS answer_logprob, v > 0.5 AS is_match FROM y"
)
def plugin_grade_fake(spark: SparkSession, d: str) -> DataFrame:
    """All conditions through a stand-in grader; no model's result."""
    _, user = prompts.recovery(F.col("passage"), F.col("explication"))
    words = readers.table(spark, d, "entries").select("entry_id", "word")
    rows = _conditions(spark, d).select("entry_id", "passage_id", "expl_id", "slot", user.alias("prompt")).join(words, "entry_id")
    return plugins.grade(rows, plugins.fake_grader, 256).select("entry_id", "passage_id", "expl_id", "slot", F.round("answer_logprob", 9).alias("answer_logprob"), "is_match")


# ---- scores (AG, JN2, JN4)


@_query(f"WITH {_S} SELECT grader, entry_id, model, round(ad, 6) AS avg_delta_log, round(am, 6) AS avg_min_delta_log, round(ae, 6) AS avg_ent_delta_log FROM a")
def ag_deltas(spark: SparkSession, d: str) -> DataFrame:
    cols = ("avg_delta_log", "avg_min_delta_log", "avg_ent_delta_log")
    return scoring.sub_scores(readers.table(spark, d, "predictions")).select("grader", "entry_id", "model", *[F.round(c, 6).alias(c) for c in cols])


@_query(f"WITH {_S} SELECT grader, entry_id, model, round(adj, 6) AS adj_score FROM a")
def ag_adj_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.sub_scores(readers.table(spark, d, "predictions")).select("grader", "entry_id", "model", F.round("adj_score", 6).alias("adj_score"))


@_query(f"WITH {_S} SELECT grader, entry_id, model, tm AS total_match FROM a")
def ag_total_match(spark: SparkSession, d: str) -> DataFrame:
    return scoring.sub_scores(readers.table(spark, d, "predictions")).select("grader", "entry_id", "model", "total_match")


@_query(f"WITH {_X} SELECT expl_id, round(ad, 6) AS avg_delta, round(am, 6) AS avg_delta_min, round(ae, 6) AS avg_delta_ent, round(se, 6) AS score_exp FROM x")
def ag_explication_avg(spark: SparkSession, d: str) -> DataFrame:
    return _final_scores(spark, d).select("expl_id", *[F.round(c, 6).alias(c) for c in ("avg_delta", "avg_delta_min", "avg_delta_ent", "score_exp")])


@_query(f"WITH {_X} SELECT expl_id, round(ts, 6) AS total_score FROM x")
def ag_total_score(spark: SparkSession, d: str) -> DataFrame:
    return _final_scores(spark, d).select("expl_id", F.round("total_score", 6).alias("total_score"))


@_query(
    f"WITH {_X} SELECT model, count(*) AS num_examples, round(avg(ts), 9) AS avg_total_score, round(avg(se), 9) AS avg_score_exp, round(avg(pr), 9) AS avg_primes_ratio, round(avg(mr), 9) AS avg_molecules_ratio, "
    "round(avg(ad), 9) AS avg_delta, round(avg(am), 9) AS avg_delta_min, round(avg(ae), 9) AS avg_delta_ent, round(avg(len_), 9) AS avg_length, round(avg(primes), 9) AS avg_primes, "
    "round(avg(stop_words), 9) AS avg_stop_words, round(avg(molecules), 9) AS avg_molecules, round(avg(coalesce(circ, false)::INT), 9) AS avg_circularity FROM x GROUP BY model"
)
def ag_model_avg(spark: SparkSession, d: str) -> DataFrame:
    means = scoring.model_averages(_final_scores(spark, d))
    return means.select("model", "num_examples", *[F.round(c, 9).alias(c) for c in means.columns if c not in ("model", "num_examples")])


@_query(f"WITH {_X} SELECT model, printf('%s: total %.1f', model, round(avg(ts), 1)) AS line FROM x GROUP BY model")
def io_console_report(spark: SparkSession, d: str) -> DataFrame:
    means = scoring.model_averages(_final_scores(spark, d))
    return means.select("model", F.format_string("%s: total %.1f", F.col("model"), F.round("avg_total_score", 1)).alias("line"))


@_query(f"WITH {_E} SELECT model, i::INT AS lang_ord, round(avg(bleu_scores[i + 1]), 6) AS avg_bleu FROM e, range(0, 8) AS t(i) WHERE bleu_scores[i + 1] IS NOT NULL GROUP BY ALL")
def ag_corpus_metric_avg(spark: SparkSession, d: str) -> DataFrame:
    long = _explications(spark, d, F.posexplode("bleu_scores").alias("lang_ord", "v")).where("v IS NOT NULL")
    return long.groupBy("model", "lang_ord").agg(F.round(F.avg("v"), 6).alias("avg_bleu"))


_STD = ("total_score", "score_exp", "primes_ratio", "molecules_ratio", "legality")


def _deviations(spark: SparkSession, d: str) -> DataFrame:
    rows = _final_scores(spark, d).withColumn("legality", scoring.legality_alternative(F.col("primes_ratio"), F.col("molecules_ratio")))
    return D.deviations(rows, "model", _STD)


_SQLSTD = {"total_score": "ts", "score_exp": "se", "primes_ratio": "pr", "molecules_ratio": "mr", "legality": "10 * pr - mr"}


@_query(f"WITH {_X} SELECT model, " + ", ".join(f"round(stddev_pop({e}), 6) AS {c}_std" for c, e in _SQLSTD.items()) + " FROM x GROUP BY model")
def ag_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return _deviations(spark, d).select("model", *[F.round(f"{c}_std", 6).alias(f"{c}_std") for c in _STD])


@_query(f"WITH {_X} SELECT model, " + ", ".join(f"round(stddev_pop({e}) / 149, 8) AS {c}_bar" for c, e in _SQLSTD.items()) + " FROM x GROUP BY model")
def ag_error_bar(spark: SparkSession, d: str) -> DataFrame:
    return _deviations(spark, d).select("model", *[F.round(f"{c}_bar", 8).alias(f"{c}_bar") for c in _STD])


@_query(f"WITH {_C} SELECT expl_id, round(10 * pr - mr, 9) AS legality FROM l")
def ag_legality_alt(spark: SparkSession, d: str) -> DataFrame:
    return _scored_texts(spark, d).select("expl_id", F.round(scoring.legality_alternative(F.col("primes_ratio"), F.col("molecules_ratio")), 9).alias("legality"))


@_query(f"WITH {_E} SELECT model, i::INT AS position, round(stddev_pop(bleu_scores[i + 1]), 6) AS bleu_std FROM e, (VALUES (0), (1), (2), (3), (7)) AS t(i) WHERE i < len(bleu_scores) GROUP BY ALL")
def ag_position_picks(spark: SparkSession, d: str) -> DataFrame:
    picked = D.position_values(_explications(spark, d, "bleu_scores").select("model", "bleu_scores"), "bleu_scores")
    return picked.groupBy("model", "position").agg(F.round(F.stddev_pop("value"), 6).alias("bleu_std"))


@_query(
    f"WITH {_E}, o AS (SELECT model, entry_id, run_id, arg_min(bleu_scores, expl_id) AS b FROM e WHERE entry_id IS NOT NULL AND bleu_scores IS NOT NULL AND len(bleu_scores) = 8 GROUP BY ALL), "
    "j AS (SELECT m.model, m.entry_id, list_concat(list_concat(m.b[1:4], [0.0, 0.0, 0.0]), o.b[1:1]) AS s FROM o m JOIN o ON m.model = o.model AND m.entry_id = o.entry_id AND m.run_id = 'run_1' AND o.run_id = 'run_2') "
    "SELECT model, entry_id, (i - 1)::INT AS position, round(s[i], 6) AS value FROM j, range(1, 9) AS t(i) WHERE i <= len(s)"
)
def jn_run_splice(spark: SparkSession, d: str) -> DataFrame:
    rows = _explications(spark, d, "run_id", "bleu_scores").where("entry_id IS NOT NULL AND size(bleu_scores) = 8")
    one = rows.groupBy("model", "entry_id", "run_id").agg(F.min_by("bleu_scores", "expl_id").alias("b"))
    spliced = D.splice(one.where("run_id = 'run_1'"), one.where("run_id = 'run_2'"), ["model", "entry_id"], "b")
    return spliced.select("model", "entry_id", F.posexplode("b").alias("position", "value")).withColumn("value", F.round("value", 6))


# ---- serialisation (JS)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Explications with all fields of a result file; a model's scores by grader are nested in each of its explications."""
    details = scoring.score_details(readers.table(spark, d, "predictions"))
    each = F.struct(*[F.col(c) for c in ("grader", "model", "adj_score", "avg_delta_log", "avg_min_delta_log", "avg_ent_delta_log", "total_match", "baselines", "exp_baselines", "minimality", "entailments")])
    nested = details.groupBy("entry_id", "model").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x.dropFields("grader")).alias("sub_scores"))
    none = {c: F.lit(None).cast("array<double>") for c in ("comet_scores", "embed_scores")}
    return _final_scores(spark, d, "bleu_scores").join(nested, ["entry_id", "model"], "left").withColumns(none)


_BACK = ("text", "target_word", "uses_original_word", "length", "primes", "stop_words", "molecules", "unique_molecules")
_ROUNDED = {"total_score": "ts", "score_exp": "se", "primes_ratio": "pr", "molecules_ratio": "mr", "avg_delta": "ad", "avg_delta_min": "am", "avg_delta_ent": "ae"}


def _shown(x: str) -> list[Column]:
    scores = F.array_join(F.transform(F.coalesce(f"{x}.bleu_scores", F.array().cast("array<double>")), lambda v: F.format_string("%.4f", v)), " ").alias("bleu_scores")
    return [*[F.col(f"{x}.{c}") for c in _BACK], *[F.round(f"{x}.{c}", 6).alias(c) for c in _ROUNDED], scores, F.size(F.coalesce(f"{x}.sub_scores", F.array().cast(EXPLICATION_FIELDS["sub_scores"]))).alias("graders")]


_SHOWN = (
    "x.text, x.target_word, circ AS uses_original_word, len_ AS length, primes, stop_words, molecules, len(list_distinct(mol)) AS unique_molecules, "
    + ", ".join(f"round({e}, 6) AS {c}" for c, e in _ROUNDED.items())
    + ", coalesce(array_to_string(list_transform(bleu_scores, lambda v: printf('%.4f', v)), ' '), '') AS bleu_scores, coalesce(g.graders, 0)::INT AS graders"
)
_GRADERS = "gr AS (SELECT entry_id, model, count(*) AS graders FROM a GROUP BY ALL)"


@_query(f"WITH {_X}, {_GRADERS} SELECT x.expl_id, {_SHOWN} FROM x LEFT JOIN gr g ON g.entry_id = x.entry_id AND g.model = x.model")
def js_explication(spark: SparkSession, d: str) -> DataFrame:
    """Every explication as JSON with all fields, and read back."""
    back = _scored(spark, d).select("expl_id", F.from_json(sinks.explication_json(), EXPLICATION).alias("x"))
    return back.select("expl_id", *_shown("x"))


@_query(f"WITH {_E} SELECT expl_id, avg_delta_ent AS avg_delta_min, avg_delta_min AS avg_delta_ent FROM e")
def js_swapped_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The older file format's exchanged fields, written and read as they stand."""
    rows = _explications(spark, d, "avg_delta_min", "avg_delta_ent")
    none = {c: F.lit(None) for c in EXPLICATION_FIELDS if c not in ("avg_delta_min", "avg_delta_ent")}
    back = rows.select("expl_id", F.from_json(sinks.explication_json(none, swapped=True), EXPLICATION).alias("x"))
    return back.select("expl_id", "x.avg_delta_min", "x.avg_delta_ent")


_BEST = "bp AS (SELECT grader, entry_id, lower(trim(model)) AS model, passage_id, slot, prediction, answer_logprob, answer_ranks, is_match, lines_removed FROM predictions QUALIFY row_number() OVER (PARTITION BY grader, entry_id, lower(trim(model)), passage_id, slot ORDER BY answer_logprob DESC NULLS LAST, prediction DESC NULLS LAST, is_match DESC NULLS LAST, lines_removed DESC NULLS LAST) = 1)"
_P1 = "coalesce(prediction, '') || '/' || printf('%.4f', coalesce(answer_logprob, 0.0)) || '/' || coalesce(is_match, false)::VARCHAR || '/' || coalesce(lines_removed, 0)"


@_query(
    f"WITH {_S}, {_BEST}, pp AS (SELECT *, {_P1} AS t FROM bp), "
    "ps AS (SELECT grader, entry_id, model, passage_id, max(t) FILTER (slot = 0) AS own, coalesce(string_agg(t, ' ' ORDER BY slot) FILTER (slot IN (1, 2)), '') AS mi, coalesce(string_agg(t, ' ' ORDER BY slot) FILTER (slot IN (3, 4)), '') AS en "
    "FROM pp WHERE slot BETWEEN 0 AND 4 AND model IS NOT NULL GROUP BY ALL), "
    "pl AS (SELECT grader, entry_id, model, coalesce(string_agg(own, '|' ORDER BY passage_id), '') AS exp_baselines, string_agg(mi, '|' ORDER BY passage_id) AS minimality, string_agg(en, '|' ORDER BY passage_id) AS entailments FROM ps GROUP BY ALL), "
    "pb AS (SELECT grader, entry_id, string_agg(t, '|' ORDER BY passage_id) AS baselines FROM pp WHERE slot = -1 GROUP BY ALL) "
    "SELECT a.grader, a.entry_id, a.model, round(coalesce(adj, 0), 6) AS adj_score, round(coalesce(ad, 0), 6) AS avg_delta_log, round(coalesce(am, 0), 6) AS avg_min_delta_log, round(coalesce(ae, 0), 6) AS avg_ent_delta_log, tm AS total_match, "
    "coalesce(baselines, '') AS baselines, exp_baselines, minimality, entailments FROM a JOIN pl USING (grader, entry_id, model) LEFT JOIN pb ON pb.grader = a.grader AND pb.entry_id = a.entry_id"
)
def js_sub_score(spark: SparkSession, d: str) -> DataFrame:
    """Every score with its predictions as JSON, and read back with defaults."""
    rows = scoring.score_details(readers.table(spark, d, "predictions"))
    back = rows.select("grader", "entry_id", readers.read_sub_score(sinks.sub_score_json()).alias("s"))
    one = lambda p: F.format_string("%s/%.4f/%s/%d", p["prediction"], p["answer_logprob"], p["is_match"].cast("string"), p["lines_removed"])
    flat = [F.array_join(F.transform(f"s.{c}", one), "|").alias(c) for c in ("baselines", "exp_baselines")]
    pairs = [F.array_join(F.transform(f"s.{c}", lambda x: F.array_join(F.transform(x, one), " ")), "|").alias(c) for c in ("minimality", "entailments")]
    numbers = [F.round(f"s.{c}", 6).alias(c) for c in ("adj_score", "avg_delta_log", "avg_min_delta_log", "avg_ent_delta_log")]
    return back.select("grader", "entry_id", "s.model", *numbers, "s.total_match", *flat, *pairs)


@_query(
    "SELECT grader, entry_id, model, passage_id, slot, coalesce(prediction, '') AS prediction, round(coalesce(answer_logprob, 0), 9) AS answer_logprob, coalesce(array_to_string(answer_ranks, ','), '') AS answer_ranks, "
    "coalesce(is_match, false) AS is_match, coalesce(lines_removed, 0)::INT AS lines_removed FROM predictions"
)
def js_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Every prediction as JSON without its NULL fields, and read back with defaults."""
    rows = readers.table(spark, d, "predictions")
    back = rows.select("grader", "entry_id", "model", "passage_id", "slot", readers.read_prediction(F.to_json(sinks.prediction())).alias("p"))
    return back.select(
        "grader", "entry_id", "model", "passage_id", "slot", "p.prediction", F.round("p.answer_logprob", 9).alias("answer_logprob"), F.array_join("p.answer_ranks", ",").alias("answer_ranks"), "p.is_match", "p.lines_removed"
    )


_MEANS = {"avg_total_score": "ts", "avg_score_exp": "se", "avg_primes_ratio": "pr", "avg_molecules_ratio": "mr", "avg_delta": "ad", "avg_delta_min": "am", "avg_delta_ent": "ae", "avg_length": "len_", "avg_primes": "primes", "avg_stop_words": "stop_words", "avg_molecules": "molecules", "avg_circularity": "coalesce(circ, false)::INT"}


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Models with all averages of a result file; those by language are of the stored BLEU scores."""
    by_language = _explications(spark, d, F.posexplode("bleu_scores").alias("lang_ord", "v")).where("v IS NOT NULL").groupBy("model", "lang_ord").agg(F.avg("v").alias("a"))
    arrays = by_language.groupBy("model").agg(R.ordered(F.col("a")).alias("avg_bleu"))
    none = {c: F.lit(None).cast("array<double>") for c in ("avg_comet", "avg_emb")}
    return scoring.model_averages(_final_scores(spark, d)).join(arrays, "model", "left").withColumns(none)


@_query(
    f"WITH {_X}, lb AS (SELECT model, i AS o, avg(bleu_scores[i]) AS v FROM e, range(1, 9) AS t(i) WHERE bleu_scores[i] IS NOT NULL GROUP BY ALL), la AS (SELECT model, string_agg(printf('%.4f', v), ' ' ORDER BY o) AS avg_bleu FROM lb GROUP BY model), "
    f"mm AS (SELECT model, count(*) AS num_examples, {', '.join(f'round(avg({e}), 9) AS {c}' for c, e in _MEANS.items())} FROM x GROUP BY model) SELECT mm.*, coalesce(la.avg_bleu, '') AS avg_bleu FROM mm LEFT JOIN la USING (model)"
)
def js_model(spark: SparkSession, d: str) -> DataFrame:
    """Every model's averages as JSON, and read back."""
    back = sinks.model_lines(_models(spark, d)).select(F.from_json("value", MODEL).alias("m"))
    arrays = F.array_join(F.transform(F.coalesce("m.avg_bleu", F.array().cast("array<double>")), lambda v: F.format_string("%.4f", v)), " ").alias("avg_bleu")
    return back.select("m.model", "m.num_examples", *[F.round(f"m.{c}", 9).alias(c) for c in MODEL_FIELDS if c in _MEANS], arrays)


@_query(f"WITH {_X}, {_GRADERS} SELECT x.model, {_SHOWN} FROM x LEFT JOIN gr g ON g.entry_id = x.entry_id AND g.model = x.model")
def io_result_files(spark: SparkSession, d: str) -> DataFrame:
    """A run's result file, in the exchanged form of older ones, written and read."""
    path = storage.new_path(spark, "results")
    sinks.result_file(_scored(spark, d), _models(spark, d), path, ["g"], list(LANGUAGES))
    return readers.results(spark, path).select("model", *_shown("explication"))


@_query(f"WITH {_X} SELECT model, count(*) AS explications, round(sum(ts), 4) AS total FROM x GROUP BY model")
def js_result_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Result lines, one an explication, read back and summed by model."""
    lines = sinks.result_lines(_scored(spark, d))
    back = lines.select("model", F.from_json("value", EXPLICATION).alias("x"))
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("explications"), F.round(F.sum("x.total_score"), 4).alias("total"))


@_query(
    f"WITH {_X}, dv AS ({' UNION ALL '.join(f"SELECT model, '{c}' AS measure, stddev_pop({e}) AS std FROM x GROUP BY model" for c, e in _SQLSTD.items())}) "
    "SELECT model || ', ' || measure || ': deviation ' || printf('%.4f', round(std, 4)) || ', error bar ' || printf('%.4f', round(std / 149, 4)) AS line FROM dv"
)
def io_deviation_report(spark: SparkSession, d: str) -> DataFrame:
    """The deviations of a run, from its result lines as written, a line each."""
    lines = sinks.result_lines(_scored(spark, d)).select("model", F.from_json("value", EXPLICATION).alias("x"))
    rows = lines.select("model", "x.*").withColumn("legality", scoring.legality_alternative(F.col("primes_ratio"), F.col("molecules_ratio")))
    wide = D.deviations(rows, "model", _STD)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(f"{c}_std", 4).alias("std"), F.round(f"{c}_bar", 4).alias("bar")) for c in _STD]))
    return wide.select("model", each.alias("e")).select("model", "e.*").select(sinks.deviation_report().alias("line"))


@_query(
    "SELECT grader, entry_id, passage_id, slot, max('word ' || coalesce(prediction, '') || '; log-prob ' || printf('%.4f', coalesce(answer_logprob, 0.0)) || '; ranks [' || coalesce(array_to_string(answer_ranks, ', '), '') || ']; match ' || "
    "CASE WHEN coalesce(is_match, false) THEN 'yes' ELSE 'no' END || '; lines removed ' || coalesce(lines_removed, 0)) AS shown FROM predictions GROUP BY ALL"
)
def js_prediction_line(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "predictions").withColumn("shown", sinks.prediction_line())
    return rows.groupBy("grader", "entry_id", "passage_id", "slot").agg(F.max("shown").alias("shown"))


@_query(
    "SELECT grader, entry_id, passage_id, slot, count(*) AS n, max(coalesce(prediction, '') || ' (log-prob ' || printf('%.4f', coalesce(answer_logprob, 0.0)) || ', match ' || coalesce(is_match, false)::VARCHAR || ')') AS shown FROM predictions GROUP BY ALL"
)
def js_prediction_text(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.table(spark, d, "predictions").withColumn("shown", sinks.prediction_text())
    return rows.groupBy("grader", "entry_id", "passage_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("shown").alias("shown"))


@_query("SELECT entry_id, passage_id, to_json({'text': text, 'src': src})::VARCHAR AS line FROM passages")
def js_passage_json(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct("text", "src"), {"ignoreNullFields": "false"})
    return readers.table(spark, d, "passages").select("entry_id", "passage_id", line.alias("line"))


# ---- streams


@_query(f"WITH {_C} SELECT expl_id, model, len_ AS length, primes, stop_words, molecules FROM l")
def stream_legality(spark: SparkSession, d: str) -> DataFrame:
    """The counts over a stream of deliveries, each explication once however late it comes again."""
    counts = streams.legality_stream(streams.explication_stream(spark, f"{d}/explications.parquet*"), "3650 days")
    return streams.run_available(counts).select("expl_id", "model", "length", "primes", "stop_words", "molecules")


# ---- order (ST)


@_query(f"WITH {_K} SELECT len(toks) // 16 AS bucket, count(*) AS texts, max(len(toks)) AS longest FROM k GROUP BY 1")
def st_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How many texts there are of about a length, as a trainer's or grader's batches would hold them."""
    rows = _explications(spark, d, F.size(X.tokens(F.col("text"))).cast("long").alias("length"))
    return rows.groupBy(F.floor(F.col("length") / 16).alias("bucket")).agg(F.count(F.lit(1)).alias("texts"), F.max("length").alias("longest"))


@_query(f"WITH {_E} SELECT model, min(model_ord) AS model_ord FROM e GROUP BY model ORDER BY model_ord LIMIT 3")
def st_first_models(spark: SparkSession, d: str) -> DataFrame:
    """The first three models in the order of the run: a top-k."""
    rows = _explications(spark, d, "model_ord").groupBy("model").agg(F.min("model_ord").alias("model_ord"))
    return rows.orderBy("model_ord", "model").limit(3)
