"""The queries of this subpackage (``pN_...``) and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeloom.llm import answers, leaks, mixing, near_edits, reading_level, split_overlap, term_counts, truncated
from primeloom.queries import words_sql


def _on(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def _runs(words: str, k: int = 3) -> str:
    return f"unnest(list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i:i + {k - 1}], ' ')))"


_DATASET = (
    "r AS (SELECT * FROM nsm_dataset WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST) = 1), "
    f"w AS (SELECT row_id, split, lower(trim(source)) AS source, list_concat({words_sql('explication')}, coalesce(flatten(list_transform(list_filter(examples, lambda e: e IS NOT NULL), "
    f"lambda e: {words_sql('e')})), [])) AS ws FROM r), "
    f"g AS (SELECT DISTINCT row_id, g FROM (SELECT row_id, {_runs('ws')} AS g FROM w WHERE len(ws) >= 3)), n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id), "
    "c AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL), "
    "p AS (SELECT x, y, c / (m.n + o.n - c) AS sim FROM c JOIN n m ON m.row_id = x JOIN n o ON o.row_id = y WHERE c / (m.n + o.n - c) >= 0.5), "
    "q AS (SELECT p.*, i.split AS sx, j.split AS sy FROM p JOIN w i ON i.row_id = x JOIN w j ON j.row_id = y "
    "WHERE (i.split = 'train' AND j.split IN ('validation', 'test')) OR (j.split = 'train' AND i.split IN ('validation', 'test')))"
)
_TERMS = (
    "t AS (SELECT 'e' AS tab, expl_id AS id, text FROM explications WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY expl_id ORDER BY loaded_at DESC) = 1 "
    "UNION ALL SELECT 'n', row_id, explication FROM nsm_dataset WHERE explication IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) = 1), "
    f"u AS (SELECT tab, id, unnest({words_sql('text')}) AS term FROM t), "
    "v AS (SELECT term, count(*) AS occurrences, count(DISTINCT (tab, id)) AS records FROM u GROUP BY term), "
    "m AS (SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM t) THEN 'common' END AS mark FROM v)"
)
_LEAKS = (
    f"i AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, {_runs('ws')} AS g FROM (SELECT item_id, {words_sql('text')} AS ws FROM benchmark_items) WHERE len(ws) >= 3)), "
    f"d AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {_runs('ws')} AS g FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents) WHERE len(ws) >= 3)), "
    "n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id), h AS (SELECT doc_id, item_id, count(*) AS h FROM d JOIN i USING (g) GROUP BY ALL), "
    "l AS (SELECT doc_id, item_id, h / n AS share FROM h JOIN n USING (item_id) WHERE h >= 0.5 * n)"
)


def oracle_sql() -> dict[str, str]:
    """For queries that SQL can express. The others are tested against brute force, round trips or held-out labels."""
    return {
        "p1_found": f"WITH {_DATASET} SELECT x AS row_id_a, y AS row_id_b FROM q",
        "p1_evaluation_counts": f"WITH {_DATASET} SELECT k AS row_id, w.split, w.source, count(*) AS train_records, count(*) FILTER (sim >= 1) AS exact_copies "
        "FROM (SELECT CASE WHEN sx = 'train' THEN y ELSE x END AS k, sim FROM q) JOIN w ON w.row_id = k GROUP BY ALL",
        "p1_counts_by_split_and_source": f"WITH {_DATASET}, k AS (SELECT CASE WHEN sx = 'train' THEN y ELSE x END AS row_id, count(*) AS n FROM q GROUP BY ALL) "
        "SELECT split, source, count(*) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM w LEFT JOIN k USING (row_id) WHERE split IN ('validation', 'test') AND len(ws) > 0 GROUP BY ALL",
        "p2_found": f"WITH {_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p2_terms": f"WITH {_TERMS} SELECT * FROM m",
        "p4_found": f"WITH {_DATASET} SELECT x AS row_id_a, y AS row_id_b FROM p",
        "p4_classes": f"WITH {_DATASET}, k AS (SELECT row_id, min(row_id) OVER (PARTITION BY ws) AS class_id, count(*) OVER (PARTITION BY ws) AS copies FROM w WHERE len(ws) > 0), "
        "e AS (SELECT DISTINCT i.class_id AS a, j.class_id AS b FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p) z JOIN k i ON i.row_id = z.x JOIN k j ON j.row_id = z.y WHERE i.class_id <> j.class_id) "
        "SELECT row_id, class_id, copies, (SELECT count(*) FROM e WHERE a = class_id) AS links FROM k",
        "p6_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM l",
        "p6_removal_spans": f"WITH {_LEAKS}, w AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents), "
        "o AS (SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i) WHERE len(ws) >= 3), "
        "c AS (SELECT o.doc_id, i.item_id, pos FROM o JOIN i USING (g) JOIN l ON l.doc_id = o.doc_id AND l.item_id = i.item_id), "
        "b AS (SELECT *, max(pos + 2) OVER (PARTITION BY doc_id ORDER BY pos, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM c), "
        "s AS (SELECT *, sum(CASE WHEN e IS NULL OR pos > e + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM b) "
        "SELECT doc_id, min(pos)::INT AS first_word, (max(pos) + 2)::INT AS last_word, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM s GROUP BY doc_id, s",
        "p6_leaked_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS documents, round(max(share), 6) AS best_share FROM l GROUP BY item_id",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on(split_overlap.found, "nsm_dataset"),
        "p1_by_split_and_source": _on(split_overlap.by_split_and_source, "nsm_dataset"),
        "p1_evaluation_records": _on(split_overlap.evaluation_records, "nsm_dataset"),
        "p1_evaluation_counts": _on(split_overlap.evaluation_counts, "nsm_dataset"),
        "p1_counts_by_split_and_source": _on(split_overlap.counts_by_split_and_source, "nsm_dataset"),
        "p2_found": _on(term_counts.found, "explications", "nsm_dataset"),
        "p2_terms": _on(term_counts.terms, "explications", "nsm_dataset"),
        "p3_found": _on(truncated.found, "explications", "nsm_dataset", "entries"),
        "p3_rates": _on(truncated.rates, "explications", "nsm_dataset", "entries"),
        "p4_found": _on(near_edits.found, "nsm_dataset"),
        "p4_classes": _on(near_edits.class_links, "nsm_dataset"),
        "p4_class_pairs": _on(near_edits.class_pairs, "nsm_dataset"),
        "p5_found": _on(answers.found, "nsm_dataset"),
        "p5_by_source": _on(answers.by_source, "nsm_dataset"),
        "p6_found": _on(leaks.found, "documents", "benchmark_items"),
        "p6_removal_spans": lambda spark, d: _on(leaks.removal_spans, "documents", "benchmark_items")(spark, d).withColumn("items", F.array_join("items", ",")),
        "p6_leaked_items": _on(leaks.leaked_items, "documents", "benchmark_items"),
        "p7_mixture": _on(mixing.mixture, "documents", "mix_targets"),
        "p7_shares": _on(mixing.shares, "documents", "mix_targets"),
        "p8_found": _on(reading_level.found, "documents", "level_labels"),
        "p8_profile": _on(reading_level.profile, "documents", "level_labels"),
    }
