"""Declared schemas (DDL) of the library's tables and of the objects in result files."""

from __future__ import annotations

SCHEMAS = {
    "entries": "entry_id BIGINT, word STRING, def STRING, examples ARRAY<STRING>, ambig_examples ARRAY<STRING>",
    "nsm_dataset": "row_id BIGINT, split STRING, source STRING, word STRING, examples ARRAY<STRING>, explication STRING, made_at TIMESTAMP, loaded_at TIMESTAMP",
    "passages": "entry_id BIGINT, passage_id INT, text STRING, src STRING",
    "explications": "expl_id BIGINT, model STRING, model_ord INT, entry_id BIGINT, run_id STRING, text STRING, target_word STRING, length BIGINT, avg_delta DOUBLE, "
    "avg_delta_min DOUBLE, avg_delta_ent DOUBLE, bleu_scores ARRAY<DOUBLE>, made_at TIMESTAMP, loaded_at TIMESTAMP",
    "predictions": "grader STRING, entry_id BIGINT, model STRING, passage_id INT, slot INT, prediction STRING, answer_logprob DOUBLE, answer_ranks ARRAY<INT>, "
    "is_match BOOLEAN, lines_removed INT",
    "few_shot": "ord INT, user STRING, assistant STRING",
}
# The field names of result files.
PREDICTION_FIELDS = {"prediction": "string", "answer_logprob": "double", "answer_ranks": "array<int>", "is_match": "boolean", "lines_removed": "int"}
PREDICTION = f"struct<{','.join(f'{n}:{t}' for n, t in PREDICTION_FIELDS.items())}>"
SUB_SCORE_FIELDS = {
    "model": "string", "adj_score": "double", "avg_delta_log": "double", "avg_min_delta_log": "double", "avg_ent_delta_log": "double", "total_match": "bigint",
    "baselines": f"array<{PREDICTION}>", "exp_baselines": f"array<{PREDICTION}>", "minimality": f"array<array<{PREDICTION}>>", "entailments": f"array<array<{PREDICTION}>>",
}
SUB_SCORE = f"struct<{','.join(f'{n}:{t}' for n, t in SUB_SCORE_FIELDS.items())}>"
EXPLICATION_FIELDS = {
    "target_word": "string", "text": "string", "uses_original_word": "boolean", "total_score": "double", "score_exp": "double", "primes_ratio": "double",
    "molecules_ratio": "double", "comet_scores": "array<double>", "bleu_scores": "array<double>", "embed_scores": "array<double>", "avg_delta": "double",
    "avg_delta_min": "double", "avg_delta_ent": "double", "length": "bigint", "primes": "bigint", "stop_words": "bigint", "molecules": "bigint",
    "unique_molecules": "bigint", "sub_scores": f"array<{SUB_SCORE}>",
}
EXPLICATION = f"struct<{','.join(f'{n}:{t}' for n, t in EXPLICATION_FIELDS.items())}>"
MODEL_FIELDS = {
    "model": "string", "num_examples": "bigint", "avg_total_score": "double", "avg_primes_ratio": "double", "avg_molecules_ratio": "double", "avg_circularity": "double",
    "avg_score_exp": "double", "avg_comet": "array<double>", "avg_bleu": "array<double>", "avg_emb": "array<double>", "avg_delta": "double", "avg_delta_min": "double",
    "avg_delta_ent": "double", "avg_length": "double", "avg_primes": "double", "avg_stop_words": "double", "avg_molecules": "double",
}
MODEL = f"struct<{','.join(f'{n}:{t}' for n, t in MODEL_FIELDS.items())}>"
