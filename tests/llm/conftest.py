import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Tables from rows: missing columns are NULL; every table also has columns whose names clash with inner ones."""

    schemas = {
        "nsm_dataset": "row_id long, split string, source string, word string, examples array<string>, explication string, made_at timestamp, loaded_at timestamp",
        "explications": "expl_id long, model string, model_ord int, entry_id long, run_id string, text string, target_word string, loaded_at timestamp",
        "entries": "entry_id long, word string, def string, examples array<string>",
        "documents": "doc_id long, text string, lang string, source string",
        "benchmark_items": "item_id long, word string, kind string, split string, text string",
        "mix_targets": "source string, target_share double, max_repeats int",
        "level_labels": "doc_id long, reading_level int, rater string",
    }
    clash = "id long, rep long, key string, n int, total double, tab string, digest string, side int, size int, _turn int, term string, h double, uses int, mark string, level int"

    def make(name, rows):
        have = {c.split()[0] for c in schemas[name].split(", ")}
        extra = [c for c in clash.split(", ") if c.split()[0] not in have]
        names = [c.split()[0] for c in schemas[name].split(", ")] + [c.split()[0] for c in extra]
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join([schemas[name], *extra]))

    return make
