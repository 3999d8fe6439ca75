"""Column expressions over texts: normalise, tokenise, classify, bands. All stay in the JVM.

NULL texts count as empty. Ratios of an empty text are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from primeloom.functions import lexicon as L

_SPACE = r"(?U)\s"


def normalise(text: Column) -> Column:
    """Lower case without any character that is no letter, digit, underscore or white space (Unicode)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE + "+"), lambda t: t != "")


def tokens(text: Column) -> Column:
    return split_words(normalise(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def capitalise(word: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def count_in(toks: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(*lexicon))).cast("long")


def molecules(toks: Column, primes: Sequence[str] = L.PRIMES, stop_words: Sequence[str] = L.STOP_WORDS) -> Column:
    """Tokens in neither lexicon, with repeats."""
    return F.filter(toks, lambda t: ~t.isin(*primes, *stop_words))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def legality(toks: Column, primes: Sequence[str] = L.PRIMES, stop_words: Sequence[str] = L.STOP_WORDS) -> dict[str, Column]:
    """Counts and ratios of a token array."""
    length, n_primes = F.size(toks).cast("long"), count_in(toks, primes)
    rest = molecules(toks, primes, stop_words)
    n_rest = F.size(rest).cast("long")
    return {
        "length": length,
        "primes": n_primes,
        "stop_words": count_in(toks, stop_words),
        "molecules": n_rest,
        "unique_molecules": F.size(F.array_distinct(rest)).cast("long"),
        "primes_ratio": ratio(n_primes, length),
        "molecules_ratio": ratio(n_rest, length),
    }


def circular_exact(target: Column, toks: Column) -> Column:
    """Whether the target's first token is among the tokens; NULL without a target."""
    first = F.try_element_at(tokens(target), F.lit(1))
    return F.when(target.isNull() | first.isNull(), F.lit(None).cast("boolean")).otherwise(F.array_contains(toks, first))


def circular_lemma(target: Column, toks: Column, lemmas: dict[str, str]) -> Column:
    """As ``circular_exact``, both sides by lemma; forms that the table lacks are their own lemma."""
    table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair]) if lemmas else None

    def lemma(t: Column) -> Column:
        return F.coalesce(F.try_element_at(table, t), t) if table is not None else t

    first = F.try_element_at(tokens(target), F.lit(1))
    return F.when(target.isNull() | first.isNull(), F.lit(None).cast("boolean")).otherwise(F.exists(toks, lambda t: lemma(t) == lemma(first)))


def route(model: Column, names: Sequence[str] = ("gpt", "gemini", "llama", "mistral", "demo")) -> Column:
    """The first of the names that the model's name holds, in any case; NULL for none. The last is that of one's own adapted models."""
    rule = F.lit(None).cast("string")
    for name in reversed(names):
        rule = F.when(F.contains(F.lower(model), F.lit(name)), name).otherwise(rule)
    return rule


def band(value: Column, first: float, second: float, least: bool, labels: Sequence[str] = ("good", "fair", "poor")) -> Column:
    """Three bands by two thresholds; ``least``: the value must reach them, otherwise not exceed them."""
    ok = (lambda v, t: v >= t) if least else (lambda v, t: v <= t)
    return F.when(ok(value, F.lit(first)), labels[0]).when(ok(value, F.lit(second)), labels[1]).otherwise(labels[2])


def bands(counts: dict[str, Column], circular: Column) -> dict[str, Column]:
    share = ratio(counts["stop_words"], counts["length"])
    return {
        "primes_band": band(counts["primes_ratio"], 0.6, 0.4, True),
        "molecules_band": band(counts["molecules_ratio"], 0.2, 0.4, False),
        "stop_words_band": band(share, 0.3, 0.5, False),
        "circularity": F.when(F.coalesce(circular, F.lit(False)), "yes").otherwise("no"),
    }
