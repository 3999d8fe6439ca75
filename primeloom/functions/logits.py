"""Log-probabilities, ranks and matches from arrays of logits; one pass over the vocabulary, no sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_prob(logits: Column, answer: Column) -> Column:
    """Log-softmax at the answer (0-based), stable for large logits; NULL beyond the vocabulary."""
    x = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.get(x, answer) - (top + F.log(total))


def rank(logits: Column, answer: Column) -> Column:
    """1-based place in descending order; equal values share the least place."""
    return (F.lit(1) + F.size(F.filter(logits, lambda v: v > F.get(logits, answer)))).cast("long")


def word_log_prob(steps: Column, answer: Column) -> Column:
    """Sum of the log-probabilities of a word's tokens, the n-th at the n-th step; NULL where a step or a token's place is missing."""
    each = F.zip_with(F.slice(steps, 1, F.size(answer)), answer, log_prob)
    return F.when(F.size(answer) > 0, F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v))


def word_ranks(steps: Column, answer: Column) -> Column:
    """The rank of each of a word's tokens at its step."""
    return F.zip_with(F.slice(steps, 1, F.size(answer)), answer, rank)


def greedy(steps: Column) -> Column:
    """The most probable token of each step."""
    return F.transform(steps, argmax)


def graded_word(steps: Column, lower: Column, capital: Column) -> Column:
    """``form, answer_logprob, answer_ranks, is_match``: of the word's two forms the more probable one, in doubt the lower-case
    one; a match if the greedy tokens are that form's. A form without log-probability is never chosen over one that has it."""
    low, high = word_log_prob(steps, lower), word_log_prob(steps, capital)
    form = F.when(high.isNull() | (low >= high), "lower").otherwise("capital")
    tokens = F.when(form == "lower", lower).otherwise(capital)
    return F.struct(
        form.alias("form"), F.when(form == "lower", low).otherwise(high).alias("answer_logprob"), word_ranks(steps, tokens).alias("answer_ranks"),
        (greedy(steps) == tokens.cast("array<bigint>")).alias("is_match"),
    )


def argmax(logits: Column) -> Column:
    """0-based place of the first greatest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def choose_case(lower: Column, capital: Column) -> Column:
    """The lower-case form unless the capitalised one is more probable."""
    return F.when(lower >= capital, "lower").otherwise("capital")


def same_tokens(a: Column, b: Column) -> Column:
    """Equality of two token arrays without regard to case."""
    return F.transform(a, F.lower) == F.transform(b, F.lower)


def cosine(a: Column, b: Column) -> Column:
    """Row-wise cosine; NULL where a vector is all zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
