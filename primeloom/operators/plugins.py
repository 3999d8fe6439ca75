"""Model-backed steps as plug-ins over Arrow batches.

A plug-in is made once a partition by its factory (where it loads its weights) and maps a pandas frame to one column. Results
of sampling plug-ins should be written before they are used twice. The stand-ins below are deterministic and for tests only;
what they return is no model's result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Decoding:
    """How a generator decodes; ``seed`` makes a batch of sampled texts the same again."""

    max_new_tokens: int = 512
    do_sample: bool = True
    top_k: int = 50
    top_p: float = 0.95
    temperature: float = 0.7
    seed: int = 0

    def __post_init__(self):
        if self.max_new_tokens < 1 or self.top_k < 0 or not 0 < self.top_p <= 1 or (self.do_sample and self.temperature <= 0):
            raise ValueError("decoding needs at least one token, a share of 0 to 1, and a temperature above 0 to sample")


GREEDY = Decoding(do_sample=False, top_k=0, top_p=1.0, temperature=1.0)


class Generator(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.Series:
        """Text for each ``prompt``, decoded as the ``Decoding`` its factory was given says."""


class Grader(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        """``prediction, answer_logprob, answer_ranks, is_match`` for each ``prompt`` and ``word``."""


class Translator(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.Series:
        """``text`` to language ``lang`` and back."""


class Embedder(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.Series:
        """A vector for each ``text``."""


class Metric(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.Series:
        """A score for each ``hypothesis`` and ``reference``."""


def _mapped(rows: DataFrame, make: Callable[[], Callable], add: str, names: list[str], size: int | None, on_error=None) -> DataFrame:
    if size is not None and size < 1:
        raise ValueError("the batch size must be 1 or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = None
        for whole in batches:
            step = step or make()
            for at in range(0, len(whole), size or max(1, len(whole))):
                part = whole.iloc[at : at + (size or len(whole))].copy()
                try:
                    got = step(part)
                except Exception:
                    if on_error is None:
                        raise
                    got = pd.Series([on_error] * len(part))
                for n in names:
                    part[n] = list(got[n] if isinstance(got, pd.DataFrame) else got)
                yield part

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {add}")


def generate(prompts: DataFrame, make: Callable[[Decoding], Generator], size: int | None = None, decoding: Decoding = Decoding()) -> DataFrame:
    return _mapped(prompts, lambda: make(decoding), "text string", ["text"], size)


def grade(prompts: DataFrame, make: Callable[[], Grader], size: int | None = None) -> DataFrame:
    return _mapped(prompts, make, "prediction string, answer_logprob double, answer_ranks array<int>, is_match boolean", ["prediction", "answer_logprob", "answer_ranks", "is_match"], size)


def translate(texts: DataFrame, make: Callable[[], Translator], size: int | None = None) -> DataFrame:
    """Adds ``back``; a batch whose translation fails gives empty texts."""
    return _mapped(texts, make, "back string", ["back"], size, on_error="")


def embed(texts: DataFrame, make: Callable[[], Embedder], size: int | None = None) -> DataFrame:
    return _mapped(texts, make, "vector array<double>", ["vector"], size)


def measure(pairs: DataFrame, make: Callable[[], Metric], size: int | None = 64) -> DataFrame:
    return _mapped(pairs, make, "metric double", ["metric"], size)


# ---- stand-ins: each a rule that SQL can state too


def _number(text: str, word: str) -> float:
    return (len(text or "") * 31 + len(word or "")) % 997 / 997


def fake_generator(decoding: Decoding) -> Generator:
    """Something like the prompt's last word, cut at the most tokens."""

    def run(b: pd.DataFrame) -> pd.Series:
        return pd.Series([" ".join(f"this is something like {p.split()[-1] if p and p.split() else 'this'}".split(" ")[: decoding.max_new_tokens]) for p in b["prompt"]])

    return run


def fake_grader() -> Grader:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = [_number(p, w) for p, w in zip(b["prompt"], b["word"])]
        return pd.DataFrame({"prediction": b["word"].tolist(), "answer_logprob": [math.log(v + 1e-6) for v in x], "answer_ranks": [[int(v * 50) + 1] for v in x], "is_match": [v > 0.5 for v in x]})

    return run


#: what the stand-in loses on the way to each language and back
FAKE_LOSSES = {"de": ("this", "that"), "fr": ("people", "persons"), "es": ("something", "a thing"), "ja": ("someone", "a person"), "sw": (" of ", " "), "hi": ("thing", "object"), "fi": ("the ", ""), "ar": ("can ", "")}


def fake_translator(losses: Mapping[str, tuple[str, str]] = FAKE_LOSSES) -> Translator:
    """Replaces one string for each language; a language it doesn't know fails."""
    return lambda b: pd.Series([(t or "").replace(*losses[n]) for t, n in zip(b["text"], b["lang"])])


def fake_embedder(letters: str = "aeiostnr") -> Embedder:
    """How often each of some letters stands in a text."""
    return lambda b: pd.Series([[float((t or "").count(c)) for c in letters] for t in b["text"]])


def fake_metric() -> Metric:
    """One less the part of the longer text's length by which the two differ."""
    return lambda b: pd.Series([1.0 - abs(len(h or "") - len(r or "")) / max(len(h or ""), len(r or ""), 1) for h, r in zip(b["hypothesis"], b["reference"])])
