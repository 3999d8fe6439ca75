"""Problem 5: answers that don't answer their prompt, with the type of defect; and the labels other problems share.

Method: a response is compressed with its prompt (word and examples) as a zstandard dictionary; one that nearly vanishes is a
copy. Dictionaries of function words and of refusal cues give ``language`` and ``refusal``; the terminal-context model of
``truncated`` gives ``truncated``. The first that holds of empty, language, refusal, copy, truncated is the defect.

Defined cases: NULL, blank and label-only answers are ``empty``; NULL words, NULL, empty or blank examples leave less to copy
from; re-delivered rows count once; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from primeloom.llm import pairs as P
from primeloom.llm import words as W

# Frequent function words by language, placeholders, labels, cues of refusals.
FUNCTION_WORDS = {
    "en": "the a an of to and in is it that this with for on at by be are was were not no one some people someone something other like say says think thinks know can do did want wants maybe because when if has have had but as from about many about after before they he she we you i my his her its there here what who which would will all very more",
    "de": "der die das den dem des ein eine einen einem einer und ist nicht wie von mit zu auf im in an für es sie er wir ich man jemand niemand etwas viel viele leute dieser diese dieses wenn weil aber oder auch so sagt sagen denkt dass kann können warum davon anderer andere anders lange vor zeit weiß sieht hört fühlt macht möchte deshalb nichts",
    "fr": "le la les l un une des du de d et est ne pas n que qu qui ce cette ces il elle on nous vous je dans sur avec pour par mais ou où comme quelque quelqu chose personne beaucoup gens parce quand si autre partie longtemps dit pense peut très a à au aux sont c",
    "es": "el la los las un una unos unas de del y es no que se en con por para como pero o lo su sus esta este esto alguien nadie algo mucho mucha gente cuando porque otra otro parte hace tiempo dice piensa puede decir muy más a al son eso",
    "it": "il lo la i gli le l un uno una di del della dei e è non che si in con per come ma o su questa questo qualcuno nessuno qualcosa molto molta gente quando perché altra altro parte fa tempo dice pensa può dire più a al sono",
    "pt": "o a os as um uma de do da dos das e é não que se em no na com por para como mas ou seu sua esta este isto alguém ninguém algo muito muita gente quando porque outra outro parte há tempo diz pensa pode dizer mais ao são",
    "nl": "de het een en is niet dat die dit van in op met voor te aan als maar of zijn haar hij zij wij ik men iemand niemand iets veel mensen wanneer omdat ander andere deel lang tijd zegt denkt kan zeggen zeer meer om er",
    "sv": "en ett den det de och är inte som att i på med för av till om men eller han hon vi jag man någon ingen något mycket många människor när därför annan andra del lång tid säger tänker kan mer",
    "pl": "i w na z do nie że się jest to jak o ale lub on ona my ja ktoś nikt coś dużo ludzi kiedy bo inny inna część czas mówi myśli może bardzo",
}
PLACEHOLDERS = "empty none null nil na nan tbd todo undefined unknown missing blank placeholder pending wip xxx fixme unavailable untitled content text answer response output explication paraphrase insert"
EMPTY_PHRASES = "no answer, not available, not applicable, to be done, to be determined, to be defined, to do, coming soon, no response, no text, no explication, no paraphrase, no content, n a, left blank, empty string, insert text here, answer here, your answer here, lorem ipsum"
LABELS = "paraphrase explication answer response output word meaning definition result text examples example explanation it means the meaning"
REFUSAL_CUES = (
    r"\b(?:can(?:no|')?t|can not|could(?:n't| not)|won't|will not|would(?:n't| not)|unable|(?:not|isn't) (?:able|allowed|permitted|possible|appropriate)|"
    r"declin\w+|refus\w+|reject\w+|blocked|rather not|prefer not|not going to|must not|may not|no answer|don't (?:have|know)|do not (?:have|know)|not (?:feel )?comfortable|don't feel comfortable|uncomfortable|outside (?:of )?what|beyond what|denied|stop(?:s|ped)?|withheld|nothing (?:i|we) (?:can|could)|inappropriate)\b"
)
SORRY_CUES = r"\b(?:sorry|apolog\w+|regret\w*|unfortunately|afraid)\b"
OBJECT_CUES = (
    r"\b(?:requests?|requested|tasks?|entry|entries|paraphras\w+|explication\w*|rewrit\w*|assist\w*|guidelines?|polic(?:y|ies)|language model|ai|model|answer that|"
    r"help with|help you|explain|describe|generate|continue|information|context|instructions?|simple terms|basic words|provide|comply|fulfil\w*|express|define|definition|examples?|prompt|attempt|responses?|filter|safety|appropriate|inappropriate|allowed|permitted|comfortable)\b"
)
ASK_CUES = r"\b(?:could you|can you|would you|please (?:provide|tell|give|clarify|specify|share|explain|say)|do you (?:mean|want)|did you mean|what do you|what exactly|which (?:sense|meaning|one|of)|tell me more|more context|more information|more details|clarify)\b"
FIRST_PERSON = r"\b(?:i|i'm|i'd|i'll|i've|we|me|my|our|this assistant|the assistant|the model|as an ai|language model)\b"

_TABLE = {lang: frozenset(said.split()) for lang, said in FUNCTION_WORDS.items()}
_PLACEHOLDERS = frozenset(PLACEHOLDERS.split()) | frozenset(x.strip() for x in EMPTY_PHRASES.split(","))
_LABEL = re.compile(rf"^\s*(?:[-*•>#\s]*)(?:\*\*)?(?:{'|'.join(sorted(LABELS.split(), key=len, reverse=True))}|it means|the meaning)(?:\*\*)?\s*:\s*", re.I)
_REFUSAL, _SORRY, _OBJECT, _ASK, _FIRST = (re.compile(x) for x in (REFUSAL_CUES, SORRY_CUES, OBJECT_CUES, ASK_CUES, FIRST_PERSON))
_QUOTED = re.compile(r"“[^”]*(?:”|$)|«[^»]*(?:»|$)|(?<!\w)\"[^\"]*(?:\"|$)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”)]?\s+|\n+")
_DECORATION = re.compile(r"\s*(?:\(\w+\)|[:;]-?[)D])\s*$")
#: most words of a text that is nothing but labels and placeholders
LONGEST_EMPTY = max(len(x.split()) for x in _PLACEHOLDERS) + 8
LEAST_ENGLISH_OF, LEAST_ENGLISH = 6, 0.15  # words from which an answer's share of English function words tells, and that share
COPY_LEFT = 0.35  # part of a response's own compressed size that may be left once its prompt is known
STRANGE = 0.6  # part of a response in words its prompt lacks from which no copy is looked for: such words hardly compress
FRAME = 9  # bytes of a zstandard frame without content, about


def body(text: str) -> str:
    """The text without labels before it and marks after it."""
    for _ in range(2):
        text = _LABEL.sub("", text, count=1)
    return _DECORATION.sub("", text).strip()


def is_empty(text: str | None, said: list[str] | None = None) -> bool:
    """``said``: the text's words, where they are at hand."""
    if said is not None and len(said) > LONGEST_EMPTY:
        return False
    plain = " ".join(W.words((text or "").replace("/", " ").replace("_", " ")))
    if not plain or plain in _PLACEHOLDERS:
        return True
    left = " ".join(W.words(body(text or "").replace("/", " ").replace("_", " ")))
    return not left or left in _PLACEHOLDERS


def other_language(text: str, plain: list[str] | None = None) -> bool:
    """Whether most of the text is in another language: by function words, or by letters that English doesn't use."""
    if plain and sum(w in _TABLE["en"] for w in plain) >= 0.55 * len(plain):
        return False  # no other language can have more than 1.5 times as many, and such words are spelt with English letters
    said = W.words(body(text).replace("’", " ").replace("'", " "))
    letters = [c for c in text if c.isalpha()]
    if letters and sum(c > "ɏ" for c in letters) * 2 > len(letters):
        return True
    if len(said) < 3:
        return False
    hits = {lang: sum(w in table for w in said) for lang, table in _TABLE.items()}
    most = max(n for lang, n in hits.items() if lang != "en")
    if most > 1.5 * hits["en"] and most >= 0.25 * len(said):
        return True
    # a language without a dictionary here: hardly any word that English can't do without
    return len(said) >= LEAST_ENGLISH_OF and hits["en"] < LEAST_ENGLISH * len(said)


def is_refusal(text: str) -> bool:
    """Whether the text declines or asks back and holds no paraphrase. What is in quotation marks is spoken of, not said."""
    said = body(text).lower().replace("’", "'")
    if not (_REFUSAL.search(said) or _SORRY.search(said) or _ASK.search(said)):
        return False  # no sentence can decline or ask
    said = _QUOTED.sub(" ", said)
    sentences = [s for s in (x.strip(" -*•\t") for x in _SENTENCE.split(said)) if W.words(s)]
    refusing, words = 0, 0
    for s in sentences:
        n = len(W.words(s))
        words += n
        about = bool(_OBJECT.search(s))
        declined = bool(_REFUSAL.search(s)) and about and (bool(_FIRST.search(s)) or bool(_SORRY.search(s)) or bool(re.search(r"declin|refus|reject|block|permitted|allowed|denied|no answer|possible|filter|withheld", s)))
        sorry = bool(_SORRY.search(s)) and (about or bool(_REFUSAL.search(s)))
        asked = bool(_ASK.search(s)) and ("?" in s or bool(re.search(r"\bplease\b|\byou\b|\bcontext\b", s)) or about)
        refusing += declined or sorry or asked
    return refusing > 0 and (2 * refusing >= len(sentences) or (len(sentences) <= 3 and words <= 40))


def left_after_prompt(prompt: str, said: str, level: int = 3) -> float:
    """Compressed size of ``said`` with the prompt as dictionary, over that without, both less an empty frame's size.

    The window spans both whole, so the first word of the longest prompt is still within reach of the last of the answer.
    """
    data, before = said.encode(), prompt.encode()
    window = min(max((len(data) + len(before)).bit_length(), 17), zstandard.WINDOWLOG_MAX)
    params = zstandard.ZstdCompressionParameters.from_level(
        level, window_log=window, hash_log=min(window, 24), chain_log=min(window, 24), write_content_size=False, write_checksum=False
    )
    plain = len(zstandard.ZstdCompressor(compression_params=params).compress(data)) - FRAME
    known = zstandard.ZstdCompressionDict(before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return max(0, len(zstandard.ZstdCompressor(compression_params=params, dict_data=known).compress(data)) - FRAME) / max(1, plain)


def is_copy(word: str | None, examples: list[str | None] | None, text: str) -> bool:
    said = W.words(body(text))
    own = W.words(word)
    if own and len(said) <= 4 * len(own) + 2 and all(any(w == o or SequenceMatcher(None, w, o).ratio() >= 0.8 for o in own) for w in said):
        return True
    shown = [W.words(e) for e in examples or [] if e]
    shown = [e for e in shown if e]
    if not said or not (shown or own):
        return False
    prompt = " ".join(["word", *own, "examples", *(w for e in shown for w in e)])
    if len(said) < 5:  # too short to compress: the same words in the same order, or nothing but labels and the word
        return f" {' '.join(said)} " in f" {' '.join(' '.join(e) for e in shown)} " and len(said) >= 3
    if sum(map(len, set(said).difference(prompt.split(" ")))) > STRANGE * sum(map(len, said)):
        return False  # words the prompt lacks are spelt out, each once at least: too much would be left
    return left_after_prompt(prompt, " ".join(said)) < COPY_LEFT


def label(word: str | None, examples: list[str | None] | None, text: str | None) -> str | None:
    """``empty``, ``language``, ``refusal``, ``copy`` or None."""
    plain = W.words(text)
    if is_empty(text, plain):
        return "empty"
    if other_language(text, plain):
        # an example or a word given back is a copy in whatever language it may be
        return "copy" if is_copy(word, examples, text) else "language"
    if is_refusal(text):
        return "refusal"
    return "copy" if is_copy(word, examples, text) else None


def labelled(rows: DataFrame, *carried: str) -> DataFrame:
    """``id``, the columns named and ``defect`` (NULL where none of the four holds) of rows with ``id, word, examples, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [label(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[4:], pa.array(got, pa.string())], ["id", *carried, "defect"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "word", "examples", "text", *carried).mapInArrow(run, f"id long, {''.join(f'{c} {kinds[c]}, ' for c in carried)}defect string")


def defects(dataset: DataFrame) -> DataFrame:
    """``row_id, source, defect``: every record, its defect NULL where the answer is sound.

    Cut answers are judged by the closing words and copies of this table alone; ``truncated.found`` reads a second table beside it.
    """
    from primeloom.llm import truncated

    rows = P.latest(dataset, "row_id", F.lower(F.trim("source")).alias("source"), "word", "examples", F.col("explication").alias("text")).withColumnRenamed("row_id", "id")
    held = truncated.prepared(rows)
    cut = truncated.cut_ends(held).select("id", F.lit(True).alias("cut"))
    named = labelled(held, "source").join(cut, "id", "left")
    return named.select(F.col("id").alias("row_id"), "source", F.coalesce("defect", F.when(F.col("cut"), "truncated")).alias("defect"))


def found(dataset: DataFrame) -> DataFrame:
    """``row_id, defect``."""
    return defects(dataset).where("defect IS NOT NULL").select("row_id", "defect")


def by_source(dataset: DataFrame) -> DataFrame:
    """``source, defect, records, share``: share of the source's records; a NULL defect counts the sound ones."""
    counted = defects(dataset).groupBy("source", "defect").agg(F.count(F.lit(1)).alias("records"))
    return counted.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("source")), 6))
