"""Prompt construction as column expressions. All wording is a parameter with a default of this library.

A message list is ``array<struct<role:string,content:string>>``. A system instruction is given in one of three ways:
``native`` (a message of its own), ``emulated`` (a wrapped user turn and a fixed acknowledgement) or ``inline`` (one user text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Wording:
    explain_system: str = "Describe what the word means with short, common words only. Never use the word itself."
    explain_user: str = "Word: {word}\nExamples:\n{examples}"
    recover_system: str = "One word of the passage was replaced by <UNK>. Answer with that word alone."
    recover_with_system: str = "One word of the passage was replaced by <UNK>. A description of its meaning is given. Answer with that word alone."
    recover_user: str = "Passage: {passage}"
    recover_with_user: str = "Description: {explication}\nPassage: {passage}"
    acknowledgement: str = "Understood."
    base: str = "Paraphrase the word below.\nWord: {word}\nExamples:\n{examples}\nParaphrase:"


DEFAULT = Wording()
MESSAGES = "array<struct<role:string,content:string>>"


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column; NULL counts as empty."""
    parts, rest = [], template
    while rest:
        cuts = sorted((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest)
        if not cuts:
            parts.append(F.lit(rest))
            break
        at, name = cuts[0]
        parts += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def few_shot_turns(bank: Column) -> Column:
    """``array<struct<user,assistant>>`` as alternating turns."""
    return F.flatten(F.transform(bank, lambda p: F.array(message("user", p["user"]), message("assistant", p["assistant"]))))


def few_shot_inline(bank: Column) -> Column:
    return F.array_join(
        F.transform(bank, lambda p: F.concat(F.lit("<USER>"), p["user"], F.lit("</USER>\n<ASSISTANT>"), p["assistant"], F.lit("</ASSISTANT>\n"))), ""
    )


def first_pairs(bank: Column, most: int | None) -> Column:
    """The first pairs of the bank: all for None, none for 0."""
    return bank if most is None else F.slice(bank, 1, most)


MODES = ("native", "emulated", "inline")


def messages(system: Column, user: Column, bank: Column | None = None, mode: str | Column = "native", wording: Wording = DEFAULT) -> Column:
    """``mode``: one for all rows, or a column with each row's own. A NULL system instruction gives no system turn."""
    if isinstance(mode, Column):
        made = {m: messages(system, user, bank, m, wording) for m in MODES}
        return F.when(mode == "native", made["native"]).when(mode == "emulated", made["emulated"]).when(mode == "inline", made["inline"])
    turns = few_shot_turns(bank) if bank is not None else F.array().cast(MESSAGES)
    asked, none = F.array(message("user", user)), F.array().cast(MESSAGES)
    if mode == "native":
        return F.concat(F.when(system.isNotNull(), F.array(message("system", system))).otherwise(none), turns, asked)
    wrapped = F.concat(F.lit("<SYS>"), system, F.lit("</SYS>"))
    if mode == "emulated":
        return F.concat(F.when(system.isNotNull(), F.array(message("user", wrapped), message("assistant", F.lit(wording.acknowledgement)))).otherwise(none), turns, asked)
    if mode == "inline":
        shots = few_shot_inline(bank) if bank is not None else F.lit("")
        instruction = F.coalesce(F.concat(wrapped, F.lit("\n")), F.lit(""))
        return F.array(message("user", F.concat(instruction, shots, F.lit("<USER>"), user, F.lit("</USER>"))))
    raise ValueError(f"mode must be native, emulated or inline, not {mode!r}")


def grader_mode(grader: Column, slot: Column) -> Column:
    """How a grader gets its system instruction: by its name, read with its case for passages alone and without it else."""
    emulated = F.when(slot == -1, emulates_system(grader, ignore_case=False)).otherwise(emulates_system(grader))
    return F.when(emulated, "emulated").otherwise("native")


def joined_examples(examples: Column, between: str = "\n\n") -> Column:
    return F.coalesce(F.array_join(examples, between), F.lit(""))


def explication_user(word: Column, examples: Column, wording: Wording = DEFAULT) -> Column:
    return fill(wording.explain_user, word=word, examples=joined_examples(examples))


def recovery(passage: Column, explication: Column, wording: Wording = DEFAULT) -> tuple[Column, Column]:
    """System text and user text; another pair where there is an explication."""
    has = explication.isNotNull()
    system = F.when(has, wording.recover_with_system).otherwise(wording.recover_system)
    user = F.when(has, fill(wording.recover_with_user, explication=explication, passage=passage)).otherwise(fill(wording.recover_user, passage=passage))
    return system, user


def base_prompt(word: Column, examples: Column, variant: str = "batch", wording: Wording = DEFAULT) -> Column:
    """``batch``: indented lines; ``plain``: as worded; ``newline``: as worded with a line break at the end."""
    text = fill(wording.base, word=word, examples=joined_examples(examples, "\n"))
    if variant == "batch":
        return F.concat(F.lit("    "), F.regexp_replace(text, "\n", "\n    "))
    return F.concat(text, F.lit("\n")) if variant == "newline" else text


def training_text(word: Column, examples: Column, answer: Column, wording: Wording = DEFAULT) -> Column:
    """One chat-tagged training text."""
    return F.concat(
        F.lit("<|system|>\n" + wording.explain_system + "\n<|user|>\n"), explication_user(word, examples, wording), F.lit("\n<|assistant|>\n"), F.coalesce(answer, F.lit("")), F.lit("<|end|>")
    )


def emulates_system(model: Column, pattern: str = "gemma", ignore_case: bool = True) -> Column:
    """Whether a grader needs an emulated system turn, by its name."""
    return F.contains(F.lower(model) if ignore_case else model, F.lit(pattern))


def chat_line(custom_id: Column, model: Column, msgs: Column) -> Column:
    """Request line, format A."""
    body = F.struct(model.alias("model"), msgs.alias("messages"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")), {"ignoreNullFields": "false"})


def parts_line(key: Column, msgs: Column, mime: str = "text/plain") -> Column:
    """Request line, format B: roles ``user`` and ``model``; a system text in an object of its own, with the generation's
    configuration, and neither of these without one. Another role is an error."""
    role = lambda m: F.when(m["role"] == "assistant", "model").when(m["role"] == "user", "user").otherwise(F.raise_error(F.concat(F.lit("no such role: "), F.coalesce(m["role"], F.lit("NULL")))))
    turns = F.transform(
        F.filter(msgs, lambda m: m["role"].isNull() | (m["role"] != "system")),
        lambda m: F.struct(role(m).alias("role"), F.array(F.struct(F.coalesce(m["content"], F.lit("")).alias("text"))).alias("parts")),
    )
    system = F.transform(F.filter(msgs, lambda m: m["role"] == "system"), lambda m: F.struct(F.coalesce(m["content"], F.lit("")).alias("text")))
    has = F.size(system) > 0
    request = F.struct(
        turns.alias("contents"), F.when(has, F.struct(system.alias("parts"))).alias("system_instruction"), F.when(has, F.struct(F.lit(mime).alias("response_mime_type"))).alias("generationConfig")
    )
    return F.to_json(F.struct(key.alias("id"), request.alias("request")))
