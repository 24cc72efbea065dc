"""Structured completions: parsing, the format gate, rubric scores and rewards."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, bullets, json_list, json_text, once, strip
from tessera.schemas import DIMENSIONS, RUBRIC

#: The version that is part of every memo key.
JUDGE_PROMPT_VERSION = "scientific-design-judge-v2"
MAX_SCORE = 4

_TAG = f"(?iu)</?(?:{'|'.join(DIMENSIONS)})>"
_IN_ORDER = rf"(?iu)\A{''.join(f'<{d}></{d}>' for d in DIMENSIONS)}\z"


def completion_text(messages: Column) -> Column:
    """Text of a completion given as chat messages: the last one's content; an empty list reads ``[]``."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(F.size(messages) == 0, F.lit("[]")).otherwise(F.coalesce(last["content"], F.lit("")))


def parse_completion(text: Column) -> Column:
    """Struct of the four stripped sections, or null where the completion is malformed.

    The sections come in order with nothing else around them, none is blank, none holds a section tag.  So a completion is cut at its section
    tags, in one pass: there must be eight, in order, with blanks before, between and after the sections.  No pattern looks back,
    so the time is that of reading the text, however often its sections repeat.
    """
    n = len(DIMENSIONS)

    def sections(parts: Column) -> Column:
        inside, around = [parts[2 * i + 1] for i in range(n)], [parts[2 * i] for i in range(n + 1)]
        filled = F.lit(True)
        for part in inside:
            filled = filled & (part != "")
        for part in around:
            filled = filled & (part == "")
        return F.when(filled, F.struct(*[p.alias(d) for p, d in zip(inside, DIMENSIONS)]))

    def cut(state: Column) -> Column:
        tags = F.array_join(F.regexp_extract_all(state["text"], F.lit(_TAG), F.lit(0)), "")
        return F.when((F.size(state["parts"]) == 2 * n + 1) & F.rlike(tags, F.lit(_IN_ORDER)), once(F.transform(state["parts"], strip), sections))

    return once(F.struct(F.split(text, _TAG, -1).alias("parts"), text.alias("text")), cut)


def format_reward(text: Column) -> Column:
    return F.when(parse_completion(text).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))


def semantic_score(judgment: Column) -> Column:
    """Mean of the judge's dimensions over their maximum; a value outside 0..4 is an error."""
    total, fine = F.lit(0), F.lit(True)
    for d in DIMENSIONS:
        total = total + judgment[d]
        fine = fine & judgment[d].between(0, MAX_SCORE)
    score = total.cast("double") / float(len(DIMENSIONS) * MAX_SCORE)
    return F.when(judgment.isNotNull(), F.when(fine, score).otherwise(F.raise_error(F.lit("judge dimensions must be in 0..4")).cast("double")))


def check_coefficients(base: float, weight: float) -> None:
    if base < 0 or weight < 0:
        raise ValueError("reward coefficients cannot be negative")
    if abs(base + weight - 1.0) > 1e-9:
        raise ValueError("the format base and the semantic weight must sum to 1")


def combined_reward(format_score: Column, semantic: Column, base: float = 0.10, weight: float = 0.90) -> Column:
    """format x (base + weight x semantic); both scores must lie in 0..1."""
    check_coefficients(base, weight)
    fine = format_score.between(0.0, 1.0) & semantic.between(0.0, 1.0)
    value = format_score * (F.lit(float(base)) + F.lit(float(weight)) * semantic)
    return F.when(fine, value).otherwise(F.raise_error(F.lit("scores must be between 0 and 1")).cast("double"))


def judge_item(task: Column, rubric: dict[str, Column], response: Column) -> Column:
    return F.struct(task.alias("task"), *[rubric[r].alias(r) for r in RUBRIC], response.alias("student_response"))


def cache_key(item: Column, model: str, version: str = JUDGE_PROMPT_VERSION) -> Column:
    """Content address of a judge request: sha256 over JSON with fields in name order, nulls kept, a blank after commas and colons."""
    fields = [(n, json_list(item[n]) if n in RUBRIC else json_text(item[n])) for n in sorted([*RUBRIC, "student_response", "task"])]
    parts: list[Column] = []
    for n, value in fields:
        parts += [F.lit(f'{", " if parts else ""}"{n}": '), value]
    tail = f'}}, "model": {json.dumps(model, ensure_ascii=False)}, "prompt_version": {json.dumps(version, ensure_ascii=False)}}}'
    return F.sha2(F.concat(F.lit('{"item": {'), *parts, F.lit(tail)), 256)


def render_completion(record: dict[str, Column]) -> Column:
    """The four tagged sections of a reference work product; lists become bullet lines."""
    sections = []
    for d in DIMENSIONS:
        body = bullets(record[d]) if d in ("brainstorm", "principles") else record[d]
        sections.append(F.concat(F.lit(f"<{d}>\n"), body, F.lit(f"\n</{d}>")))
    return F.concat_ws("\n", *sections)
