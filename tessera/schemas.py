"""Declared record types; nothing is inferred on the way in or out."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def strings(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, STR) for n in names]


def lists(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, T.ArrayType(STR)) for n in names]


RUBRIC = ("required_constraints", "evaluation_criteria", "acceptable_alternatives", "failure_modes")
DIMENSIONS = ("brainstorm", "principles", "synthesis", "answer")
REVIEW_FLAGS = (
    "accept", "task_is_self_contained", "task_does_not_reference_source", "task_is_qualitative_not_numerical",
    "brainstorm_is_diverse_and_plausible", "principles_are_scientifically_supported", "synthesis_is_coherent",
    "answer_is_supported", "rubric_allows_valid_alternatives",
)

RAW_SOURCE = struct(*strings("id", "paper_id", "text", "raw_fulltext", "metadata", "license", "source", "title"))
EXCERPT = struct(*strings(
    "paper_id", "title", "source_text", "source_dataset", "source_split", "source_url", "source_license",
    "source_license_normalized", "source_sha256",
))
DRAFT = struct(
    ("usable", BOOL), *strings("rejection_reason", "task_family", "task"), *lists("brainstorm", "principles"),
    *strings("synthesis", "answer"), *lists(*RUBRIC),
)
REVIEW = struct(*[(f, BOOL) for f in REVIEW_FLAGS], ("critique", STR))
USAGE = struct(("input_tokens", LONG), ("output_tokens", LONG), ("total_tokens", LONG))
CALL_META = struct(("response_id", STR), ("model", STR), ("usage", USAGE))
MESSAGES = T.ArrayType(struct(*strings("role", "content")))
TASK_BODY = [*strings("task"), *lists("brainstorm", "principles"), *strings("synthesis", "answer"), *lists(*RUBRIC)]
ACCEPTED = T.StructType(
    struct(*strings("task_id")).fields + EXCERPT.fields
    + struct(
        ("split", STR), *TASK_BODY, ("task_family", STR), ("teacher", CALL_META), ("critic", CALL_META), ("review", REVIEW), ("prompt_version", STR),
    ).fields
)
REJECTED = T.StructType(
    EXCERPT.fields
    + struct(
        *strings("requested_split", "requested_task_family", "stage", "prompt_version"), *lists("reasons"),
        ("teacher", CALL_META), ("critic", CALL_META), ("draft", DRAFT), ("review", REVIEW),
    ).fields
)
JUDGE_ITEM = struct(("task", STR), *lists(*RUBRIC), ("student_response", STR))
JUDGMENT = struct(*[(d, T.IntegerType()) for d in DIMENSIONS], ("brief_reason", STR))
MEMO = struct(("cache_key", STR), ("prompt_version", STR), ("request", JUDGE_ITEM), ("judgment", JUDGMENT), ("response", CALL_META), ("seq", LONG))
QUOTA = struct(("split", STR), ("task_family", STR), ("target", LONG))
CHECK = struct(*strings("name", "status", "detail"))
