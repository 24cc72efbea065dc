"""Training projections, leak guards and split checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import completions, drafts, prompts
from tessera.schemas import DRAFT, RUBRIC

SFT_FORBIDDEN = ("source_text", "required_constraints")
RL_FORBIDDEN = ("source_text", "completion", "answer", "brainstorm", "principles")
SPLIT_NAMES = {"sft_train": "train", "sft_validation": "validation", "grpo_train": "train", "grpo_validation": "validation", "test": "test"}


def public_split(split: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SPLIT_NAMES.items() for x in pair])
    return F.try_element_at(names, split)


def sft_rows(records: DataFrame) -> DataFrame:
    """Prompt and reference completion; no rubric, no source text."""
    rendered = completions.render_completion({c: F.col(c) for c in ("brainstorm", "principles", "synthesis", "answer")})
    return records.where(F.col("split").isin("sft_train", "sft_validation")).select(
        public_split(F.col("split")).alias("split"), "task_id", "paper_id", "task_family", prompts.task_prompt(F.col("task")).alias("prompt"),
        F.array(prompts.message("assistant", rendered)).alias("completion"), "source_license", "source_url",
    )


def rl_rows(records: DataFrame) -> DataFrame:
    """Prompt and hidden rubric; no reference completion, no source text."""
    return records.where(F.col("split").isin("grpo_train", "grpo_validation", "test")).select(
        public_split(F.col("split")).alias("split"), "task_id", "paper_id", "task_family", prompts.task_prompt(F.col("task")).alias("prompt"),
        "task", *RUBRIC, "source_license", "source_url",
    )


def render_chat(table: DataFrame, template: Callable[[list[dict]], str], end: str = "") -> DataFrame:
    """One ``text`` per row from its prompt and completion messages, closed by ``end``; ``split`` stays, other columns go.

    ``template`` is a chat template, a function of all messages; texts that end with ``end`` already get no second one.
    """

    def run(batches):
        for pdf in batches:
            texts = []
            for prompt, completion in zip(pdf["prompt"], pdf["completion"]):
                text = template([dict(m) for part in (prompt, completion) if part is not None for m in part])
                texts.append(text if not end or text.endswith(end) else text + end)
            yield pd.DataFrame({"split": pdf["split"], "text": texts})

    messages = "array<struct<role:string,content:string>>"
    rows = table.select("split", F.col("prompt").cast(messages).alias("prompt"), F.col("completion").cast(messages).alias("completion"))
    return rows.mapInPandas(run, "split string, text string")


def guard_columns(table: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    leaked = sorted(set(forbidden) & set(table.columns))
    if leaked:
        raise RuntimeError(f"the projection leaks {', '.join(leaked)}")
    return table


def missing_columns(table: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(table.columns))


def require_splits(table: DataFrame, splits: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Required columns exist and every required split has rows."""
    if missing := missing_columns(table, [*columns, "split"]):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    present = {r[0] for r in table.select("split").distinct().collect()}
    if absent := sorted(set(splits) - present):
        raise ValueError(f"missing or empty splits: {', '.join(absent)}")
    return table


def split_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def wrong_sizes(table: DataFrame, expected: Mapping[str, int]) -> dict[str, tuple[int, int]]:
    """Splits whose row count differs from what is expected: {split: (rows, expected)}."""
    rows = {r.split: r.n for r in split_sizes(table).collect()}
    return {s: (rows.get(s, 0), expected.get(s, 0)) for s in {*rows, *expected} if rows.get(s, 0) != expected.get(s, 0)}


def accepted_rows(drafted: DataFrame) -> DataFrame:
    """Canonical rows from a source, its draft, its review and the request.

    ``drafted`` has the excerpt columns and draft, review, teacher, critic, requested_split,
    requested_task_family.  The requested family wins over the draft's own.
    """
    body = [f.name for f in DRAFT.fields if f.name not in ("usable", "rejection_reason", "task_family")]
    excerpt = [c for c in drafted.columns if c.startswith("source_") or c in ("paper_id", "title")]
    review = {f: F.col(f"review.{f}") for f in drafts.REVIEW_FLAGS}
    drafted = with_errors(drafted)
    good = (F.size("_errors") == 0) & drafts.review_accepts(review)
    identity = drafts.task_id(F.col("requested_split"), F.col("requested_task_family"), F.col("paper_id"), F.col("source_sha256"))
    return drafted.where(good).select(
        identity.alias("task_id"), *excerpt, F.col("requested_split").alias("split"), *[F.col(f"draft.{b}").alias(b) for b in body],
        F.col("requested_task_family").alias("task_family"), "teacher", "critic", "review", F.lit(drafts.PROMPT_VERSION).alias("prompt_version"),
    )


def errors(drafted: DataFrame) -> Column:
    return drafts.draft_errors({f.name: F.col(f"draft.{f.name}") for f in DRAFT.fields}, F.col("requested_task_family"))


def with_errors(drafted: DataFrame) -> DataFrame:
    """Rows with their validation messages as ``_errors``, unless they have them."""
    return drafted if "_errors" in drafted.columns else drafted.withColumn("_errors", errors(drafted))


def rejected_rows(drafted: DataFrame) -> DataFrame:
    """Rejections of both stages in one shape; a review that was never asked for is null."""
    excerpt = [c for c in drafted.columns if c.startswith("source_") or c in ("paper_id", "title")]
    review = {f: F.col(f"review.{f}") for f in drafts.REVIEW_FLAGS}
    rows = with_errors(drafted).withColumn("_valid", F.size("_errors") == 0)
    turned_down = ~F.col("_valid") | ~drafts.review_accepts(review)
    only = lambda c: F.when(F.col("_valid"), F.col(c))
    return rows.where(turned_down).select(
        *excerpt, "requested_split", "requested_task_family",
        F.when(F.col("_valid"), "critic").otherwise("teacher_validation").alias("stage"), F.lit(drafts.PROMPT_VERSION).alias("prompt_version"),
        F.when(F.col("_valid"), F.array(drafts.review_reason(F.col("review.critique")))).otherwise(F.col("_errors")).alias("reasons"),
        "teacher", only("critic").alias("critic"), "draft", only("review").alias("review"),
    )
