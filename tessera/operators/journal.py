"""Accepted and rejected journals: union, resume, compatibility."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both journals as one bag; columns that one lacks are null."""
    return accepted.unionByName(rejected, allowMissingColumns=True)


def completed(sources: DataFrame, *journals: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Ids of sources that were attempted, whatever came of it.  ``retry_errors`` leaves failed calls out."""
    ids = None
    for journal in journals:
        if retry_errors and "stage" in journal.columns:
            journal = journal.where(~F.col("stage").eqNullSafe("api_error"))
        part = journal.select("paper_id")
        ids = part if ids is None else ids.unionByName(part)
    return ids.distinct().join(sources.select("paper_id"), "paper_id", "left_semi")


def remaining(sources: DataFrame, *journals: DataFrame, retry_errors: bool = False) -> DataFrame:
    return sources.join(completed(sources, *journals, retry_errors=retry_errors), "paper_id", "left_anti")


def within_budget(sources: DataFrame, max_attempts: int, *journals: DataFrame, order: str = "stream_idx") -> DataFrame:
    """Remaining sources in pool order, as many as the attempt budget still allows."""
    used = completed(sources, *journals).count()
    return remaining(sources, *journals).orderBy(order).limit(max(int(max_attempts) - used, 0))


def exclude(sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sources whose paper is not in ``excluded``; the optimizer picks the join by size."""
    return sources.join(excluded.select("paper_id").distinct(), "paper_id", "left_anti")


def overlap(*tables: DataFrame) -> DataFrame:
    """Paper ids that all tables share; disjointness means no rows."""
    first, *rest = [t.select("paper_id") for t in tables]
    for other in rest:
        first = first.intersect(other)
    return first.distinct()


def violations(
    journal: DataFrame, *, prompt_version: str, dataset: str, split_name: str, splits: Iterable[str], families: Iterable[str], teacher: str, critic: str
) -> DataFrame:
    """One row: how many journal rows break each compatibility rule."""
    columns = set(journal.columns)
    col = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(c, F.lit("")).isNotNull()
    pick = lambda a, b: F.coalesce(F.nullif(col(a), F.lit("")), col(b))
    model = lambda meta: F.col(f"{meta}.model") if meta in columns else F.lit(None).cast("string")
    split, family = pick("split", "requested_split"), pick("task_family", "requested_task_family")
    rules = {
        "prompt_version": filled(col("prompt_version")) & (col("prompt_version") != prompt_version),
        "source_dataset": col("source_dataset").isNotNull() & (col("source_dataset") != dataset),
        "source_split": col("source_split").isNotNull() & (col("source_split") != split_name),
        "split": filled(split) & ~split.isin(*splits),
        "task_family": filled(family) & ~family.isin(*families),
        "teacher_model": filled(model("teacher")) & (model("teacher") != teacher),
        "critic_model": filled(model("critic")) & (model("critic") != critic),
    }
    return journal.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def require_compatible(journal: DataFrame, **expected: Any) -> None:
    broken = [name for name, n in violations(journal, **expected).first().asDict().items() if n]
    if broken:
        raise RuntimeError(f"the existing journal does not fit this run ({', '.join(broken)}); choose a new output name and paths")


def decreased_targets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that both tables have and whose target went down: (name, old, new)."""
    return old.select("name", F.col("target").alias("old")).join(new.select("name", F.col("target").alias("new")), "name").where("new < old")


def decreased(old: Mapping[str, int], new: Mapping[str, int]) -> dict[str, tuple[int, int]]:
    return {k: (old[k], v) for k, v in new.items() if k in old and v < old[k]}
