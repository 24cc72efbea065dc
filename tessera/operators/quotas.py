"""Quota tables, their status, exact trimming and slot planning."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.drafts import TASK_FAMILIES
from tessera.operators.numbering import numbered
from tessera.schemas import QUOTA

CELL = ["split", "task_family"]


def check_quotas(targets: Mapping[str, int], weights: Mapping[str, float]) -> None:
    if not targets or any(int(t) < 0 for t in targets.values()):
        raise ValueError("split targets must be a non-empty mapping of non-negative counts")
    if set(weights) != set(TASK_FAMILIES):
        raise ValueError(f"weights must name exactly these families: {', '.join(TASK_FAMILIES)}")
    if any(float(w) < 0 for w in weights.values()) or sum(map(float, weights.values())) <= 0:
        raise ValueError("family weights must be non-negative with a positive sum")


def allocate(split_targets: DataFrame, family_weights: DataFrame) -> DataFrame:
    """Largest-remainder allocation: (split, task_family, target).

    ``split_targets`` is (split, target), ``family_weights`` (task_family, weight); both are configuration.
    Leftover units of a split go to the largest fractions, ties by family name.
    """
    share = F.col("target") * F.col("weight") / F.sum("weight").over(Window.partitionBy("split"))
    grid = split_targets.crossJoin(F.broadcast(family_weights)).select("split", "task_family", "target", share.cast("double").alias("raw"))
    grid = grid.withColumn("whole", F.floor("raw").cast("long"))
    by_fraction = Window.partitionBy("split").orderBy((F.col("raw") - F.col("whole")).desc(), "task_family")
    spare = F.col("target") - F.sum("whole").over(Window.partitionBy("split"))
    return grid.select(
        "split", "task_family", (F.col("whole") + (F.row_number().over(by_fraction) <= spare).cast("long")).alias("target")
    )


def quota_table(spark: SparkSession, targets: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    check_quotas(targets, weights)
    splits = spark.createDataFrame([(s, int(t)) for s, t in targets.items()], "split string, target bigint")
    return allocate(splits, spark.createDataFrame([(f, float(w)) for f, w in weights.items()], "task_family string, weight double"))


def family_counts(records: DataFrame) -> DataFrame:
    """Rows per cell; a null key reads ``None``."""
    key = [F.coalesce(c, F.lit("None")).alias(c) for c in CELL]
    return records.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def progress(records: DataFrame, quotas: DataFrame) -> DataFrame:
    """Every quota cell with what is observed, what counts and what is missing."""
    seen = family_counts(records)
    observed = F.coalesce("n", F.lit(0)).cast("long")
    return quotas.join(seen, CELL, "left").select(
        *CELL, "target", observed.alias("observed"), F.least(observed, "target").alias("counted"),
        F.greatest(F.col("target") - observed, F.lit(0).cast("long")).alias("deficit"),
    )


def quota_status(records: DataFrame, quotas: DataFrame) -> DataFrame:
    return progress(records, quotas).agg(
        F.sum("target").alias("target_total"), F.sum("counted").alias("accepted_total"), F.bool_and(F.col("deficit") == 0).alias("complete")
    )


def quota_deficits(records: DataFrame, quotas: DataFrame) -> DataFrame:
    return progress(records, quotas).where("deficit > 0").select(*CELL, "deficit")


def trim(records: DataFrame, quotas: DataFrame) -> DataFrame:
    """The first ``target`` rows of every quota cell, by task id, then paper id.

    The largest target, one number, bounds the rank with a constant so that each partition keeps only
    that many rows of a cell before the shuffle.
    """
    most = quotas.agg(F.max("target")).first()[0] or 0
    order = Window.partitionBy(*CELL).orderBy(F.coalesce("task_id", F.lit("")), F.coalesce("paper_id", F.lit("")))
    ranked = records.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= int(most))
    cells = F.broadcast(quotas.withColumnRenamed("target", "_target"))
    return ranked.join(cells, CELL).where("_rank <= _target").drop("_rank", "_target")


def planned_slots(records: DataFrame, quotas: DataFrame, limit: int) -> DataFrame:
    """The next ``limit`` units to fill: (slot, split, task_family), most underfilled cells first."""
    open_cells = progress(records, quotas).where("counted < target")
    units = open_cells.select(*CELL, "target", F.explode(F.sequence(F.col("counted"), F.col("target") - 1)).alias("ordinal"))
    units = units.withColumn("fill", F.col("ordinal") / F.col("target"))
    keys = ["fill", *CELL, "ordinal"]
    head = units.orderBy(*keys).limit(limit)
    return head.withColumn("slot", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("slot", *CELL)


def next_slots(targets: Mapping[tuple[str, str], int], counts: Mapping[tuple[str, str], int], limit: int) -> list[tuple[str, str]]:
    """``planned_slots`` from targets and counts per cell that a driver holds: (split, task_family) of each slot."""
    units = ((n / target, *cell, n) for cell, target in targets.items() for n in range(min(counts.get(cell, 0), target), target))
    return [(split, family) for _, split, family, _ in heapq.nsmallest(limit, units)]


def assign(sources: DataFrame, slots: DataFrame, order: str = "stream_idx") -> DataFrame:
    """Pair the next sources with the slots, in order; one micro-batch, so at most as many rows as slots."""
    n = slots.count()
    head = sources.orderBy(order).limit(n)
    numbered = head.withColumn("slot", F.row_number().over(Window.orderBy(order)).cast("long"))
    return numbered.join(F.broadcast(slots), "slot")


def batches(sources: DataFrame, concurrency: int, limit: int | None = None, order: str = "stream_idx") -> DataFrame:
    """Number the next ``limit`` sources, all of them unless it is given, into batches of ``concurrency``: (paper_id, batch, place)."""
    head = sources.select("paper_id", order) if limit is None else sources.select("paper_id", order).orderBy(order).limit(limit)
    at = F.col("_at")
    placed = numbered(head, [order, "paper_id"], name="_at", first=0)
    return placed.select("paper_id", F.expr(f"_at div {int(concurrency)}").alias("batch"), (at % int(concurrency)).alias("place"))
