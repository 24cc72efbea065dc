"""Audits of pools, curricula and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def acceptance_rate(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """accepted / max(all attempts, 1)."""
    a = accepted.agg(F.count(F.lit(1)).alias("accepted"))
    r = rejected.agg(F.count(F.lit(1)).alias("rejected"))
    return a.crossJoin(r).select("accepted", "rejected", (F.col("accepted") / F.greatest(F.col("accepted") + F.col("rejected"), F.lit(1))).alias("rate"))


def license_provenance(pool: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent licences; ties by name."""
    return pool.groupBy("source_license").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_license").limit(top)


def curriculum(records: DataFrame) -> DataFrame:
    """Rows and average lengths per split and family."""
    return records.groupBy("split", "task_family").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("task")).alias("avg_task_chars"),
        F.avg(F.size("brainstorm")).alias("avg_ideas"), F.avg(F.size("principles")).alias("avg_principles"),
    )


def rubric_depth(records: DataFrame, x: str = "required_constraints", y: str = "evaluation_criteria") -> DataFrame:
    return records.groupBy("task_family", F.size(x).cast("long").alias("x"), F.size(y).cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def length_histogram(lengths: DataFrame, bins: int = 25, limit: int = 1024) -> DataFrame:
    """Equal-width bins per split over (split, length), and how many rows pass ``limit``."""
    bounds = lengths.groupBy("split").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("length") - F.col("low")) / width), F.lit(bins - 1)))
    return lengths.join(F.broadcast(bounds), "split").groupBy("split", at.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") > limit).alias("over")
    )


def reward_history(log: DataFrame) -> DataFrame:
    """Rows of a trainer's log that have a step and any reward or evaluation metric, with just those columns."""
    metrics = [c for c in log.columns if c == "reward" or (c.startswith("rewards/") and c.endswith("/mean")) or c.startswith("eval_")]
    return log.select("step", *[F.col(f"`{c}`") for c in metrics]).na.drop(subset=["step"]).na.drop(how="all", subset=[f"`{c}`" for c in metrics])


def smoke_subset(table: DataFrame, sizes: dict[str, int], order: str = "task_id") -> DataFrame:
    """The first rows of every split; a constant bound lets partitions drop the rest early."""
    limit = F.lit(0)
    for split, n in sizes.items():
        limit = F.when(F.col("split") == split, n).otherwise(limit)
    own = Window.partitionBy("split").orderBy(order)
    return table.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= max(sizes.values())).where(F.col("_n") <= limit).drop("_n")


def lookup_reference(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The canonical record behind each projected row, by task id."""
    return rows.select("task_id").join(records, "task_id")
