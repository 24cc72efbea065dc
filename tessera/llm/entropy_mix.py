"""Mixing sources to target weights by entropy balancing.

Targets: sources (by code point, null last) take the weights in turn and share ``budget``
times all tokens; a target stops at ``cap`` times its source's size and the excess is
reshared by weight (water-filling).

Rates: among all non-negative rates r_i <= cap that meet every source's token constraint
sum_i r_i * size_i = target, those closest to uniform in relative entropy are exponential
tilts r_i = min(cap, exp(lambda_s * x_i)) with x_i = size_i / mean size of the source.  The convex
dual falls apart by source; safeguarded Newton steps on all lambdas run together, each step one
pass that sums value and slope per source, with partial sums before the shuffle.  Sums are
of fixed-point integers, so they, the lambdas and the mix do not depend on task order.

Rounding: sources are cut into blocks of about ``block_rows`` documents by a hash of the id
(so a source with a third of all rows is many blocks).  Inside a block documents go from
large to small and each rate becomes the whole number next below or above it that keeps the
running token sum closest to its due; what a large document leaves over, smaller ones mend.  What is left at the end is
settled by the block's smallest documents: among all sums that ``MENDED`` of them can reach with 0 to ``cap`` copies, the one closest
to the block's due is taken, and a document keeps its copies where that sum allows it.

Defined results: null text has size 0 and is never taken, nor is any text without words; texts of any length are counted whole; a
source without tokens has target 0; the null source is a source of its own, the last one; equal sizes are ordered by a hash of the
id, then by id; repeated rows, and rows without an id or with a repeated one, are rows of their own; other columns, whatever their
names, are not read; an empty table gives an empty result; a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, word_count

MENDED = 40  # smallest documents of a block that settle its rest
FIXED = 1 << 20  # fixed-point unit of the dual's sums


def ranked(values: DataFrame, col: str) -> DataFrame:
    """Add ``rank`` (from 0; code-point order, null last) without gathering all rows in one task.

    ``values`` holds each value once.  Range partitions are counted, and only one number per
    partition comes to the driver.
    """
    parts = materialize(
        values.repartitionByRange(F.col(col).isNull(), F.col(col)).withColumn("_p", F.spark_partition_id())
    )
    counts = sorted((r[0], r[1]) for r in parts.groupBy("_p").count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return values.withColumn("rank", F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])
    order = Window.partitionBy("_p").orderBy(F.col(col).isNull(), F.col(col))
    return parts.withColumn("rank", F.element_at(starts, F.col("_p").cast("long")) + F.row_number().over(order) - 1).drop("_p")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, docs, weight, target) from per-source sums (source, source_size, docs).

    A handful of numbers per round comes to the driver; sources stay distributed.
    """
    table = ranked(sizes, "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(table.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * F.lit(float(cap))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, level = float(budget) * total, 0.0
    full = F.lit(False)
    while True:
        filled, free = table.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if free <= 0:
            break
        level = max(level, (left - filled) / free)
        now = limit < F.col("weight") * F.lit(level)
        if not table.where(now & ~full).limit(1).count():
            break
        full = now
    target = F.when(full, limit).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "docs", "weight", F.least(target, limit).alias("target"))


def newton_rates(docs: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-5, max_steps: int = 40) -> DataFrame:
    """lambda of every source: (source, lam).

    ``docs`` has (source, size, n): how many documents of a source have a size, so a step's
    cost follows the distinct sizes, not the documents.
    """
    start = targets.select(
        "source", "target", "source_size", "docs",
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        (F.col("target") >= F.col("source_size") * F.lit(float(cap))).alias("done"),  # all at the cap: no lambda to find
    )
    state = materialize(start)
    for _ in range(max_steps):
        x = F.col("size") * F.col("docs") / F.col("source_size")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(raw, F.lit(float(cap)))
        slope = F.when(raw < cap, raw * x).otherwise(0.0)
        fixed = lambda v: F.sum(F.round(F.col("n") * F.col("size") * v * FIXED).cast("decimal(38,0)"))
        sums = (
            docs.where("size > 0")
            .join(state.where(~F.col("done")), docs["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"].alias("source"))
            .agg((fixed(rate).cast("double") / FIXED).alias("value"), (fixed(slope).cast("double") / FIXED).alias("slope"))
        )
        joined = state.alias("s").join(sums.alias("v"), F.col("s.source").eqNullSafe(F.col("v.source")), "left")
        gap = F.col("value") - F.col("target")
        near = F.abs(gap) <= F.lit(tolerance) * F.greatest(F.col("target"), F.lit(1.0))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # outside the bracket, or without a slope, halve the bracket; without one, go outward
        middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(gap < 0, 2 * F.col("lam") + 1).otherwise(2 * F.col("lam") - 1)
        inside = (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        moved = F.when(F.coalesce(inside, F.lit(False)), step).otherwise(middle)
        stop = F.col("s.done") | F.col("value").isNull() | near | (moved == F.col("lam"))
        last, state = state, materialize(
            joined.select(
                F.col("s.source").alias("source"), "target", "source_size", "docs",
                F.when(stop, F.col("lam")).otherwise(moved).alias("lam"), low.alias("low"), high.alias("high"), stop.alias("done"),
            )
        )
        discard(last)
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select("source", "lam")


def round_block(pdf: pd.DataFrame, cap: float) -> np.ndarray:
    """Whole copies for one block's documents, in the order of its rows; largest go first."""
    order = np.lexsort((pdf["doc_id"].fillna("").to_numpy(str), pdf["mix"].to_numpy(), -pdf["size"].to_numpy()))
    size, rate = pdf["size"].to_numpy()[order], pdf["rate"].to_numpy()[order]
    due, copies, taken = np.cumsum(size * rate), np.zeros(len(size), np.int64), 0
    whole = np.floor(rate).astype(np.int64)
    for i, (s, w) in enumerate(zip(size.tolist(), whole.tolist())):
        if s:
            take = w + (1 if rate[i] > w and w + 1 <= cap and abs(due[i] - taken - (w + 1) * s) < abs(due[i] - taken - w * s) else 0)
            copies[i] = take
            taken += take * s
    mend(size, copies, float(due[-1]) if len(due) else 0.0, int(cap))
    out = np.empty_like(copies)
    out[order] = copies
    return out


def mend(size: np.ndarray, copies: np.ndarray, due: float, cap: int) -> None:
    """Change copies of the smallest documents so that the block's sum is as close to ``due`` as they allow."""
    some = np.flatnonzero(size > 0)
    some = some[np.argsort(size[some], kind="stable")][:MENDED]
    some = some[np.cumsum(size[some]) <= 1 << 22]  # a bit for every sum: a megabyte at most
    rest = due - float((size * copies).sum())
    if not len(some) or abs(rest) <= 0.5:
        return
    # sums as bits of a number: bit k of reach[i] is set if the first i documents can make k
    reach = [1]
    for s in size[some].tolist():
        now = reach[-1]
        for _ in range(cap):
            now |= now << s | reach[-1]
        reach.append(now)
    want = rest + float((size[some] * copies[some]).sum())
    top = reach[-1].bit_length() - 1
    low = min(max(int(np.floor(want)), 0), top)
    down = (reach[-1] & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> (low + 1)
    up = low + (above & -above).bit_length() if above else None
    total = down if up is None or want - down <= up - want else up
    for i in range(len(some) - 1, -1, -1):
        s, had = int(size[some[i]]), int(copies[some[i]])
        for k in sorted(range(cap + 1), key=lambda k: (abs(k - had), k)):
            left = total - k * s
            if left >= 0 and reach[i] >> left & 1:
                copies[some[i]], total = k, left
                break


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_rows: int = 1_000,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = materialize(source_targets(sums, weights, budget, cap))
    histogram = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    lams = newton_rates(histogram, targets, cap)
    plan = materialize(targets.alias("t").join(lams.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source"))).select("t.*", "lam"))
    x = F.col("size") * F.col("docs") / F.col("source_size")
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.least(F.col("lam") * x, F.lit(50.0))), F.lit(float(cap)))).otherwise(0.0)
    rated = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select(
            "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target",
            F.when(F.col("target") >= F.col("source_size") * cap, F.when(F.col("size") > 0, float(cap)).otherwise(0.0)).otherwise(F.round(rate, 9)).alias("rate"),
            F.xxhash64("doc_id").alias("mix"),
            F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.ceil(F.col("docs") / block_rows)).alias("block"),
        )
    )
    # ids go round pandas as text: it would make floats of longs beside a missing one
    kind = rated.schema["doc_id"].dataType
    rated = rated.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = rated.select("doc_id", "source", "size", "source_size", "target", "rate").schema
    out = schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", copies bigint"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["doc_id", "source", "size", "source_size", "target", "rate"]].assign(copies=round_block(pdf, cap))

    filled = rated.groupBy("source", "block").applyInPandas(fill, out)
    return filled.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("taken", F.col("copies") * F.col("size"))
