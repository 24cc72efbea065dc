"""Places of rows in an order, without gathering them in one task.

A window without a partition sorts everything in one task.  Here rows are dealt into ranges of the order, each range is numbered
where it lies, and only counts per range (as many as there are partitions) meet on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files

_AT, _TIE = "_numbering_at", "_numbering_tie"


def _sorted(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in ranges of ``order``, with the range in the upper and the place in the range in the lower 33 bits of ``_AT``.

    Rows that are equal in the order are told apart by where they came from, so that many of them still make several ranges.
    """
    tied = rows.withColumn(_TIE, F.monotonically_increasing_id())
    keys = [*order, F.col(_TIE)]
    return tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_TIE).withColumn(_AT, F.monotonically_increasing_id())


def _place(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << 33) - 1))


def numbered(rows: DataFrame, order: Sequence[Column | str], *, name: str = "place", first: int = 1) -> DataFrame:
    """``rows`` with ``name``, their place in ``order`` counted from ``first``; places have no gaps, equal rows get places in any order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    lying = files.written(_sorted(rows, keys), "numbered")
    at, spark = F.col(_AT), rows.sparkSession
    counts = lying.groupBy(F.shiftright(at, 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    bases, total = [], first
    for r in sorted(counts, key=lambda r: r.range):
        bases.append((r.range, total))
        total += r.n
    base = spark.createDataFrame(bases, "_numbering_range bigint, _numbering_base bigint")
    placed = lying.join(F.broadcast(base), F.shiftright(at, 33) == F.col("_numbering_range"))
    return placed.withColumn(name, F.col("_numbering_base") + _place(at)).drop(_AT, "_numbering_range", "_numbering_base")


def numbered_within(rows: DataFrame, group: str, order: Sequence[Column | str], *, name: str = "place", ranged: str | None = None) -> DataFrame:
    """``rows`` with ``name``, their place from 1 among the rows of the same ``group`` (nulls are one group).

    A group may hold most of all rows: it is then numbered range by range.  ``ranged`` names a column for the range (a part of a group
    that fits a task), if one is wanted.
    """
    from pyspark.sql import Window

    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    lying = files.written(_sorted(rows, [F.col(group).asc_nulls_first(), *keys]), "numbered")
    spark, own = rows.sparkSession, F.shiftright(F.col(_AT), 33)
    part = lying.groupBy(own.alias("range"), F.col(group).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(_AT).alias("at"))
    # only the first group of a range can go on from the range before: one row per partition
    ends = part.groupBy("range").agg(F.min_by(F.struct("key", "n"), "at").alias("head"), F.max_by(F.struct("key", "n"), "at").alias("tail"), F.count(F.lit(1)).alias("groups"))
    bases, last, so_far = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r.range):
        base = so_far if last is not None and last[0] == r.head.key else 0
        if base:
            bases.append((r.range, r.head.key, base))
        last, so_far = (r.tail.key,), r.tail.n + (base if r.groups == 1 else 0)
    kind = lying.schema[group].dataType
    base = spark.createDataFrame(bases, T.StructType([T.StructField("_numbering_range", T.LongType()), T.StructField("_numbering_key", kind), T.StructField("_numbering_base", T.LongType())]))
    local = lying.withColumn("_numbering_own", own)
    place = F.row_number().over(Window.partitionBy("_numbering_own", group).orderBy(_AT)).cast("long")
    joined = local.withColumn(name, place).join(
        F.broadcast(base), (F.col("_numbering_own") == F.col("_numbering_range")) & F.col(group).eqNullSafe(F.col("_numbering_key")), "left"
    )
    done = joined.withColumn(name, F.col(name) + F.coalesce("_numbering_base", F.lit(0).cast("long")))
    if ranged:
        done = done.withColumn(ranged, F.col("_numbering_own"))
    return done.drop(_AT, "_numbering_own", "_numbering_range", "_numbering_key", "_numbering_base")
