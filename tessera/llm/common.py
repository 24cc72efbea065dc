"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular-expression class body.
WS = r"\x20\x09-\x0D"


_LEAVING: set[str] = set()  # folders that are deleted when the driver ends


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none on a single machine (tests) a local folder is set; a cluster's executors would each
    write to their own disk, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, columnar
    and compressed, and survives the loss of any executor.

    The files lie in a folder of the application, which goes when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"
    if folder not in _LEAVING:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _LEAVING.add(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(col):
    """Number of runs of non-white-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows, so that a worker holds few long texts or images at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


HEAVY = 10_000  # keys that a look-up broadcasts at most


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], total: int, weight: str, heavy: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has a key once, and in ``weight`` at least the number of rows that ask for it.

    Weights add up to ``total`` at most, so no more than ``heavy`` (HEAVY) keys reach a share of 1/heavy; these are broadcast and the rows that
    meet them are spread out, the others are joined by key, none of which has more than that share.
    """
    bound, values = max(2, -(-total // (heavy or HEAVY))), [c for c in table.columns if c not in keys]
    hot = table.where(F.col(weight) >= bound).select(*[F.col(c).alias(f"_hot_{c}") for c in table.columns], F.lit(True).alias("_hot"))
    rest = table.where(F.col(weight) < bound).select(*[F.col(c).alias(f"_rest_{c}") for c in table.columns], F.lit(False).alias("_rest"))
    same = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    met = rows.join(F.broadcast(hot), same, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    met = met.withColumn("_spread", F.when(F.col("_hot"), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*keys)))
    rest = rest.withColumn("_rest_spread", F.xxhash64(*[f"_rest_{k}" for k in keys]))
    same = [F.col("_spread") == F.col("_rest_spread"), F.col("_hot") == F.col("_rest"), *[F.col(k) == F.col(f"_rest_{k}") for k in keys[1:]]]
    exact = F.col(keys[0]) == F.col(f"_rest_{keys[0]}")
    joined = met.join(rest, [*same, exact], "left")
    return joined.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_rest_{v}")).alias(v) for v in values])
