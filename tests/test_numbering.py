import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import quotas
from tessera.operators.numbering import numbered, numbered_within


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges stay apart, so that places go on from range to range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_places_have_no_gaps_and_no_single_task(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([1, 1, 1, 5, None]), rnd.random()) for k in range(5000)]
    df = spark.createDataFrame(rows, "k long, g long, v double").repartition(7)
    got = numbered(df, ["v", "k"], first=0)
    assert "SinglePartition" not in plan(got)
    ranked = sorted(rows, key=lambda r: (r[2], r[0]))
    assert {r.k: r.place for r in got.collect()} == {r[0]: i for i, r in enumerate(ranked)}
    assert sorted(r.place for r in numbered(df.withColumn("same", F.lit(1)), ["same"]).collect()) == list(range(1, 5001))
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_places_in_groups_of_any_size(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([1, 1, 1, 1, 5, 6, None]), rnd.choice([0.0, 0.5, rnd.random()])) for k in range(4000)] + [(k, k, 1.0) for k in range(4000, 4500)]
    df = spark.createDataFrame(rows, "k long, g long, v double").repartition(9)
    got = numbered_within(df, "g", [F.col("v").desc(), "k"], ranged="part")
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    want = {k: i for ks in groups.values() for i, k in enumerate(ks, 1)}
    out = got.collect()
    assert {r.k: r.place for r in out} == want
    assert len({r.part for r in out if r.g == 1}) > 1  # the large group lies in several ranges


def test_batches_of_a_whole_table(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as paper_id", "1000 - id as stream_idx")
    got = quotas.batches(df, 8)
    assert "SinglePartition" not in plan(got)
    assert {(r.paper_id, r.batch, r.place) for r in got.collect()} == {(str(999 - i), i // 8, i % 8) for i in range(1000)}
    assert quotas.batches(df, 8, 30).count() == 30
