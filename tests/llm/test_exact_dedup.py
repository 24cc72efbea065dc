import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as ed

SCHEMA = "doc_id bigint, text string"


def test_filter_has_no_false_negatives_and_few_false_positives():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 50, 1000, 150_000):
        keys = rnd.integers(0, 2**63, n, dtype=np.uint64)
        f = ed.build_filter(keys)
        assert ed.might_hold(keys, *f).all()
        others = rnd.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert ed.might_hold(others, *f).mean() < 0.02
    assert len(f[3]) < 1.35 * 150_000


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min(i for i in ids)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out)


def test_groups(spark):
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\nb", " a b", "x" * 50_000, "é\u00a0b"]
    rows = [(i, texts[i % len(texts)] if i % 4 else f"unique {i}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as keep_id", "'q' as bucket")
    for mark in (None, F.col("doc_id") < 0, F.col("doc_id") >= 0):
        got = ed.exact_dedup(df, mark, bucket_keys=40)
        assert sorted(map(tuple, got.collect())) == brute(rows)
    assert ed.exact_dedup(df.limit(0)).count() == 0


def test_snapshot_rows_stay_before_incoming(spark):
    df = spark.createDataFrame([(1, "same"), (9, "same"), (5, "other"), (2, "other")], SCHEMA)
    got = {r.doc_id: r.keep_id for r in ed.exact_dedup(df, F.col("doc_id").isin(9, 5)).collect()}
    assert got == {1: 9, 9: 9, 5: 5, 2: 5}


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "a  b"), (1, "a b"), (None, "c"), (None, "c"), (None, "alone"), (2, "d"), (2, "e"), (9, "d"), (8, "e"), (2, "d")]
    got = [tuple(r)[:4] for r in ed.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(None, 1, 2, False), (1, 1, 2, True), (None, None, 2, True), (None, None, 2, True), (None, None, 1, True)]
    want += [(2, 2, 3, True), (2, 2, 3, True), (9, 2, 3, False), (2, 2, 2, True), (8, 2, 2, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_an_id_with_several_texts_in_any_order(spark):
    rows = [(1, "other text"), (1, "aaa bbb"), (9, "aaa  bbb"), (10, "zzz"), (9, "zzz")]
    want = [(1, 1, 1, True), (1, 1, 2, True), (9, 1, 2, False), (9, 9, 2, True), (10, 9, 2, False)]
    for some in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = ed.exact_dedup(spark.createDataFrame(some, SCHEMA).coalesce(1))
        assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    none = spark.createDataFrame([(7, "x"), (None, "x"), (None, "y"), (None, "y")], SCHEMA)
    got = [tuple(r)[:4] for r in ed.exact_dedup(none).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, 2, True), (None, 7, 2, False), (None, None, 2, True), (None, None, 2, True)], key=str)


def test_three_batches_against_stored_snapshots(spark, tmp_path):
    folder = str(tmp_path / "kept")
    batches = [
        [(5, "a"), (6, "a"), (7, "b  b"), (None, "n")],
        [(1, "a"), (2, "b b"), (3, "c"), (4, "c"), (8, None)],
        [(5, "a"), (9, "c"), (10, "d"), (11, ""), (12, "n")],
    ]
    want = [
        [(5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True), (None, None, 1, True)],
        [(1, 5, 2, False), (2, 7, 2, False), (3, 3, 2, True), (4, 3, 2, False), (8, 8, 1, True)],
        [(5, 5, 2, False), (9, 3, 2, False), (10, 10, 1, True), (11, 8, 2, False), (12, None, 2, False)],
    ]
    for rows, right in zip(batches, want):
        out = ed.take_in(spark.createDataFrame(rows, SCHEMA), folder, bucket_keys=2).collect()
        assert sorted((tuple(r)[:4] for r in out), key=str) == sorted(right, key=str)
    assert [p.rsplit("/", 1)[1] for p in ed.snapshots(spark, folder)] == ["0", "1", "2"]
    assert ed.take_in(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert ed.take_in(spark.createDataFrame([(20, "d")], SCHEMA), folder).first().keep_id == 10


def test_a_batch_that_is_tried_again_has_the_same_result(spark, tmp_path):
    folder = str(tmp_path / "kept")
    batches = [[(1, "a"), (2, "b")], [(3, "a"), (4, "c"), (5, "c")], [(6, "c"), (7, "d")]]
    run = lambda k: sorted(tuple(r)[:4] for r in ed.take_in(spark.createDataFrame(batches[k], SCHEMA), folder, batch_id=k).collect())
    first = [run(0), run(0), run(1), run(1), run(2)]
    assert first[0] == first[1] == [(1, 1, 1, True), (2, 2, 1, True)]
    assert first[2] == first[3] == [(3, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False)]
    assert [run(0), run(1), run(2)] == [first[0], first[2], first[4]] and first[4] == [(6, 4, 2, False), (7, 7, 1, True)]
    assert len(ed.snapshots(spark, folder)) == 3


def test_sql_of_the_query(spark):
    import duckdb

    from tessera.llm.queries import SQL, op5_exact_dedup

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({SQL['op5_exact_dedup']})").fetchall()
    assert sorted(map(tuple, op5_exact_dedup(spark, d).collect())) == sorted(want)
