import itertools
import math
import re

import numpy as np
import pytest

from tessera.llm import entropy_mix

SCHEMA = "doc_id bigint, source string, text string"


def targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = budget * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if cap * sizes[s] < w[s] * level - 1e-9}
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(spark, rows, weights=(5, 2, 1), **kw):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = entropy_mix.mix(docs, weights=weights, **kw).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes, weights), {}
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-6) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return {s: (taken[s], want[s]) for s in taken}, got


def test_targets_are_met_and_reruns_agree(spark):
    rows = [(i, ["a", "b", "c", None, "Z"][i % 5 if i % 3 else 0], "w " * (1 + i * i % 97)) for i in range(3000)]
    sums, got = check(spark, rows, block_rows=500)
    for s, (t, want) in sums.items():
        assert t == pytest.approx(want, rel=0.005), s
    again = entropy_mix.mix(spark.createDataFrame(rows, SCHEMA).repartition(7), block_rows=500).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_rates_are_exponential_tilts(spark):
    rows = [(i, "abc"[i % 3], "w " * (5 + i % 40)) for i in range(900)]
    got = check(spark, rows, weights=(3, 2, 1))[1]
    for source in "bc":
        rs = [r for r in got if r.source == source and 0 < r.rate < 2]
        slopes = {round(math.log(r.rate) / r.size, 4) for r in rs}
        assert max(slopes) - min(slopes) < 2e-4


def test_odd_inputs(spark):
    rows = [(1, "a", None), (2, "a", ""), (2, "a", "one two"), (2, "a", "one two"), (None, None, "x y z"), (5, "empty", " \n"), (6, "b", "w " * 5000)]
    got = entropy_mix.mix(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as size", "8 as rate", "9 as docs", "1 as lam")).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)
    assert entropy_mix.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_takes_the_nearest_sum_of_small_sources(spark):
    from tessera.llm.queries import op7_mix_sources

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sizes, sums = {}, {}
    got = op7_mix_sources(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        assert r.taken == 0 or r.taken % r.size == 0
        source = docs[r.doc_id].source
        sizes.setdefault(source, []).append(r.size)
        sums[source] = sums.get(source, 0) + r.taken
    want = targets({s: sum(v) for s, v in sizes.items()})
    for s, v in sizes.items():
        reach = 1
        for n in v:
            reach |= reach << n | reach << 2 * n
        best = min(abs(k - want[s]) for k in range(reach.bit_length()) if reach >> k & 1)
        assert abs(sums[s] - want[s]) <= best + 0.5, (s, sums[s], want[s], best)
    by = {r.doc_id: r for r in got}
    assert all(by[i].source_size == sum(sizes[docs[i].source]) and by[i].target == pytest.approx(want[docs[i].source], abs=1e-6) for i in docs)


def test_query_meets_targets(spark):
    from tessera.llm.queries import op7_mix_sources

    d = "/root/testdata/sf0.01"
    rows = op7_mix_sources(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.005)


def test_mending_against_all_choices():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        size = rnd.integers(0, 60, 7)
        copies = np.where(size > 0, rnd.integers(0, 3, 7), 0)
        due = float(rnd.uniform(0, 2.2 * size.sum() + 1))
        best = min(abs(sum(a * b for a, b in zip(size, c)) - due) for c in itertools.product(range(3), repeat=7))
        entropy_mix.mend(size, copies, due, 2)
        assert abs((size * copies).sum() - due) <= best + 0.5 and copies.max(initial=0) <= 2 and not copies[size == 0].any()
