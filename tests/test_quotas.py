import math
import random

import pytest

from tessera.functions.drafts import TASK_FAMILIES
from tessera.operators import journal, quotas

WEIGHTS = dict(zip(TASK_FAMILIES, (0.25, 0.25, 0.20, 0.15, 0.15)))


def allocate(targets, weights):
    out, total = {}, sum(weights.values())
    for split, target in targets.items():
        raw = {f: target * w / total for f, w in weights.items()}
        left = target - sum(math.floor(v) for v in raw.values())
        ranked = sorted(raw, key=lambda f: (-(raw[f] - math.floor(raw[f])), f))
        out |= {(split, f): math.floor(raw[f]) + (f in ranked[:left]) for f in raw}
    return out


def table(spark, targets, weights):
    return {(r.split, r.task_family): r.target for r in quotas.quota_table(spark, targets, weights).collect()}


def test_allocation(spark):
    for targets in ({"sft_train": 11, "sft_validation": 3}, {"a": 500, "b": 75}, {"a": 0}, {"a": 9000, "b": 1}):
        got = table(spark, targets, WEIGHTS)
        assert got == allocate(targets, WEIGHTS)
        for s, t in targets.items():
            assert sum(v for (split, _), v in got.items() if split == s) == t
    rnd = random.Random(3)
    for _ in range(5):
        w = {f: rnd.choice([0.0, 1.0, 2.5, 7.0]) + 0.5 for f in TASK_FAMILIES}
        t = {"x": rnd.randint(0, 200), "y": rnd.randint(0, 20)}
        assert table(spark, t, w) == allocate(t, w)


def test_bad_quotas():
    for targets, weights in (({}, WEIGHTS), ({"a": -1}, WEIGHTS), ({"a": 1}, {"x": 1.0}), ({"a": 1}, dict.fromkeys(TASK_FAMILIES, 0.0)), ({"a": 1}, WEIGHTS | {TASK_FAMILIES[0]: -1.0})):
        with pytest.raises(ValueError):
            quotas.check_quotas(targets, weights)


def test_trim_and_status(spark):
    rows = [(f"t{i}-{f}", f"p{i}", "sft_train", f) for f in TASK_FAMILIES for i in range(2)] + [("z", "p", "other", TASK_FAMILIES[0]), ("y", "p", None, None)]
    df = spark.createDataFrame(rows, "task_id string, paper_id string, split string, task_family string")
    quota = quotas.quota_table(spark, {"sft_train": 5}, dict.fromkeys(TASK_FAMILIES, 1.0))
    kept = quotas.trim(df, quota).collect()
    assert sorted(r.task_id for r in kept) == sorted(f"t0-{f}" for f in TASK_FAMILIES)
    status = quotas.quota_status(quotas.trim(df, quota), quota).first()
    assert (status.target_total, status.accepted_total, status.complete) == (5, 5, True)
    assert quotas.quota_deficits(df.limit(0), quota).count() == 5
    assert "None" in {r.split for r in quotas.family_counts(df).collect()}


def test_planned_slots_against_a_plain_model(spark):
    rnd, targets = random.Random(5), {"b": 9, "a": 4, "c": 0}
    rows = [("b", rnd.choice(TASK_FAMILIES)) for _ in range(5)] + [("a", TASK_FAMILIES[0])] * 3
    df = spark.createDataFrame(rows, "split string, task_family string")
    quota = quotas.quota_table(spark, targets, WEIGHTS)
    units = []
    for (s, f), t in allocate(targets, WEIGHTS).items():
        for o in range(min(rows.count((s, f)), t), t):
            units.append((o / t, s, f, o))
    want = [(s, f) for _, s, f, _ in sorted(units)[:6]]
    got = [(r.split, r.task_family) for r in quotas.planned_slots(df, quota, 6).orderBy("slot").collect()]
    assert got == want


def test_resume_sets(spark):
    sources = spark.createDataFrame([(f"p{i}", i) for i in range(6)], "paper_id string, stream_idx long")
    accepted = spark.createDataFrame([("p0",), ("elsewhere",)], "paper_id string")
    rejected = spark.createDataFrame([("p2", "critic"), ("p3", "api_error")], "paper_id string, stage string")
    ids = lambda d: sorted(r.paper_id for r in d.collect())
    assert ids(journal.remaining(sources, accepted, rejected)) == ["p1", "p4", "p5"]
    assert ids(journal.remaining(sources, accepted, rejected, retry_errors=True)) == ["p1", "p3", "p4", "p5"]
    assert ids(journal.within_budget(sources, 4, accepted, rejected)) == ["p1"]
    assert ids(journal.within_budget(sources, 2, accepted, rejected)) == []
    assert journal.decreased({"train": 5, "test": 3}, {"train": 4, "test": 3, "new": 1}) == {"train": (5, 4)}


def test_slots_of_a_driver_equal_those_of_the_table(spark):
    rnd = random.Random(4)
    for _ in range(3):
        targets = {(s, f): rnd.randint(0, 9) for s in ("a", "b") for f in TASK_FAMILIES}
        seen = [(s, f) for (s, f), t in targets.items() for _ in range(rnd.randint(0, t + 1))]
        records = spark.createDataFrame(seen, "split string, task_family string")
        quota = spark.createDataFrame([(*c, t) for c, t in targets.items()], "split string, task_family string, target bigint")
        counts = {c: seen.count(c) for c in set(seen)}
        want = [(r.split, r.task_family) for r in quotas.planned_slots(records, quota, 7).orderBy("slot").collect()]
        assert quotas.next_slots(targets, counts, 7) == want
