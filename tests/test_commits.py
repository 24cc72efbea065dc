import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.drafts import TASK_FAMILIES
from tessera.operators import quotas
from tessera.plans.quotas import scripted
from tessera.schemas import ACCEPTED, EXCERPT, QUOTA, REJECTED
from tessera.sources import commits, files
from tessera.sources.commits import CommitLog, Conflict
from tessera.streaming import fill

cloudpickle.register_pickle_by_value(sys.modules[__name__])
R = T.StructType([T.StructField("a", T.LongType())])
A = T.StructType([*R.fields, T.StructField("b", T.StringType())])
WEIGHTS = {f: 1.0 for f in TASK_FAMILIES}


def log(spark, tmp_path):
    return CommitLog(spark, f"{tmp_path}/log", {"good": (f"{tmp_path}/good", A), "bad": (f"{tmp_path}/bad", R)})


def rows(spark, *values, schema=A):
    return spark.createDataFrame([(v, None)[: len(schema)] for v in values], schema).coalesce(1)


def state(spark, tmp_path):
    return tuple(sorted(x.a for x in files.read_jsonl(spark, f"{tmp_path}/{t}", s).collect()) for t, s in (("good", A), ("bad", R)))


def test_commits_versions_and_conflicts(spark, tmp_path):
    files.append_jsonl(rows(spark, 1, 2), f"{tmp_path}/good")  # a plain journal from before
    one = log(spark, tmp_path)
    assert one.manifest()["version"] == 0 and one.read("good").count() == 2
    v = one.commit({"good": rows(spark, 3), "bad": rows(spark, 7, schema=R)})
    assert state(spark, tmp_path) == ([1, 2, 3], [7])
    assert sorted(x.a for x in one.read("good", v - 1).collect()) == [1, 2]  # the state before
    w = one.commit({"good": rows(spark, 4)}, expected=v)
    with pytest.raises(Conflict):
        one.commit({"good": rows(spark, 5)}, expected=v)
    with pytest.raises(Conflict):
        one.commit(replace={"good": rows(spark, 5)}, expected=v)
    assert state(spark, tmp_path) == ([1, 2, 3, 4], [7])
    one.commit(replace={"good": one.read("good", w).where("a > 2")}, expected=w)
    assert state(spark, tmp_path) == ([3, 4], [7]) and one.read("good", w).count() == 4
    assert one.commit({"good": rows(spark, 9)}, writer="x", batch=3) and one.commit({"good": rows(spark, 9)}, writer="x", batch=3)
    one.commit({"good": rows(spark, 8)}, writer="x", batch=2)
    assert state(spark, tmp_path) == ([3, 4, 9], [7])  # a batch that is repeated adds nothing
    assert [h["version"] for h in one.history()] == one.versions() and one.history()[-1]["parent"] == one.versions()[-2]
    assert one.commit({}) == one.versions()[-1] and state(spark, tmp_path) == ([3, 4, 9], [7])
    with pytest.raises(FileNotFoundError):
        one.manifest(99)


def test_two_writers_one_wins_and_the_other_goes_on(spark, tmp_path):
    logs = [log(spark, tmp_path) for _ in range(4)]
    logs[0].commit({"good": rows(spark, 0)})
    parent, got = logs[0].versions()[-1], []

    def sure(k):
        try:
            logs[k].commit({"good": rows(spark, 100 + k)}, expected=parent)
            got.append(k)
        except Conflict:
            pass

    def patient(k):
        for j in range(3):
            logs[k].commit({"good": rows(spark, 10 * k + j), "bad": rows(spark, k, schema=R)})

    for work in (sure, patient):
        threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert len(got) == 1
    good, bad = state(spark, tmp_path)
    assert good == sorted([0, 100 + got[0], *[10 * k + j for k in (1, 2, 3) for j in range(3)]]) and bad == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_a_run_killed_between_any_two_steps_leaves_a_whole_journal(spark, tmp_path, monkeypatch):
    """Every call that touches a file system is a step; a run is killed before and after each."""
    names = ("put_new", "append_jsonl", "write_json", "children", "exists", "_write_beside")
    plain = {n: getattr(files, n) for n in names}

    class Killed(BaseException):
        pass

    def killing(at):
        count = [0]

        def step(f):
            def run(*args, **kw):
                count[0] += 1
                if count[0] == at:
                    raise Killed
                out = f(*args, **kw)
                count[0] += 1
                if count[0] == at:
                    raise Killed
                return out

            return run

        for n in names:
            monkeypatch.setattr(files, n, step(plain[n]))

    ended = False
    for at in range(1, 200):
        place = tmp_path / str(at)
        files.append_jsonl(rows(spark, 1), f"{place}/good")
        killing(at)
        try:
            log(spark, place).commit({"good": rows(spark, 2), "bad": rows(spark, 3, schema=R)})
            ended = True
        except Killed:
            pass
        for n in names:
            monkeypatch.setattr(files, n, plain[n])
        assert state(spark, place) in (([1], []), ([1, 2], [3])), at
        log(spark, place).commit({"good": rows(spark, 5)})
        assert state(spark, place) in (([1, 5], []), ([1, 2, 5], [3])), at
        if ended:
            break
    assert ended and at > 20


def test_compaction_and_vacuum(spark, tmp_path):
    one = log(spark, tmp_path)
    for k in range(5):
        one.commit({"good": rows(spark, k)})
    assert one.compact(most=3) and not one.compact(most=3)
    assert len(one.manifest()["tables"]["good"]) == 1 and state(spark, tmp_path)[0] == [0, 1, 2, 3, 4]
    assert one.vacuum(keep=1) == 0  # young folders stay, for a commit may be under way
    assert one.vacuum(keep=1, older_than_s=0) == 5 and one.versions() == [one.manifest()["version"]]
    assert state(spark, tmp_path)[0] == [0, 1, 2, 3, 4]


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/j"
    files.write_jsonl(rows(spark, 1, 2), path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("a"), F.lit("x").alias("b"))
    with pytest.raises(Exception, match="no"):
        files.write_jsonl(bad, path)
    assert files.read_jsonl(spark, path, A).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["j"]
    table = spark.createDataFrame([("train", 1), ("test", 2)], "split string, a bigint")
    files.save_projection(table, f"{tmp_path}/p", {"train": 1, "test": 1})
    broken = table.withColumn("a", F.when(F.col("split") == "test", F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("a")))
    for write in (lambda: files.save_projection(broken, f"{tmp_path}/p", {"train": 1, "test": 1}), lambda: files.save_split_files(broken, f"{tmp_path}/q", "x")):
        with pytest.raises(Exception, match="no"):
            write()
    assert files.load_training(spark, f"{tmp_path}/p").count() == 2
    # a run that ended between the two renames
    (tmp_path / "p").rename(tmp_path / "p.old")
    assert files.load_training(spark, f"{tmp_path}/p").count() == 2
    (tmp_path / "j").rename(tmp_path / "j.old")
    assert files.read_jsonl(spark, path, A).count() == 2


def sources(spark, n):
    made = [(f"{i:04d}", "t", f"text {i}", "corpus", "train", "u", "CC0", "CC0", f"sha{i}", i) for i in range(n)]
    return spark.createDataFrame(made, EXCERPT.simpleString()[7:-1].replace(":", " ") + ", stream_idx long")


def drowsy(source, split, family):
    time.sleep(0.05)
    return scripted(source, split, family)


def test_calls_of_a_batch_run_on_many_tasks(spark):
    batch = sources(spark, 200).selectExpr("*", "stream_idx + 1 as slot", "'sft_train' as split", f"'{TASK_FAMILIES[0]}' as task_family")
    took = []
    for tasks in (1, 4):
        spread = batch.repartitionByRange(tasks, "slot")
        fill.generate(spread.limit(0), drowsy, 1).collect()
        began = time.time()
        assert len(fill.generate(spread, drowsy, 1).collect()) == 200
        took.append(time.time() - began)
    assert took[0] > 10 and took[1] < 0.5 * took[0]  # ten seconds of calls


def test_overplanned_batches_end_in_the_exact_trim(spark, tmp_path):
    a, r = f"{tmp_path}/a", f"{tmp_path}/r"
    targets = {"sft_train": 40, "sft_validation": 12}
    done = fill.fill_quotas(spark, sources(spark, 400), targets, WEIGHTS, accepted_path=a, rejected_path=r, provider=scripted, concurrency=10, tasks=4, overplan=True).collect()
    accepted, rejected = files.read_jsonl(spark, a, ACCEPTED), files.read_jsonl(spark, r, REJECTED)
    quota = quotas.quota_table(spark, targets, WEIGHTS)
    want = {x.task_id for x in quotas.trim(accepted, spark.createDataFrame(quota.collect(), QUOTA)).collect()}
    assert {x.task_id for x in done} == want and len(done) == 52
    n, m = accepted.count(), rejected.count()
    assert n >= 52 and n + m == accepted.unionByName(rejected, allowMissingColumns=True).select("paper_id").distinct().count()
    versions = CommitLog(spark, f"{a}.commits", {"accepted": (a, ACCEPTED), "rejected": (r, REJECTED)}).history()
    assert len(versions) <= 2 * (-(-(n + m) // 40)) + 3  # batches of forty, a lease and a commit each


def test_two_runs_on_the_same_journals_pay_once(spark, tmp_path):
    a, r = f"{tmp_path}/a", f"{tmp_path}/r"
    make = lambda holder: fill.Filler(spark, {"sft_train": 30}, WEIGHTS, a, r, scripted, 6, holder=holder, tasks=2)
    one, two = make("one"), make("two")
    queues = [f.queue(sources(spark, 80), "stream_idx") for f in (one, two)]
    # the second leases a batch and sleeps; the first goes past its sources
    two.lease("away", [(f"{i:04d}", "sft_train", TASK_FAMILIES[0]) for i in range(5)])
    one.run(queues[0])
    tried = lambda: {x.paper_id for s, p in ((ACCEPTED, a), (REJECTED, r)) for x in files.read_jsonl(spark, p, s).collect()}
    assert not tried() & {f"{i:04d}" for i in range(5)}
    at = 0
    while n := two.batch(queues[1], at):
        at += n
    journal = [x.paper_id for s, p in ((ACCEPTED, a), (REJECTED, r)) for x in files.read_jsonl(spark, p, s).collect()]
    assert len(journal) == len(set(journal))
    # an expired lease holds nothing
    two.lease_s = -1.0
    two.lease("gone", [("0079", "sft_train", TASK_FAMILIES[0])])
    assert one.others(one.log.manifest()["state"]) == {}


def test_rates_hold_for_all_threads_of_a_process():
    seen = []
    call = fill.Limited(lambda k: seen.append((k, time.monotonic())), 50.0)
    threads = [threading.Thread(target=lambda k=k: [call(k) for _ in range(5)]) for k in range(4)]
    began = time.monotonic()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 20 and 0.35 < time.monotonic() - began < 1.5
    with pytest.raises(ValueError):
        fill.Limited(print, 0)


def test_a_folder_without_a_log_reads_plainly(spark, tmp_path):
    files.append_jsonl(rows(spark, 1), f"{tmp_path}/x")
    assert commits.committed(spark, f"{tmp_path}/x") is None and files.read_jsonl(spark, f"{tmp_path}/x", A).count() == 1
