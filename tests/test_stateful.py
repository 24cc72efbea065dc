import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_rewards import ITEM, VALID, make_judge

from tessera.operators import reward as rw
from tessera.sources.corpus import first_qualifying
from tessera.streaming import stateful

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    stateful.use_state_store(spark)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def run(stream, place, check, mode="update"):
    """One run of a query over what has arrived; its output goes to a folder, a subfolder for each micro-batch."""
    write = lambda batch, k: batch.write.mode("overwrite").json(f"{place}/{k:05d}")
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None


def rows_of(tmp_path, name):
    import json

    return [json.loads(line) for folder in sorted((tmp_path / name).iterdir()) for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


SCHEMA = "lane long, at long, id string, flush boolean"


def test_shuffle_buffer_is_seeded_bounded_and_replayable(spark, tmp_path):
    rows = [(i % 3, i, f"r{i}", False) for i in range(300)]
    parts = [rows[:50], rows[50:180], rows[180:], [(lane, None, None, True) for lane in range(3)]]
    out = {}
    for name, cuts in (("whole", [[0, 1, 2], [3]]), ("pieces", [[0], [1], [2], [3]])):
        src = f"{tmp_path}/in-{name}"
        for cut in cuts:  # a query that ends and starts again from its checkpoint
            spark.createDataFrame([r for k in cut for r in parts[k]], SCHEMA).repartition(3).write.mode("append").json(src)
            stream = spark.readStream.schema(SCHEMA).json(src)
            done = stateful.shuffled(stream, lane="lane", order="at", flush="flush", seed=5, buffer=20)
            run(done, f"{tmp_path}/{name}", f"{tmp_path}/check-{name}", "append")
            held = sum(len(parts[k]) for c in cuts[: cuts.index(cut) + 1] for k in c if k < 3) - len(rows_of(tmp_path, name))
            assert held <= 60 and (cut != [3] or held == 0)  # three lanes of twenty
        out[name] = {lane: [r["id"] for r in rows_of(tmp_path, name) if int(r["id"][1:]) % 3 == lane] for lane in range(3)}
    assert out["whole"] == out["pieces"]  # whatever the micro-batches were
    for lane in range(3):
        assert sorted(out["whole"][lane]) == sorted(r[2] for r in rows if r[0] == lane)
        assert out["whole"][lane] != [r[2] for r in rows if r[0] == lane]
    with pytest.raises(ValueError):
        stateful.shuffled(spark.createDataFrame([], SCHEMA), lane="lane", order="at", flush="flush", buffer=0)


def test_first_row_of_a_paper_in_any_batching(spark, tmp_path):
    rnd = random.Random(3)
    schema = "paper_id string, order_key string, row long, text string"
    rows = [(f"p{rnd.randrange(40)}" if rnd.random() < 0.7 else "hot", f"{rnd.randrange(500):03d}", i, f"t{i}") for i in range(400)]
    table = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, first_qualifying(table, ("order_key", "row")).collect()))
    for name, cuts in (("one", [400]), ("five", [80] * 5), ("odd", [1, 7, 392])):
        src, at = f"{tmp_path}/in-{name}", 0
        for n in cuts:
            spark.createDataFrame(rows[at : at + n], schema).write.mode("append").json(src)
            at += n
            stream = spark.readStream.schema(schema).json(src)
            run(stateful.first_per_paper(stream, ("order_key", "row")), f"{tmp_path}/{name}", f"{tmp_path}/check-{name}")
        answers = spark.createDataFrame([tuple(r[c] for c in ("paper_id", "order_key", "row", "text")) for r in rows_of(tmp_path, name)], schema)
        assert sorted(map(tuple, stateful.settled(answers, ("order_key", "row")).collect())) == want
        assert answers.count() < 400


def test_a_paper_is_forgotten_after_its_time(spark, tmp_path):
    import time

    schema, src = "paper_id string, order_key string", f"{tmp_path}/in"
    spark.createDataFrame([("p", "5")], schema).write.mode("append").json(src)
    stream = stateful.first_per_paper(spark.readStream.schema(schema).json(src), ttl_ms=2000)
    seen = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, k: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    wait = lambda n: [time.sleep(0.5) for _ in range(120) if len(seen) < n]
    try:
        wait(1)
        time.sleep(4)
        spark.createDataFrame([("p", "7")], schema).write.mode("append").json(src)  # later than the first, which is forgotten
        wait(2)
    finally:
        q.stop()
    assert seen == [("p", "5"), ("p", "7")]


def test_judge_as_a_table_function(spark):
    lists = (["a"], ["b"], ["c"], ["d"])
    rows = [(i, "t", *lists, VALID.replace("d", f"d{i}")) for i in range(20)]
    items = rw.judge_items(spark.createDataFrame(rows, f"completion_id long, {ITEM}, completion string"), "m")
    items.select("cache_key", "item", F.expr("completion_id % 2").alias("batch")).createOrReplaceTempView("asked")
    ask = "select * from judge_items(table(asked) partition by batch)"
    spark.udtf.register("judge_items", rw.judge_function(make_judge(), batch_rows=4))
    got = spark.sql(ask).collect()
    assert sorted(r.cache_key for r in got) == sorted(r.cache_key for r in items.collect()) and {r.synthesis for r in got} == {3}
    assert {r.request for r in got} == {0, 1, 2}  # ten items a partition, four a request
    for wrong in (lambda a: a[1:], lambda a: a + a[:1], lambda a: [{**a[0], "item_index": 77}, *a[1:]]):
        spark.udtf.register("judge_items", rw.judge_function(make_judge(wrong), batch_rows=4))
        with pytest.raises(Exception, match="must answer each"):
            spark.sql(ask).collect()
