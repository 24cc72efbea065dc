import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import completions as cp
from tessera.operators import reward as rw
from tessera.schemas import MEMO, RUBRIC

VALID = "<brainstorm>\na\n</brainstorm>\n<principles>b</principles>\n<synthesis>c</synthesis>\n<answer>d</answer>"
ITEM = "task string, required_constraints array<string>, evaluation_criteria array<string>, acceptable_alternatives array<string>, failure_modes array<string>"


def scores(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", cp.format_reward(F.col("t")).alias("f")).orderBy("i").select("f").collect()]


def plain(text):
    names = ("brainstorm", "principles", "synthesis", "answer")
    m = re.fullmatch(r"\s*" + r"\s*".join(f"<{n}>(.*?)</{n}>" for n in names) + r"\s*", text, re.S | re.I)
    if not m or not all(g.strip() for g in m.groups()):
        return 0.0
    return float(not any(re.search(r"</?(?:brainstorm|principles|synthesis|answer)>", g, re.I) for g in m.groups()))


def test_format_gate(spark):
    assert scores(spark, [VALID, "<answer>d</answer>", VALID.replace("c", "<synthesis></synthesis>"), VALID + " tail", "\n" + VALID.upper(), ""]) == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rnd, texts = random.Random(2), []
    parts = re.findall(r"</?\w+>|\n|[abcd]", VALID)
    for _ in range(400):
        p = list(parts)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(p))
            p[k : k + 1] = rnd.choice([[], [p[k].upper()], [p[k], rnd.choice(parts)], ["\x1c"], [" "], [" "]])
        texts.append("".join(p))
    want = [plain(t) for t in texts]
    assert 40 < sum(want) < 390 and scores(spark, texts) == want


def test_scores_and_coefficients(spark):
    df = spark.createDataFrame([(3, 4, 3, 4), (1, 2, 1, 2)], "brainstorm int, principles int, synthesis int, answer int")
    judged = df.select(cp.semantic_score(F.struct(*df.columns)).alias("s"))
    assert [r.s for r in judged.collect()] == [0.875, 0.375]
    assert [r[0] for r in judged.select(cp.combined_reward(F.lit(1.0), F.col("s"))).collect()] == [0.8875, 0.1 + 0.9 * 0.375]
    with pytest.raises(ValueError):
        cp.check_coefficients(0.2, 0.9)
    bad = spark.createDataFrame([(5, 0, 0, 0)], df.schema)
    with pytest.raises(Exception, match="0..4"):
        bad.select(cp.semantic_score(F.struct(*df.columns))).collect()
    with pytest.raises(Exception, match="between 0 and 1"):
        spark.range(1).select(cp.combined_reward(F.lit(1.0), F.col("id") + 2.0)).collect()


def make_judge(change=lambda answers: answers):
    """A scripted judge; made inside a function, so that it reaches workers by value."""

    def judge(items):
        strong = {"brainstorm": 3, "principles": 4, "synthesis": 3, "answer": 4, "brief_reason": "x"}
        return change([{"item_index": i["item_index"], **strong} for i in items])

    return judge


def test_memo_is_asked_once_and_malformed_rows_never(spark):
    lists = (["a"], ["b"], ["c"], ["d"])
    rows = [(0, "t", *lists, VALID), (1, "t", *lists, "malformed"), (2, "t", *lists, VALID), (3, "other", *lists, VALID)]
    df = spark.createDataFrame(rows, f"completion_id long, {ITEM}, completion string")
    items = rw.judge_items(df, "m")
    none = spark.createDataFrame([], MEMO)
    asked = rw.misses(items, none)
    assert sorted(r.completion_id for r in items.collect()) == [0, 2, 3] and asked.count() == 2
    memo = spark.createDataFrame(rw.judge_misses(asked, make_judge()).withColumn("seq", F.lit(0).cast("long")).collect(), "cache_key string, prompt_version string, judgment struct<brainstorm:int,principles:int,synthesis:int,answer:int,brief_reason:string>, seq long")
    assert rw.misses(items, memo).count() == 0
    got = {r.completion_id: r.reward for r in rw.rewards(df, items, memo).collect()}
    assert got == {0: 0.8875, 1: 0.0, 2: 0.8875, 3: 0.8875}


def test_answers_must_cover_the_batch(spark):
    asked = rw.misses(rw.judge_items(spark.createDataFrame([(0, "t", ["a"], ["b"], ["c"], ["d"], VALID)], f"completion_id long, {ITEM}, completion string"), "m"), spark.createDataFrame([], MEMO))
    for wrong in (lambda a: [], lambda a: a * 2, lambda a: [{**a[0], "item_index": 7}]):
        with pytest.raises(Exception, match="must answer each"):
            rw.judge_misses(asked, make_judge(wrong)).collect()


def test_last_written_row_wins(spark):
    memo = spark.createDataFrame([("k", 1, 0), ("k", 2, 5), ("j", 3, 1)], "cache_key string, judgment int, seq long")
    assert dict(rw.latest(memo).collect()) == {"k": 2, "j": 3}


def test_cache_key_is_that_of_plain_json(spark):
    import hashlib
    import json

    items = [
        {"task": "é \"q\" \\\\u001F \u2028 / \x7f", **{r: ["a\tb", "c\nd", None, ""] for r in RUBRIC}, "student_response": "\x00\x0b\x1f\x08\x0c\r \\\x1a 😀"},
        {"task": None, **{r: None if i else [] for i, r in enumerate(RUBRIC)}, "student_response": ""},
    ]
    schema = "task string, " + ", ".join(f"{r} array<string>" for r in RUBRIC) + ", student_response string"
    frame = spark.createDataFrame([tuple(i[n] for n in ("task", *RUBRIC, "student_response")) for i in items], schema)
    got = [r.k for r in frame.select(cp.cache_key(F.struct(*frame.columns), "m").alias("k")).collect()]
    for item, key in zip(items, got):
        payload = {"prompt_version": cp.JUDGE_PROMPT_VERSION, "model": "m", "item": item}
        assert key == hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def store_rows(spark, a, b, value):
    return spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), (F.col("id") + value).alias("v"))


def test_memo_store_reads_the_files_that_may_hold_a_key(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.sources.memo import MemoStore, is_store

    schema = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("v", T.LongType()), T.StructField("seq", T.LongType())])
    store = MemoStore(spark, f"{tmp_path}/m", schema, bucket_rows=20_000, most_files=8)
    few = spark.createDataFrame([("none",), (None,)], "cache_key string")
    assert not is_store(spark, f"{tmp_path}/m") and store.lookup(few).count() == 0
    store.append(store_rows(spark, 0, 1_000_000, 0))
    store.append(store_rows(spark, 0, 1000, 10**9))  # later rows of some keys
    assert is_store(spark, f"{tmp_path}/m")
    whole = len(store.log.manifest()["tables"]["rows"])
    assert whole > 40
    some = store_rows(spark, 500, 503, 0).unionByName(store_rows(spark, 900_000, 900_001, 0)).unionByName(store_rows(spark, 2 * 10**6, 2 * 10**6 + 2, 0)).select("cache_key")
    named = store.files_for(some)
    assert 2 <= len(named) <= 8  # of more than forty
    found = store.lookup(some)
    read = found.inputFiles()
    assert {f.rsplit("/", 1)[1] for f in read} == {f.rsplit("/", 1)[1] for f in named}
    assert sorted(r.v for r in found.collect()) == [900_000, 10**9 + 500, 10**9 + 501, 10**9 + 502]
    assert store.lookup(store_rows(spark, 3 * 10**6, 3 * 10**6 + 3, 0)).count() == 0
    # compaction keeps the last row of every key
    assert store.compact() and store.read().count() == 1_000_000
    assert sorted(r.v for r in store.lookup(some).collect()) == [900_000, 10**9 + 500, 10**9 + 501, 10**9 + 502]


def test_memo_store_over_time(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.sources.memo import MemoStore

    schema = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("v", T.LongType()), T.StructField("seq", T.LongType())])
    store, want = MemoStore(spark, f"{tmp_path}/m", schema, most_files=3), {}
    old = spark.createDataFrame([("a", 1, 0), ("a", 2, 4), ("z", 0, 1)], schema)
    store.take_in(old)
    want = {"a": 2, "z": 0}
    rnd = random.Random(1)
    for k in range(7):
        rows = [(rnd.choice("abcdefgh"), 100 * k + j) for j in range(1)]
        store.append(spark.createDataFrame(rows, "cache_key string, v long").coalesce(1))
        want.update(rows)
        assert len(store.log.manifest()["tables"]["rows"]) <= 4
    keys = spark.createDataFrame([(c,) for c in "abcdefghijz"], "cache_key string")
    assert {r.cache_key: r.v for r in store.lookup(keys).collect()} == want
    with pytest.raises(RuntimeError):
        store.take_in(old)


def test_parsing_takes_the_time_of_reading(spark):
    """Repeated sections, runs of blanks and unclosed tags: no completion takes longer than its length asks for."""
    import time

    texts = [VALID * 2000 + "x", VALID.replace("\na\n", " " * 300_000 + "z" + " " * 300_000 + "z"), "<answer>" * 50_000, VALID + " " * 300_000, "\x85" * 100_000 + VALID + " "]
    scores(spark, [VALID])
    began = time.time()
    assert scores(spark, texts) == [0.0, 1.0, 0.0, 1.0, 1.0]
    assert time.time() - began < 5.0
    one = time.time()
    assert scores(spark, [VALID * 200 + "x"]) == [0.0]
    assert time.time() - one < 2.0


def test_strip_is_that_of_the_white_space_class(spark):
    from tessera.functions.text import strip

    chars = [chr(c) for c in range(1, 0x3100)]
    df = spark.createDataFrame([(c, f"{c}x {c}") for c in chars], "c string, t string")
    for r in df.select("c", strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "").alias("want")).collect():
        assert r.s == r.want, hex(ord(r.c))


class TellingJudge:
    def ask(self, items):
        answers = [{"item_index": i["item_index"], "brainstorm": 4, "principles": 4, "synthesis": 4, "answer": 4, "brief_reason": "x"} for i in items]
        return answers, {"response_id": "r1", "model": "served", "usage": {"total_tokens": 7}}


def test_the_memo_keeps_the_call(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    from tessera.sources import files
    from tessera.sources.memo import is_store

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    more = {"task": ["t", "t"], **{r: [["a"], ["a"]] for r in RUBRIC}}
    for store in (False, True, None):
        path = f"{tmp_path}/{'m' if store is None else store}"
        if store is None:  # lines of an earlier run that go on in a store
            rw.reward_function(spark, TellingJudge(), path, "m")([VALID, "bad"], **more)
        score = rw.reward_function(spark, TellingJudge(), path, "m", store=store or store is None)
        assert score([VALID, "bad"], **more) == [1.0, 0.0]
        assert score([VALID, VALID.replace("d", "e")], **more) == [1.0, 1.0]
        at = path if store is False else f"{path}.store"
        assert is_store(spark, at) is (store is not False)
        memo = files.read_memo(spark, at, MEMO).collect()
        assert len(memo) == 2 and {m.response.response_id for m in memo} == {"r1"} and {m.response.usage.total_tokens for m in memo} == {7}
        assert {m.request.student_response for m in memo} == {VALID, VALID.replace("d", "e")} and sorted(m.seq for m in memo) in ([0, 1], [0, 2])
