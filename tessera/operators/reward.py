"""Reward scoring with a content-addressed memo of judgments.

A judge is a paid remote call, so it never stands inside a conditional or under a filter on its own output
(Spark would run it for every row, or twice): malformed completions are filtered out first, the memo is
anti-joined, only the misses are judged and written, and scores come back by a join.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import completions
from tessera.schemas import CALL_META, DIMENSIONS, MEMO, RUBRIC
from tessera.sources import files

#: items (dicts of the judge item, with item_index) -> judgments (dicts with item_index and the dimensions).  A judge with a method
#: ``ask`` (items) -> (judgments, metadata of the call) also says what the call was.
Judge = Callable[[list[dict]], list[dict]]


def judge_items(rows: DataFrame, model: str) -> DataFrame:
    """Well-formed completions of (completion_id, task, rubric..., completion) with their item and memo key."""
    good = rows.where(completions.parse_completion(F.col("completion")).isNotNull())
    item = completions.judge_item(F.col("task"), {r: F.col(r) for r in RUBRIC}, F.col("completion"))
    return good.select("completion_id", item.alias("item")).withColumn("cache_key", completions.cache_key(F.col("item"), model))


def numbered(items: DataFrame, batch: str, order: str) -> DataFrame:
    """Items with ``item_index``, their place in their request's batch."""
    at = F.row_number().over(Window.partitionBy(batch).orderBy(order)).cast("long") - 1
    return items.withColumn("item_index", at)


def latest(memo: DataFrame, *, keep_seq: bool = False) -> DataFrame:
    """One row per key: the last written wins."""
    names = [c for c in memo.columns if c != "cache_key" and (keep_seq or c != "seq")]
    last = memo.groupBy("cache_key").agg(F.max_by(F.struct(*names), "seq").alias("_m"))
    return last.select("cache_key", *[F.col(f"_m.{c}").alias(c) for c in names])


def misses(items: DataFrame, memo: DataFrame) -> DataFrame:
    """Distinct requests that the memo does not answer."""
    return items.join(memo.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def lookup(items: DataFrame, memo: DataFrame) -> DataFrame:
    """Every item with its judgment and score; null where the memo has none."""
    found = latest(memo).select("cache_key", "judgment")
    return items.join(found, "cache_key", "left").withColumn("semantic", completions.semantic_score(F.col("judgment")))


def cover_problems(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: how many item indexes are missing, unexpected or answered more than once."""
    asked = requests.select("item_index", F.lit(1).alias("asked"))
    given = answers.groupBy("item_index").agg(F.count(F.lit(1)).alias("given"))
    return asked.join(given, "item_index", "full").agg(
        F.count_if(F.col("given").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("unexpected"),
        F.count_if(F.col("given") > 1).alias("repeated"),
    )


def judge_misses(requests: DataFrame, judge: Judge, version: str = completions.JUDGE_PROMPT_VERSION, batch_rows: int = 64) -> DataFrame:
    """Ask the judge about distinct requests, some at a time; answers must cover a batch exactly.

    Write the result before anything reads it twice; a task that is run again repeats its calls.
    """
    dims = ", ".join(f"{d} int" for d in DIMENSIONS)
    schema = f"cache_key string, prompt_version string, judgment struct<{dims.replace(' int', ':int')}, brief_reason:string>"
    told = hasattr(judge, "ask")
    schema += ", response string" if told else ""
    names = ["task", *RUBRIC, "student_response"]

    def ask(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at : at + batch_rows]
                items = []
                for i, (_, row) in enumerate(part.iterrows()):
                    value = row["item"]
                    items.append({"item_index": i, **{n: (list(value[n]) if n in RUBRIC and value[n] is not None else value[n]) for n in names}})
                answers, meta = judge.ask(items) if told else (judge(items), None)
                by = {a["item_index"]: a for a in answers}
                if len(answers) != len(items) or set(by) != set(range(len(items))):
                    raise RuntimeError(f"the judge must answer each of {len(items)} items once; it answered {sorted(a['item_index'] for a in answers)}")
                yield pd.DataFrame(
                    {
                        "cache_key": part["cache_key"].to_numpy(),
                        "prompt_version": version,
                        "judgment": [{**{d: int(by[i][d]) for d in DIMENSIONS}, "brief_reason": by[i].get("brief_reason")} for i in range(len(items))],
                        **({"response": json.dumps(meta)} if told else {}),
                    }
                )

    judged = requests.select("cache_key", "item").mapInPandas(ask, schema)
    return judged.withColumn("response", F.from_json("response", CALL_META)) if told else judged


def reward_function(
    spark: SparkSession, judge: Judge, memo_path: str, model: str, *, base: float = 0.10, weight: float = 0.90, batch_rows: int = 64, store: bool | None = None
) -> Callable[..., list[float]]:
    """A callable for trainers: (completions, task=..., rubric columns as keywords) -> rewards, in order.

    Completions are texts or chat messages (the last one's content counts).  Malformed ones cost no call; judgments that the memo
    at ``memo_path`` has are not asked for again, new ones are appended to it.  Other keywords are ignored.  ``store`` keeps the memo as
    bucketed files with filters (``sources.memo``), so that a batch reads the files that may know its items; plain JSON lines that lie
    there go on in a store below it.  By default a store stays a store and lines stay lines.
    """
    completions.check_coefficients(base, weight)
    schema = "completion_id long, task string, " + ", ".join(f"{r} array<string>" for r in RUBRIC) + ", completion string"

    def text(completion) -> str:
        if isinstance(completion, str):
            return completion
        return (completion[-1].get("content") or "") if completion else "[]"

    def score(completions: Sequence, task: Sequence[str], **columns: Sequence) -> list[float]:
        if not len(completions):
            return []
        rows = [(i, task[i], *[columns[r][i] for r in RUBRIC], text(c)) for i, c in enumerate(completions)]
        frame = spark.createDataFrame(rows, schema)
        items = files.written(judge_items(frame, model), "items")
        kept = memo_of(spark, memo_path, store)
        memo = files.written(kept.lookup(items.select("cache_key")), "memo")
        asked = misses(items, memo)
        if not asked.isEmpty():
            judged = files.written(judge_misses(asked, judge, batch_rows=batch_rows), "judged")  # paid for: written before it is read again
            told = [c for c in ("response",) if c in judged.columns]
            judged = judged.join(asked.select("cache_key", F.col("item").alias("request")), "cache_key")
            kept.append(judged.select("cache_key", "prompt_version", "request", "judgment", *told))
            memo = kept.lookup(items.select("cache_key"))
        got = {r.completion_id: r.reward for r in rewards(frame, items, memo, base, weight).collect()}
        return [got[i] for i in range(len(rows))]

    return score


def judge_function(judge: Judge, batch_rows: int = 64):
    """The judge as a table function: ``select * from judge_items(table(items) partition by batch)`` of (cache_key, item) rows.

    Register it with ``spark.udtf.register("judge_items", judge_function(judge))``.  Requests hold up to ``batch_rows`` items of a partition; answers
    must cover a request exactly.  A null item is an error, for only well-formed completions are judged.
    """
    from pyspark.sql.functions import udtf

    dims = ", ".join(f"{d} int" for d in DIMENSIONS)
    names = ["task", *RUBRIC, "student_response"]

    @udtf(returnType=f"cache_key string, {dims}, brief_reason string, request bigint")
    class JudgeItems:
        def __init__(self):
            self.waiting, self.requests = [], 0

        def eval(self, row):
            if row["item"] is None:
                raise ValueError("only well-formed completions are judged")
            self.waiting.append((row["cache_key"], {n: row["item"][n] for n in names}))
            if len(self.waiting) >= batch_rows:
                yield from self.ask()

        def terminate(self):
            if self.waiting:
                yield from self.ask()

        def ask(self):
            keys, items = [k for k, _ in self.waiting], [{"item_index": i, **item} for i, (_, item) in enumerate(self.waiting)]
            self.waiting = []
            answers = judge.ask(items)[0] if hasattr(judge, "ask") else judge(items)
            by = {a["item_index"]: a for a in answers}
            if len(answers) != len(items) or set(by) != set(range(len(items))):
                raise RuntimeError(f"the judge must answer each of {len(items)} items once; it answered {sorted(a['item_index'] for a in answers)}")
            for i, key in enumerate(keys):
                yield (key, *[int(by[i][d]) for d in DIMENSIONS], by[i].get("brief_reason"), self.requests)
            self.requests += 1

    return JudgeItems


class LineMemo:
    """A memo of plain JSON lines; a lookup reads all of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return files.read_jsonl(self.spark, self.path, MEMO)

    def lookup(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select("cache_key").distinct(), "cache_key", "left_semi")

    def append(self, rows: DataFrame) -> None:
        files.append_memo(self.read(), rows, self.path)


def memo_of(spark: SparkSession, path: str, store: bool | None = None):
    """The memo at ``path``: a store where there is one or where one is wanted, else plain lines.  Lines that a new store finds are taken in."""
    from tessera.sources.memo import MemoStore, is_store

    at = f"{path.rstrip('/')}.store"
    if is_store(spark, path):
        return MemoStore(spark, path)
    if not store and not (store is None and is_store(spark, at)):
        return LineMemo(spark, path)
    new, kept = not is_store(spark, at), MemoStore(spark, at)
    if new and files.exists(spark, path):
        kept.take_in(files.read_jsonl(spark, path, MEMO))
    return kept


def rewards(rows: DataFrame, items: DataFrame, memo: DataFrame, base: float = 0.10, weight: float = 0.90) -> DataFrame:
    """(completion_id, format, semantic, reward) of every completion; malformed ones get 0.

    ``items`` are the well-formed rows (``judge_items``), so being among them is the format gate and nothing is parsed twice.
    """
    scored = lookup(items, memo).select("completion_id", "semantic", F.lit(1.0).alias("format"))
    gate = rows.select("completion_id").join(scored, "completion_id", "left")
    semantic = F.coalesce("semantic", F.lit(0.0))
    return gate.withColumn("format", F.coalesce("format", F.lit(0.0))).select(
        "completion_id", "format", semantic.alias("semantic"), completions.combined_reward(F.col("format"), semantic, base, weight).alias("reward")
    )


def group_advantage(rewarded: DataFrame, group: str = "prompt_id", epsilon: float = 1e-4) -> DataFrame:
    """Extension: rewards centred and scaled inside each prompt's group of generations."""
    own = Window.partitionBy(group)
    mean, spread = F.avg("reward").over(own), F.coalesce(F.stddev_samp("reward").over(own), F.lit(0.0))
    return rewarded.withColumn("advantage", (F.col("reward") - mean) / (spread + F.lit(epsilon)))
