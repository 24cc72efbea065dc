"""Queries over completions, judgments and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import completions
from tessera.operators import audit
from tessera.operators import reward as rw
from tessera.plans.adapters import adapted, cte, spark_table
from tessera.plans.registry import query
from tessera.schemas import DIMENSIONS, RUBRIC
from tessera.sources.files import written

MODEL = "judge"
_BODY = r"\s*".join(f"<{d}>(.*?)</{d}>" for d in DIMENSIONS)
_WHOLE = rf"(?is)\A\s*{_BODY}\s*\z"
_PART = [rf"regexp_replace(regexp_extract(completion, '{_WHOLE}', {i + 1}), '^\s+|\s+$', '', 'g')" for i in range(4)]
_GOOD = f"(regexp_matches(completion, '{_WHOLE}') and " + " and ".join(f"{p} <> '' and not regexp_matches({p}, '(?i)</?({'|'.join(DIMENSIONS)})>')" for p in _PART) + ")"
_list = lambda c: f"coalesce('[' || array_to_string(list_transform({c}, lambda x: coalesce(to_json(x)::varchar, 'null')), ', ') || ']', 'null')"
_text = lambda c: f"coalesce(to_json({c})::varchar, 'null')"
_FIELDS = [(r, _list(r)) for r in sorted(RUBRIC)] + [("student_response", _text("completion")), ("task", _text("task"))]
_PAYLOAD = (
    "'{\"item\": {' || " + " || ', ' || ".join(f"'\"{n}\": ' || {v}" for n, v in _FIELDS)
    + f" || '}}, \"model\": \"{MODEL}\", \"prompt_version\": \"{completions.JUDGE_PROMPT_VERSION}\"}}'"
)
_KEYED = f"{cte('completion')}, {cte('judgment')}, keyed as (select *, sha256({_PAYLOAD}) as cache_key from completion where {_GOOD})"
_SEMANTIC = "(" + " + ".join(DIMENSIONS) + ") / 16.0::double"
#: two thirds of the well-formed completions are in the memo, each written twice; the later row counts
_MEMO = f"memo as (select cache_key, {', '.join(DIMENSIONS)} from keyed join judgment using (doc_id) where doc_id % 3 <> 0)"


def rows(spark, sf_dir):
    return adapted(spark, sf_dir, "completion")


def items(spark, sf_dir):
    return rw.judge_items(rows(spark, sf_dir), MODEL)


def memo(spark, sf_dir, asked):
    """Two thirds of the items with their judgments, each written twice: once stale, then right."""
    judged = asked.join(adapted(spark, sf_dir, "judgment"), F.col("completion_id") == F.col("doc_id")).where("doc_id % 3 <> 0")
    right, stale = F.struct(*DIMENSIONS), F.struct(*[F.lit(0).alias(d) for d in DIMENSIONS])
    both = F.array(F.struct(stale.alias("judgment"), F.col("doc_id").alias("seq")), F.struct(right.alias("judgment"), (F.col("doc_id") + 10**9).alias("seq")))
    return judged.select("cache_key", F.explode(both).alias("m")).select("cache_key", "m.judgment", "m.seq")


def keyed(spark, sf_dir):
    """(completion_id, cache_key) of all items, built once and written."""
    return written(items(spark, sf_dir).select("completion_id", "cache_key"), "items")


@query("with m as (select conv_id, list({'role': role, 'content': text} order by turn) as messages from conversations group by 1) select conv_id, messages[-1].content as text from m")
def completion_text(spark, sf_dir):
    turns = spark_table(spark, sf_dir, "conversations")
    chat = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return chat.select("conv_id", completions.completion_text(F.col("messages")).alias("text"))


@query(f"with {cte('completion')} select doc_id, {', '.join(f'case when {_GOOD} then {p} end as {d}' for p, d in zip(_PART, DIMENSIONS))} from completion")
def parse_completion(spark, sf_dir):
    parsed = rows(spark, sf_dir).select("doc_id", completions.parse_completion(F.col("completion")).alias("p"))
    return parsed.select("doc_id", *[F.col(f"p.{d}").alias(d) for d in DIMENSIONS])


@query(f"with {cte('completion')} select doc_id, case when {_GOOD} then 1.0::double else 0.0::double end as format from completion")
def format_reward(spark, sf_dir):
    return rows(spark, sf_dir).select("doc_id", completions.format_reward(F.col("completion")).alias("format"))


@query(f"with {cte('judgment')} select doc_id, {_SEMANTIC} as semantic from judgment")
def semantic_score(spark, sf_dir):
    return adapted(spark, sf_dir, "judgment").select("doc_id", completions.semantic_score(F.struct(*DIMENSIONS)).alias("semantic"))


@query(
    f"with {cte('completion')} select completion_id, completion_id // 64 as batch, row_number() over (partition by completion_id // 64 order by completion_id) - 1 as item_index, task,"
    f" {', '.join(f'array_to_string({r}, chr(10)) as {r}' for r in RUBRIC)}, completion as student_response from completion where {_GOOD}"
)
def judge_items(spark, sf_dir):
    """All items, numbered inside their batch: the well-formed ones of 64 completions that a trainer scores together."""
    batched = items(spark, sf_dir).withColumn("batch", F.expr("completion_id div 64"))
    numbered = rw.numbered(batched, "batch", "completion_id")
    return numbered.select("completion_id", "batch", "item_index", "item.task", *[F.array_join(f"item.{r}", "\n").alias(r) for r in RUBRIC], "item.student_response")


@query(f"with {_KEYED} select completion_id, cache_key from keyed")
def cache_key(spark, sf_dir):
    return items(spark, sf_dir).select("completion_id", "cache_key")


@query("select cast(conv_id % 50 as varchar) as cache_key, arg_max(text, conv_id * 1000 + turn) as text from conversations group by 1")
def memo_last_wins(spark, sf_dir):
    log = spark_table(spark, sf_dir, "conversations").selectExpr("cast(conv_id % 50 as string) as cache_key", "conv_id * 1000 + turn as seq", "text")
    return rw.latest(log)


@query(f"with {_KEYED}, {_MEMO} select distinct cache_key from keyed where cache_key not in (select cache_key from memo)")
def memo_misses(spark, sf_dir):
    asked = keyed(spark, sf_dir)
    return rw.misses(asked, memo(spark, sf_dir, asked)).select("cache_key")


@query(
    "with m as (select doc_id % 700 as k, arg_max(n_chars, (doc_id % 2) * 1000000000 + doc_id) as n_chars from documents group by 1) select distinct l.doc_id % 1400 as k, n_chars from labels l join m on m.k = l.doc_id % 1400"
)
def memo_store(spark, sf_dir):
    """A memo of the whole table in two commits, of which the later one counts; the labels' rows ask for keys, some of which it has not."""
    from pyspark.sql import types as T

    from tessera.sources.files import scratch
    from tessera.sources.memo import MemoStore

    schema = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("seq", T.LongType())])
    store = MemoStore(spark, scratch(spark, "memo"), schema, bucket_rows=200)
    key = lambda n: F.sha2((F.col("doc_id") % n).cast("string"), 256).alias("cache_key")
    docs = spark_table(spark, sf_dir, "documents")
    for k in (0, 1):
        # a commit has one row a key: the table's last one
        part = docs.where(f"doc_id % 2 = {k}").groupBy(key(700)).agg(F.max_by(F.col("n_chars").cast("long"), "doc_id").alias("n_chars"))
        store.append(part)
    asked = spark_table(spark, sf_dir, "labels").select((F.col("doc_id") % 1400).alias("k"), key(1400)).distinct()
    return asked.join(store.lookup(asked), "cache_key").select("k", "n_chars")


def measured(items):
    """A deterministic stand-in for a judge: lengths of what it is asked."""
    return [
        {"item_index": i["item_index"], "brainstorm": len(i["task"]) % 5, "principles": len(i["student_response"]) % 5, "synthesis": len(i["required_constraints"] or ()) % 5, "answer": len(i["student_response"]) % 3, "brief_reason": "length"}
        for i in items
    ]


@query(
    f"with {_KEYED} select completion_id, cast(length(task) % 5 as integer) as brainstorm, cast(length(completion) % 5 as integer) as principles,"
    " cast(coalesce(len(required_constraints), 0) % 5 as integer) as synthesis, cast(length(completion) % 3 as integer) as answer from keyed"
)
def judge_table_function(spark, sf_dir):
    """Every well-formed completion judged from SQL, sixteen partitions at a time."""
    asked = written(items(spark, sf_dir), "items")
    spark.udtf.register("judge_items", rw.judge_function(measured))
    asked.select("cache_key", "item", F.expr("completion_id % 16").alias("batch")).dropDuplicates(["cache_key"]).createOrReplaceTempView("items_to_judge")
    judged = spark.sql(f"select cache_key, {', '.join(DIMENSIONS)} from judge_items(table(items_to_judge) partition by batch)")
    return asked.select("completion_id", "cache_key").join(judged, "cache_key").select("completion_id", *DIMENSIONS)


_LAST = f"last as (select cache_key, {', '.join(f'arg_max({d}, doc_id) as {d}' for d in DIMENSIONS)} from keyed join judgment using (doc_id) where doc_id % 3 <> 0 group by 1)"


@query(f"with {_KEYED}, {_LAST} select completion_id, {_SEMANTIC} as semantic from keyed left join last using (cache_key)")
def memo_lookup(spark, sf_dir):
    asked = keyed(spark, sf_dir)
    return rw.lookup(asked, memo(spark, sf_dir, asked)).select("completion_id", "semantic")


@query(
    "with a as (select doc_id as item_index from documents where doc_id % 7 <> 0), g as (select item_index, count(*) as given from (select doc_id as item_index from documents where doc_id % 5 <> 0 union all select doc_id from documents where doc_id % 11 = 1) group by 1)"
    " select count(*) filter (g.item_index is null) as missing, count(*) filter (a.item_index is null) as unexpected, count(*) filter (given > 1) as repeated from a full join g using (item_index)"
)
def judgment_cover(spark, sf_dir):
    ids = spark_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_index"))
    return rw.cover_problems(ids.where("item_index % 7 <> 0"), ids.where("item_index % 5 <> 0").unionByName(ids.where("item_index % 11 = 1")))


_REWARD = f"""{_KEYED}, {_LAST}, scored as (
  select c.completion_id, case when k.completion_id is null then 0.0::double else 1.0::double end as format, coalesce({_SEMANTIC}, 0.0::double) as semantic
  from completion c left join keyed k using (completion_id) left join last using (cache_key)
), rewarded as (select *, format * (0.1::double + 0.9::double * semantic) as reward from scored)"""


@query(f"with {_REWARD} select * from rewarded")
def reward(spark, sf_dir):
    asked = keyed(spark, sf_dir)
    return rw.rewards(rows(spark, sf_dir), asked, memo(spark, sf_dir, asked))


@query(
    f"with {_REWARD}, g as (select *, completion_id // 4 as prompt_id from rewarded) select completion_id, prompt_id,"
    " round((reward - avg(reward) over w) / (coalesce(stddev_samp(reward) over w, 0.0) + 0.0001::double), 6) as advantage from g window w as (partition by prompt_id)"
)
def group_advantage(spark, sf_dir):
    """An extension: the trainer's own formula is not part of the corpus tools."""
    scored = reward(spark, sf_dir).withColumn("prompt_id", F.expr("completion_id div 4"))
    return rw.group_advantage(scored).select("completion_id", "prompt_id", F.round("advantage", 6).alias("advantage"))


@query(
    "select doc_id as step, case when doc_id % 3 = 0 then n_chars / 100.0::double end as reward, case when doc_id % 5 = 0 then 0.5::double end as \"rewards/design/mean\", case when doc_id % 50 = 0 then n_chars::double end as eval_loss from documents"
    " where doc_id % 20 <> 7 and (doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 50 = 0)"
)
def reward_history(spark, sf_dir):
    log = spark_table(spark, sf_dir, "documents").selectExpr(
        "case when doc_id % 20 <> 7 then doc_id end as step", "case when doc_id % 3 = 0 then n_chars / 100.0D end as reward", "case when doc_id % 5 = 0 then 0.5D end as `rewards/design/mean`",
        "case when doc_id % 50 = 0 then cast(n_chars as double) end as eval_loss", "'x' as note",
    )
    return audit.reward_history(log)
