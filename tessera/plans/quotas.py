"""Queries over quotas, slots and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import drafts
from tessera.operators import audit, journal, quotas
from tessera.plans.adapters import EXCLUDED, adapted, cte, excluded, spark_table
from tessera.plans.registry import query
from tessera.plans.sources import POOL_SQL, pool, source_pool

TARGETS = {"sft_train": 111, "sft_validation": 33, "grpo_train": 75}
WEIGHTS = dict(zip(drafts.TASK_FAMILIES, (0.25, 0.25, 0.20, 0.15, 0.15)))
_T = ", ".join(f"('{k}', {v})" for k, v in TARGETS.items())
_W = ", ".join(f"('{k}', {v}::double)" for k, v in WEIGHTS.items())
QUOTA = f"""
grid as (select split, task_family, target::double * weight / sum(weight) over (partition by split) as raw, target from (values {_T}) t(split, target), (values {_W}) w(task_family, weight)),
floors as (select *, cast(floor(raw) as bigint) as whole from grid),
quota as (
  select split, task_family, whole + case when row_number() over (partition by split order by raw - whole desc, task_family) <= target - sum(whole) over (partition by split) then 1 else 0 end as target
  from floors
)"""
#: shares of a split in the whole table that its target asks for: some cells stay open, others are full
SHARES = {"sft_train": (6, 10), "sft_validation": (15, 100), "grpo_train": (1, 10)}
_WIDE = QUOTA.replace(f"(values {_T}) t(split, target)", "(" + " union all ".join(f"select '{k}' as split, count(*) * {a} // {b} as target from documents" for k, (a, b) in SHARES.items()) + ") t")
QUOTA_OF_TABLE = _WIDE.strip()
STATUS = f"""{cte('canonical')}, {QUOTA},
seen as (select split, task_family, count(*) as n from canonical group by 1, 2),
state as (select q.split, q.task_family, q.target, coalesce(n, 0) as observed from quota q left join seen using (split, task_family))"""


def quota(spark):
    return quotas.quota_table(spark, TARGETS, WEIGHTS)


def wide_quota(spark, rows):
    """Targets in proportion to the table, so that the whole of it leaves cells open."""
    n = rows.count()
    return quotas.quota_table(spark, {k: n * a // b for k, (a, b) in SHARES.items()}, WEIGHTS)


@query(f"with {QUOTA_OF_TABLE} select split, task_family, cast(target as bigint) as target from quota")
def quota_table(spark, sf_dir):
    """Targets are shares of the table's rows."""
    return wide_quota(spark, spark_table(spark, sf_dir, "documents"))


@query(f"with {cte('canonical')} select split, task_family, count(*) as n from canonical group by 1, 2")
def family_counts(spark, sf_dir):
    return quotas.family_counts(adapted(spark, sf_dir, "canonical"))


@query(f"with {STATUS} select cast(sum(target) as bigint) as target_total, cast(sum(least(observed, target)) as bigint) as accepted_total, bool_and(observed >= target) as complete from state")
def quota_status(spark, sf_dir):
    return quotas.quota_status(adapted(spark, sf_dir, "canonical"), quota(spark))


_OPEN = STATUS.replace(QUOTA, _WIDE)


@query(f"with {_OPEN} select split, task_family, cast(target - observed as bigint) as deficit from state where observed < target")
def quota_deficits(spark, sf_dir):
    rows = adapted(spark, sf_dir, "canonical")
    return quotas.quota_deficits(rows, wide_quota(spark, rows))


@query(
    f"with {_OPEN}, units as (select split, task_family, target, unnest(generate_series(least(observed, target), target - 1)) as ordinal from state where observed < target)"
    " select row_number() over (order by ordinal / target::double, split, task_family, ordinal) as slot, split, task_family from units order by slot limit 40"
)
def planned_slots(spark, sf_dir):
    rows = adapted(spark, sf_dir, "canonical")
    return quotas.planned_slots(rows, wide_quota(spark, rows), 40)


@query(
    f"with {cte('canonical')}, {QUOTA}, ranked as (select c.*, q.target, row_number() over (partition by c.split, c.task_family order by c.task_id, c.paper_id) as rn from canonical c join quota q using (split, task_family))"
    " select task_id, paper_id, split, task_family from ranked where rn <= target"
)
def quota_trim(spark, sf_dir):
    return quotas.trim(adapted(spark, sf_dir, "canonical"), quota(spark)).select("task_id", "paper_id", "split", "task_family")


_NUMBERED = POOL_SQL + ", numbered as (select *, row_number() over (order by order_key, doc_id) - 1 as stream_idx from pool)"


def numbered(spark, sf_dir):
    from pyspark.sql import Window

    rows = pool(spark, sf_dir)  # at most POOL rows
    return rows.withColumn("stream_idx", F.row_number().over(Window.orderBy("order_key", "doc_id")).cast("long") - 1)


@query(
    f"with {_NUMBERED}, {_OPEN}, units as (select split, task_family, target, unnest(generate_series(least(observed, target), target - 1)) as ordinal from state where observed < target),"
    " slots as (select row_number() over (order by ordinal / target::double, split, task_family, ordinal) as slot, split, task_family from units)"
    " select slot, paper_id, split, task_family from numbered join slots on slot = stream_idx + 1 where slot <= 16"
)
def slot_assignment(spark, sf_dir):
    rows = adapted(spark, sf_dir, "canonical")
    slots = quotas.planned_slots(rows, wide_quota(spark, rows), 16)
    return quotas.assign(numbered(spark, sf_dir), slots).select("slot", "paper_id", "split", "task_family")


@query(
    f"with {cte('canonical')} select doc_id, substr(sha256('{drafts.PROMPT_VERSION}:' || split || ':' || task_family || ':' || paper_id || ':' || source_sha256), 1, 20) as task_id from canonical"
)
def task_id(spark, sf_dir):
    rows = adapted(spark, sf_dir, "canonical")
    return rows.select("doc_id", drafts.task_id(F.col("split"), F.col("task_family"), F.col("paper_id"), F.col("source_sha256")).alias("task_id"))


_JOURNALS = f"""{cte('canonical')},
accepted as (select paper_id, split, task_family, case when doc_id % 50 = 0 then 'older-version' else '{drafts.PROMPT_VERSION}' end as prompt_version, case when doc_id % 40 = 0 then null when doc_id % 60 = 0 then 'elsewhere' else 'corpus' end as source_dataset, 'train' as source_split from canonical where doc_id % 3 = 0),
rejected as (select paper_id, split as requested_split, case when doc_id % 70 = 1 then 'poetry' else task_family end as requested_task_family, case when doc_id % 6 = 1 then 'api_error' else 'critic' end as stage from canonical where doc_id % 3 = 1)"""


def journals(spark, sf_dir):
    rows = adapted(spark, sf_dir, "canonical")
    a = rows.where("doc_id % 3 = 0").selectExpr(
        "paper_id", "split", "task_family", f"case when doc_id % 50 = 0 then 'older-version' else '{drafts.PROMPT_VERSION}' end as prompt_version",
        "case when doc_id % 40 = 0 then null when doc_id % 60 = 0 then 'elsewhere' else 'corpus' end as source_dataset", "'train' as source_split",
    )
    r = rows.where("doc_id % 3 = 1").selectExpr(
        "paper_id", "split as requested_split", "case when doc_id % 70 = 1 then 'poetry' else task_family end as requested_task_family",
        "case when doc_id % 6 = 1 then 'api_error' else 'critic' end as stage",
    )
    return rows, a, r


@query(f"with {_JOURNALS}, u as (select * from accepted union all by name select * from rejected) select paper_id, split, requested_split, stage, prompt_version from u")
def journal_union(spark, sf_dir):
    _, a, r = journals(spark, sf_dir)
    return journal.union(a, r).select("paper_id", "split", "requested_split", "stage", "prompt_version")


@query(f"with {_JOURNALS} select paper_id from canonical where paper_id not in (select paper_id from accepted union all select paper_id from rejected)")
def resume_remaining(spark, sf_dir):
    rows, a, r = journals(spark, sf_dir)
    return journal.remaining(rows, a, r).select("paper_id")


@query(
    f"with {_JOURNALS}, left_over as (select paper_id, row_number() over (order by doc_id) - 1 as seat from canonical where paper_id not in (select paper_id from accepted union all select paper_id from rejected))"
    " select paper_id, seat // 8 as batch, seat % 8 as place from left_over"
)
def batch_plan(spark, sf_dir):
    """All sources that the journals have not tried, in batches of eight."""
    rows, a, r = journals(spark, sf_dir)
    return quotas.batches(journal.remaining(rows, a, r), 8, order="doc_id")


@query(
    f"with {_JOURNALS} select paper_id, 'accepted' as journal, case when doc_id % 2 = 0 then 1 else 2 end as since from canonical where doc_id % 3 = 0"
    " union all select paper_id, 'rejected', case when doc_id % 2 = 0 then 1 else 2 end from canonical where doc_id % 3 = 1 and doc_id % 7 <> 0"
)
def journal_commits(spark, sf_dir):
    """Two batches of both journals, a commit each, then one that replaces the rejected rows; every row with the batch that brought it."""
    from pyspark.sql import types as T

    from tessera.sources import files
    from tessera.sources.commits import CommitLog

    schema, folder = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("doc_id", T.LongType())]), files.scratch(spark, "journals")
    log = CommitLog(spark, f"{folder}/log", {n: (f"{folder}/{n}", schema) for n in ("accepted", "rejected")})
    rows, versions = adapted(spark, sf_dir, "canonical").select("paper_id", "doc_id"), []
    for k in (0, 1):
        part = rows.where(f"doc_id % 2 = {k}")
        versions.append(log.commit({"accepted": part.where("doc_id % 3 = 0"), "rejected": part.where("doc_id % 3 = 1")}))
    log.commit(replace={"rejected": log.read("rejected").where("doc_id % 7 <> 0")}, expected=versions[1])
    out = []
    for name in ("accepted", "rejected"):
        first = log.read(name, versions[0]).select("paper_id", F.lit(1).alias("since"))
        now = log.read(name).select("paper_id").join(first, "paper_id", "left")
        out.append(now.select("paper_id", F.lit(name).alias("journal"), F.coalesce("since", F.lit(2)).alias("since")))
    return out[0].unionByName(out[1])


@query(
    f"with {_JOURNALS}, done as (select paper_id from accepted union select paper_id from rejected) select paper_id from canonical where paper_id not in (select paper_id from done)"
    " order by doc_id limit greatest((select count(*) from canonical) * 4 // 5 - (select count(*) from done), 0)"
)
def attempt_budget(spark, sf_dir):
    rows, a, r = journals(spark, sf_dir)
    return journal.within_budget(rows, rows.count() * 4 // 5, a, r, order="doc_id").select("paper_id")


@query(
    f"with {_JOURNALS}, u as (select * from accepted union all by name select * from rejected)"
    f" select count(*) filter (prompt_version <> '{drafts.PROMPT_VERSION}') as prompt_version, count(*) filter (source_dataset <> 'corpus') as source_dataset, count(*) filter (source_split <> 'train') as source_split,"
    " count(*) filter (coalesce(split, requested_split) not in ('sft_train', 'sft_validation')) as split,"
    f" count(*) filter (coalesce(task_family, requested_task_family) not in ({', '.join(repr(f) for f in drafts.TASK_FAMILIES)})) as task_family, 0::bigint as teacher_model, 0::bigint as critic_model from u"
)
def journal_violations(spark, sf_dir):
    _, a, r = journals(spark, sf_dir)
    return journal.violations(
        journal.union(a, r), prompt_version=drafts.PROMPT_VERSION, dataset="corpus", split_name="train", splits=("sft_train", "sft_validation"),
        families=drafts.TASK_FAMILIES, teacher="t", critic="c",
    )


@query(
    "with o as (select source as name, count(*) as target from documents where doc_id % 2 = 0 group by 1), n as (select source as name, count(*) as target from documents where doc_id % 3 = 0 group by 1)"
    " select name, o.target as old, n.target as new from o join n using (name) where n.target < o.target"
)
def target_decrease(spark, sf_dir):
    docs = spark_table(spark, sf_dir, "documents")
    count = lambda d: d.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("target"))
    return journal.decreased_targets(count(docs.where("doc_id % 2 = 0")), count(docs.where("doc_id % 3 = 0")))


@query(f"with {_JOURNALS} select (select count(*) from accepted) as accepted, (select count(*) from rejected) as rejected, (select count(*) from accepted) / greatest((select count(*) from accepted) + (select count(*) from rejected), 1)::double as rate")
def acceptance_rate(spark, sf_dir):
    _, a, r = journals(spark, sf_dir)
    return audit.acceptance_rate(a, r)


@query(f"with {POOL_SQL}, {EXCLUDED} select paper_id from pool where paper_id in (select paper_id from excluded)")
def paper_overlap(spark, sf_dir):
    return journal.overlap(source_pool(spark, sf_dir), excluded(spark, sf_dir))


SMALL = {"sft_train": 4, "sft_validation": 2}


def scripted(source: dict, split: str, family: str) -> dict:
    """A deterministic stand-in for a remote provider: a fixed good draft, turned down for every third paper."""
    paper = int(source["paper_id"])
    if paper % 9 == 5:
        raise RuntimeError("scripted failure")
    items = [f"item {i} of {paper}" for i in range(3)]
    flags = {f: True for f in ("accept", "task_is_self_contained", "task_does_not_reference_source", "task_is_qualitative_not_numerical", "brainstorm_is_diverse_and_plausible", "principles_are_scientifically_supported", "synthesis_is_coherent", "answer_is_supported", "rubric_allows_valid_alternatives")}
    return {
        "draft": {
            "usable": True, "rejection_reason": "", "task_family": family, "task": "Design an experiment. " * 8, "brainstorm": items, "principles": items,
            "synthesis": "s" * 60, "answer": "a" * 60, "required_constraints": items, "evaluation_criteria": items, "acceptable_alternatives": items, "failure_modes": items,
        },
        "review": {**flags, "accept": paper % 3 != 0, "critique": "" if paper % 3 else "scripted"},
        "teacher": {"response_id": "r", "model": "scripted", "usage": None}, "critic": {"response_id": "r", "model": "scripted", "usage": None},
    }


_SMALL_QUOTA = QUOTA.replace(_T, ", ".join(f"('{k}', {v})" for k, v in SMALL.items()))


@query(
    f"with {_NUMBERED}, {_SMALL_QUOTA}, good as (select *, row_number() over (order by stream_idx) as k from numbered where paper_id::bigint % 3 <> 0 and paper_id::bigint % 9 <> 5),"
    " units as (select split, task_family, target, unnest(generate_series(0, target - 1)) as ordinal from quota where target > 0),"
    " slots as (select row_number() over (order by ordinal / target::double, split, task_family, ordinal) as k, split, task_family from units)"
    f" select paper_id, split, task_family, substr(sha256('{drafts.PROMPT_VERSION}:' || split || ':' || task_family || ':' || paper_id || ':' || source_sha256), 1, 20) as task_id from good join slots using (k)"
)
def quota_fill(spark, sf_dir):
    """One attempt per batch, so the k-th accepted source takes the k-th slot."""
    from tessera.sources.files import scratch
    from tessera.streaming.fill import fill_quotas

    folder = scratch(spark, "quota_fill")
    done = fill_quotas(
        spark, numbered(spark, sf_dir), SMALL, WEIGHTS, accepted_path=f"{folder}/accepted", rejected_path=f"{folder}/rejected", provider=scripted, concurrency=1
    )
    return done.select("paper_id", "split", "task_family", "task_id")


@query(
    f"with d as (select doc_id, cast(doc_id as varchar) as paper_id, sha256(text) as source_sha256, row_number() over (order by doc_id) as k from documents), n as (select count(*) * 4 // 9 as target from d),"
    f" tried as (select paper_id, substr(sha256('{drafts.PROMPT_VERSION}:sft_train:{drafts.TASK_FAMILIES[0]}:' || paper_id || ':' || source_sha256), 1, 20) as task_id from d, n where k <= 2 * target and doc_id % 3 <> 0 and doc_id % 9 <> 5)"
    " select paper_id, task_id from (select *, row_number() over (order by task_id, paper_id) as r from tried) t, n where r <= target"
)
def quota_fill_tasks(spark, sf_dir):
    """The whole table as the pool, calls on many tasks, more attempts than slots: nothing is known of the acceptance rate, so two a slot.

    What is accepted beyond the target stays in the journal; the selection is the exact trim.
    """
    from tessera.sources.files import scratch
    from tessera.streaming.fill import fill_quotas

    folder, tasks = scratch(spark, "quota_fill_tasks"), 16
    docs = spark_table(spark, sf_dir, "documents")
    target = docs.count() * 4 // 9
    fixed = {"title": "", "source_dataset": "corpus", "source_split": "train", "source_url": "", "source_license": "CC0", "source_license_normalized": "CC0"}
    sources = docs.select(
        F.col("doc_id").cast("string").alias("paper_id"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.col("text").alias("source_text"),
        F.sha2("text", 256).alias("source_sha256"), F.col("doc_id").alias("stream_idx"),
    )
    weights = dict.fromkeys(drafts.TASK_FAMILIES, 0.0) | {drafts.TASK_FAMILIES[0]: 1.0}
    done = fill_quotas(
        spark, sources, {"sft_train": target}, weights, accepted_path=f"{folder}/accepted", rejected_path=f"{folder}/rejected", provider=scripted,
        concurrency=-(-2 * target // tasks), tasks=tasks, overplan=True,
    )
    return done.select("paper_id", "task_id")
