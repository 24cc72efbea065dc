"""Queries over drafts, reviews and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import completions, drafts, prompts
from tessera.functions import text as tx
from tessera.operators import audit, project
from tessera.plans.adapters import adapted, cte, spark_table
from tessera.plans.registry import query
from tessera.schemas import DRAFT, REVIEW_FLAGS, RUBRIC

FOLD = "replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_PLAIN = FOLD.format("coalesce(task, '')")
_any = lambda phrases: "(" + " or ".join(f"contains({_PLAIN}, '{p}')" for p in phrases) + ")"
_SOURCE, _NUMBER, _CUE = _any(drafts.SOURCE_PHRASES), _any(drafts.NUMERIC_PHRASES), _any(drafts.SOLVING_CUES)
_dup = lambda c: f"len(list_distinct(list_transform({c}, lambda x: {FOLD.format('x')}))) <> len({c})"
_q = lambda c: f"coalesce(chr(39) || {c} || chr(39), 'None')"


def _errors() -> str:
    cases = [
        f"case when task_family is distinct from requested then 'teacher returned task family ' || {_q('task_family')} || '; expected ' || {_q('requested')} end",
        f"case when {_SOURCE} then 'task refers to unavailable source material' end", f"case when {_NUMBER} then 'task asks for a numerical result' end",
        f"case when not {_CUE} then 'task does not clearly request scientific problem solving' end",
    ]
    cases += [f"case when length(coalesce({f}, '')) not between {a} and {b} then '{f} length is outside {a}..{b} characters' end" for f, a, b in drafts.LENGTHS]
    cases += [f"case when coalesce(len({f}), 0) not between {a} and {b} then '{m}' end" for f, a, b, m in drafts.SIZES]
    for f in drafts.LIST_FIELDS:
        name = f.replace("_", " ")
        cases.append(f"case when coalesce(len({f}), 0) = 0 then '{name} is empty' end")
        cases.append(f"case when len({f}) > 0 and {_dup(f)} then '{name} contains duplicate items' end")
    found = f"list_filter([{', '.join(cases)}], lambda x: x is not null)"
    return f"case when usable then {found} else [coalesce(nullif(rejection_reason, ''), 'teacher marked source unusable')] end"


ERRORS = _errors()
SHA = "substr(sha256('{}:' || requested_split || ':' || requested || ':' || paper_id || ':' || source_sha256), 1, 20)".format(drafts.PROMPT_VERSION)
_FLAG_SQL = {
    "accept": "quality = 1", "task_is_self_contained": "doc_id % 13 <> 4", "task_does_not_reference_source": "true",
    "task_is_qualitative_not_numerical": "case when doc_id % 29 = 0 then null else true end", "brainstorm_is_diverse_and_plausible": "true",
    "principles_are_scientifically_supported": "toxic = 0", "synthesis_is_coherent": "true", "answer_is_supported": "true", "rubric_allows_valid_alternatives": "true",
}
_REVIEW = "review as (select doc_id, " + ", ".join(f"{e} as {f}" for f, e in _FLAG_SQL.items()) + ", case when doc_id % 2 = 0 then '' else 'not sound' end as critique from labels)"
_ALL_TRUE = " and ".join(f"coalesce({f}, false)" for f in REVIEW_FLAGS)


def cols(df_names):
    return {n: F.col(n) for n in df_names}


def draft_rows(spark, sf_dir):
    return adapted(spark, sf_dir, "draft")


def draft_columns():
    return cols(f.name for f in DRAFT.fields)


@query(f"with {cte('draft')} select doc_id, {_SOURCE} as mentions_source, {_NUMBER} as asks_number, {_CUE} as has_cue from draft")
def draft_phrase_flags(spark, sf_dir):
    return draft_rows(spark, sf_dir).select("doc_id", drafts.phrase_flags(F.col("task")).alias("f")).select("doc_id", "f.*")


@query(f"with {cte('draft')} select doc_id, {', '.join(f'{_dup(f)} as {f}' for f in ('brainstorm', 'required_constraints', 'failure_modes'))} from draft")
def draft_duplicates(spark, sf_dir):
    return draft_rows(spark, sf_dir).select("doc_id", *[tx.has_duplicates(F.col(f)).alias(f) for f in ("brainstorm", "required_constraints", "failure_modes")])


@query(f"with {cte('draft')} select doc_id, array_to_string({ERRORS}, ' | ') as errors from draft")
def draft_validation(spark, sf_dir):
    return draft_rows(spark, sf_dir).select("doc_id", F.array_join(drafts.draft_errors(draft_columns(), F.col("requested")), " | ").alias("errors"))


_FAM = ", ".join(f"'{f}'" for f in drafts.TASK_FAMILIES)
_BOUNDS = ", ".join(
    ["case when usable is null then 'usable' end", "case when rejection_reason is null then 'rejection_reason' end", f"case when task_family is not null and task_family not in ({_FAM}) then 'task_family' end"]
    + [f"case when {f} is not null and len({f}) not between {a} and {b} then '{f}' end" for f, (a, b) in drafts.LIST_BOUNDS.items()]
)


@query(f"with {cte('draft')} select doc_id, array_to_string(list_filter([{_BOUNDS}], lambda x: x is not null), ',') as fields from draft")
def draft_schema(spark, sf_dir):
    return draft_rows(spark, sf_dir).select("doc_id", F.array_join(drafts.schema_violations(draft_columns()), ",").alias("fields"))


def reviews(spark, sf_dir):
    return spark_table(spark, sf_dir, "labels").selectExpr("doc_id", *[f"{e} as {f}" for f, e in _FLAG_SQL.items()], "case when doc_id % 2 = 0 then '' else 'not sound' end as critique")


@query(f"with {_REVIEW} select doc_id, {_ALL_TRUE} as accepted, coalesce(nullif(critique, ''), 'critic rejected task') as reason from review")
def review_gate(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", drafts.review_accepts(cols(REVIEW_FLAGS)).alias("accepted"), drafts.review_reason(F.col("critique")).alias("reason"))


# drafts are loosened here, so that some pass validation
_LOOSE = """loose as (
  select d.doc_id, requested, true as usable, '' as rejection_reason, requested as task_family,
         case when doc_id % 5 = 0 then task else 'Explain and design ' || repeat('a plan ', 20) end as task, ['a', 'b', 'c'] as brainstorm, ['d', 'e', 'f'] as principles,
         repeat('s', 50) as synthesis, repeat('a', 40) as answer, ['g', 'h'] as required_constraints, ['i', 'j'] as evaluation_criteria, ['k'] as acceptable_alternatives, ['l'] as failure_modes,
         concat('p', cast(doc_id as varchar)) as paper_id, sha256(cast(doc_id as varchar)) as source_sha256, case when doc_id % 4 = 0 then 'sft_validation' else 'sft_train' end as requested_split
  from draft d
)"""
_DRAFTED = f"{cte('draft')}, {_LOOSE}, {_REVIEW}, drafted as (select *, {ERRORS} as errors from loose join review using (doc_id))"


def drafted(spark, sf_dir):
    loose = draft_rows(spark, sf_dir).selectExpr(
        "doc_id", "requested as requested_task_family",
        "named_struct('usable', true, 'rejection_reason', '', 'task_family', requested, 'task', case when doc_id % 5 = 0 then task else concat('Explain and design ', repeat('a plan ', 20)) end,"
        " 'brainstorm', array('a', 'b', 'c'), 'principles', array('d', 'e', 'f'), 'synthesis', repeat('s', 50), 'answer', repeat('a', 40), 'required_constraints', array('g', 'h'),"
        " 'evaluation_criteria', array('i', 'j'), 'acceptable_alternatives', array('k'), 'failure_modes', array('l')) as draft",
        "concat('p', cast(doc_id as string)) as paper_id", "'t' as title", "sha2(cast(doc_id as string), 256) as source_sha256", "'text' as source_text",
        "case when doc_id % 4 = 0 then 'sft_validation' else 'sft_train' end as requested_split", "named_struct('model', 'm') as teacher", "named_struct('model', 'm') as critic",
    )
    review = reviews(spark, sf_dir).select("doc_id", F.struct(*REVIEW_FLAGS, "critique").alias("review"))
    return loose.join(review, "doc_id")


@query(f"with {_DRAFTED} select {SHA} as task_id, paper_id, requested_split as split, requested as task_family, task from drafted where len(errors) = 0 and {_ALL_TRUE}")
def accept_reject(spark, sf_dir):
    return project.accepted_rows(drafted(spark, sf_dir)).select("task_id", "paper_id", "split", "task_family", "task")


@query(
    f"with {_DRAFTED} select paper_id, requested_split, requested as requested_task_family, case when len(errors) = 0 then 'critic' else 'teacher_validation' end as stage,"
    f" case when len(errors) = 0 then coalesce(nullif(critique, ''), 'critic rejected task') else array_to_string(errors, ' | ') end as reasons, len(errors) = 0 as reviewed from drafted where len(errors) > 0 or not ({_ALL_TRUE})"
)
def rejection_union(spark, sf_dir):
    return project.rejected_rows(drafted(spark, sf_dir)).select(
        "paper_id", "requested_split", "requested_task_family", "stage", F.array_join("reasons", " | ").alias("reasons"), F.col("review").isNotNull().alias("reviewed")
    )


_sql = lambda s: "'" + s.replace("'", "''") + "'"
_USER = f"'SCIENTIFIC PROBLEM-SOLVING TASK' || chr(10) || task || chr(10) || chr(10) || {_sql(prompts.RESPONSE_INSTRUCTIONS)}"
_PROMPT = f"'system: ' || {_sql(prompts.SYSTEM_TASK)} || chr(10) || 'user: ' || {_USER}"
_LIST = "array_to_string(list_transform({}, lambda x: '- ' || x), chr(10))"
_RENDER = " || chr(10) || ".join(
    f"'<{d}>' || chr(10) || {_LIST.format(d) if d in ('brainstorm', 'principles') else d} || chr(10) || '</{d}>'" for d in ("brainstorm", "principles", "synthesis", "answer")
)
_PUBLIC = "case split " + " ".join(f"when '{k}' then '{v}'" for k, v in project.SPLIT_NAMES.items()) + " end as split"


def flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(f"with {cte('canonical')} select doc_id, {_PROMPT} as prompt from canonical")
def task_prompt(spark, sf_dir):
    return adapted(spark, sf_dir, "canonical").select("doc_id", flat(prompts.task_prompt(F.col("task"))).alias("prompt"))


@query(f"with {cte('canonical')} select doc_id, {_RENDER} as completion from canonical")
def render_completion(spark, sf_dir):
    parts = cols(("brainstorm", "principles", "synthesis", "answer"))
    return adapted(spark, sf_dir, "canonical").select("doc_id", completions.render_completion(parts).alias("completion"))


@query(f"with {cte('canonical')} select task_id, paper_id, task_family, {_PUBLIC}, {_PROMPT} as prompt, 'assistant: ' || {_RENDER} as completion, source_license, source_url from canonical where split like 'sft%'")
def sft_projection(spark, sf_dir):
    rows = project.guard_columns(project.sft_rows(adapted(spark, sf_dir, "canonical")), project.SFT_FORBIDDEN)
    return rows.withColumn("prompt", flat(F.col("prompt"))).withColumn("completion", flat(F.col("completion")))


_RUB = ", ".join(f"array_to_string({r}, ' | ') as {r}" for r in RUBRIC)


@query(f"with {cte('canonical')} select task_id, paper_id, task_family, {_PUBLIC}, {_PROMPT} as prompt, task, {_RUB}, source_license, source_url from canonical where split not like 'sft%'")
def grpo_projection(spark, sf_dir):
    rows = project.guard_columns(project.rl_rows(adapted(spark, sf_dir, "canonical")), project.RL_FORBIDDEN)
    return rows.withColumn("prompt", flat(F.col("prompt"))).withColumns({r: F.array_join(r, " | ") for r in RUBRIC})


@query(f"with {cte('canonical')} select split, count(*) as n from canonical group by 1")
def split_sizes(spark, sf_dir):
    return project.split_sizes(adapted(spark, sf_dir, "canonical"))


@query(f"with {cte('canonical')}, p as (select {_PUBLIC}, task_id, task from canonical where split like 'sft%') select split, count(*) as n, min(task_id) as first, cast(sum(length(task)) as bigint) as chars from p group by 1")
def projection_roundtrip(spark, sf_dir):
    """Written to Parquet per split, read back, counted."""
    from tessera.sources import files

    rows = project.sft_rows(adapted(spark, sf_dir, "canonical")).select("split", "task_id", F.expr("substr(prompt[1].content, 33)").alias("said"))
    expected = {r.split: r.n for r in project.split_sizes(rows).collect()}
    back = files.save_projection(rows, files.scratch(spark, "projection"), expected)
    tail = len("\n\n" + prompts.RESPONSE_INSTRUCTIONS)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first"), F.sum(F.length("said") - tail).cast("long").alias("chars"))


_GUIDE = "case requested " + " ".join(f"when '{k}' then {_sql(v)}" for k, v in drafts.FAMILY_GUIDANCE.items()) + " end"


@query(
    f"with {cte('draft')} select doc_id, 'REQUESTED TASK FAMILY' || chr(10) || requested || chr(10) || chr(10) || 'FAMILY GUIDANCE' || chr(10) || {_GUIDE} || chr(10) || chr(10) || 'SCIENTIFIC SOURCE TEXT' || chr(10) || chr(10) || synthesis as prompt from draft"
)
def teacher_prompt(spark, sf_dir):
    return draft_rows(spark, sf_dir).select("doc_id", drafts.teacher_prompt(F.col("requested"), F.col("synthesis")).alias("prompt"))


@query(f"with {cte('canonical')} select split, task_family, count(*) as n, avg(length(task)) as avg_task_chars, avg(len(brainstorm)) as avg_ideas, avg(len(principles)) as avg_principles from canonical group by 1, 2")
def curriculum_audit(spark, sf_dir):
    return audit.curriculum(adapted(spark, sf_dir, "canonical"))


@query(f"with {cte('canonical')} select task_family, cast(len(required_constraints) as bigint) as x, cast(len(evaluation_criteria) as bigint) as y, count(*) as n from canonical group by all")
def rubric_depth(spark, sf_dir):
    return audit.rubric_depth(adapted(spark, sf_dir, "canonical"))


@query(
    f"with {cte('canonical')}, l as (select split, length(source_text) as length from canonical), b as (select split, min(length) as low, max(length) as high from l group by 1)"
    " select split, cast(case when high = low then 0 else least(floor((length - low) / ((high - low) / 25.0::double)), 24) end as bigint) as bin, count(*) as n, count(*) filter (length > 1024) as over from l join b using (split) group by 1, 2"
)
def length_histogram(spark, sf_dir):
    return audit.length_histogram(adapted(spark, sf_dir, "canonical").select("split", F.length("source_text").alias("length")))


@query(f"with {cte('canonical')} select split, task_id from canonical qualify row_number() over (partition by split order by task_id) <= case split when 'sft_train' then 8 when 'sft_validation' then 4 when 'test' then 1 else 0 end")
def smoke_subset(spark, sf_dir):
    return audit.smoke_subset(adapted(spark, sf_dir, "canonical"), {"sft_train": 8, "sft_validation": 4, "test": 1}).select("split", "task_id")


@query(f"with {cte('canonical')} select task_id, answer from canonical where split = 'test'")
def reference_lookup(spark, sf_dir):
    rows = adapted(spark, sf_dir, "canonical")
    return audit.lookup_reference(project.rl_rows(rows).where("split = 'test'"), rows).select("task_id", "answer")
