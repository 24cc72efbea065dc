"""Standard tables in the shapes the operators read, written once for Spark and once for the oracle.

Every adapter is a list of ``expression as name`` over one table; a dialect supplies the few functions
whose names differ, so both engines see the same rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.drafts import TASK_FAMILIES


class Spark:
    text, first, div = "string", 0, "div"

    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    lines = staticmethod(lambda x: f"split({x}, chr(10))")
    part = staticmethod(lambda a, start, n: f"slice({a}, {start}, {n})")
    empty = "cast(array() as array<string>)"
    glue = staticmethod(lambda a, b: f"concat({a}, {b})")


class Duck:
    text, first, div = "varchar", 1, "//"

    sha = staticmethod(lambda x: f"sha256({x})")
    lines = staticmethod(lambda x: f"string_split({x}, chr(10))")
    part = staticmethod(lambda a, start, n: f"list_slice({a}, {start}, {start} + ({n}) - 1)")
    empty = "cast([] as varchar[])"
    glue = staticmethod(lambda a, b: f"list_concat({a}, {b})")


def pick(number: str, *values: str) -> str:
    """``values`` by number modulo their count."""
    cases = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {number} % {len(values)} {cases} end"


FAMILY = [f"'{f}'" for f in TASK_FAMILIES]
SPLITS = ["'sft_train'"] * 5 + ["'sft_validation'", "'grpo_train'", "'grpo_train'", "'grpo_validation'", "'test'"]


def raw_source(d) -> list[str]:
    doc = f"cast(doc_id as {d.text})"
    return [
        "doc_id", f"cast(case when doc_id % 10 = 1 then doc_id - 1 else doc_id end as {d.text}) as id", f"cast(null as {d.text}) as paper_id",
        "replace(text, chr(10), concat(chr(10), chr(10))) as text", f"cast(null as {d.text}) as raw_fulltext",
        pick("doc_id", "'not json'", "'[1]'", f"""concat('{{"oa_license":"CC-BY-4.0","oa_url":"https://example.org/', {doc}, '"}}')""", """'{"oa_license":"","license":"CC0"}'""", "'{}'") + " as metadata",
        pick("doc_id", "'CC-BY-4.0'", "'cc0'", "'CC BY-SA 4.0'", "'Public Domain'", "'CC-BY-NC-4.0'", "''", "'CC-BY-3.0'", "'CC-BY'") + " as license",
        pick("doc_id", "'pubmed'", "''", *["'S2ORC/v3'"] * 7) + " as source",
        f"{d.lines('text')}[{d.first}] as title",
    ]


def canonical(d) -> list[str]:
    doc, lines = f"cast(doc_id as {d.text})", d.lines("text")
    return [
        "doc_id", f"substr({d.sha(f'concat({chr(39)}task:{chr(39)}, {doc})')}, 1, 20) as task_id", f"concat('p', {doc}) as paper_id",
        pick("doc_id", *SPLITS) + " as split", pick(f"(doc_id {d.div} 10)", *FAMILY) + " as task_family",
        "concat('Design ', text) as task", f"{d.part(lines, 1, '1 + doc_id % 4')} as brainstorm", f"{d.part(lines, 2, '1 + doc_id % 5')} as principles",
        "text as synthesis", "concat(text, ' so far') as answer", f"{d.part(lines, 1, '2 + doc_id % 3')} as required_constraints",
        f"{d.part(lines, 2, '2 + doc_id % 2')} as evaluation_criteria", f"{d.part(lines, 1, 1)} as acceptable_alternatives", f"{d.part(lines, 3, 2)} as failure_modes",
        "'CC-BY-4.0' as source_license", f"concat('https://example.org/', {doc}) as source_url", "text as source_text", f"{d.sha('text')} as source_sha256",
    ]


def draft(d) -> list[str]:
    lines = d.lines("text")
    # whole texts (mostly too long for the validator), single lines and doubled lines (mostly within its bounds)
    line, by = f"{lines}[{d.first}]", lambda n: f"(doc_id % {n})"
    twice = f"concat({line}, ' ', {line})"
    openings = ["'Explain and design '"] * 3 + ["'According  to the Passage, design '", "'Calculate, then propose '", "''", "'Wie groß? Explain '"] + ["'Propose a test: '"] * 4
    return [
        "doc_id", pick("doc_id", *FAMILY) + " as requested", "doc_id % 11 <> 0 as usable", "case when doc_id % 33 = 0 then 'too short' else '' end as rejection_reason",
        f"case when doc_id % 11 = 1 then {FAMILY[4]} when doc_id % 11 = 2 then null else {pick('doc_id', *FAMILY)} end as task_family",
        f"concat({pick('doc_id', *openings)}, {pick(by(13), 'text', line, twice, line, 'text')}) as task",
        f"{d.part(lines, 1, '2 + doc_id % 5')} as brainstorm", f"{d.part(lines, 1, '2 + doc_id % 6')} as principles",
        f"{pick(by(9), line, 'text', twice)} as synthesis", f"case when doc_id % 19 = 0 then null else {pick(by(8), line, 'text', line)} end as answer",
        f"case when doc_id % 7 = 0 then {d.glue(d.part(lines, 1, 2), d.part(lines, 1, 1))} else {d.part(lines, 1, 3)} end as required_constraints",
        f"{d.part(lines, 2, '1 + doc_id % 3')} as evaluation_criteria", f"case when doc_id % 17 = 0 then null else {d.part(lines, 1, 1)} end as acceptable_alternatives",
        f"case when doc_id % 13 = 0 then {d.empty} else {d.part(lines, 1, 2)} end as failure_modes",
    ]


def completion(d) -> list[str]:
    # the whole text, and its second half
    a = "replace(text, '<', '')"
    b = f"substr({a}, cast(length({a}) {d.div} 2 as int) + 1)"
    tag = lambda name, body: f"concat('<{name}>', {body}, '</{name}>')"
    four = [tag("brainstorm", a), tag("principles", b), tag("synthesis", a), tag("answer", f"concat('x', {b})")]
    whole = lambda *parts: "concat(" + ", chr(10), ".join(parts) + ")"
    shout = [p.replace("<brainstorm>", "<BRAINSTORM>").replace("</answer>", "</Answer>") for p in four]
    return [
        "doc_id", "doc_id as completion_id", "concat('Design ', text) as task",
        *[f"{d.part(d.lines('text'), i + 1, 2)} as {r}" for i, r in enumerate(("required_constraints", "evaluation_criteria", "acceptable_alternatives", "failure_modes"))],
        pick(
            "doc_id", whole(*four), whole(*four[:3]), whole(four[1], four[0], *four[2:]), whole(*shout),
            whole(*four[:3], tag("answer", tag("synthesis", "''"))), whole(four[0], tag("principles", "'  '"), *four[2:]),
            f"concat({whole(*four)}, ' done')", f"concat(chr(10), {whole(*four)}, ' ', chr(10))",
        ) + " as completion",
    ]


def judgment(d) -> list[str]:
    return ["doc_id", *[f"cast((doc_id * {p}) % 5 as int) as {n}" for p, n in ((3, "brainstorm"), (7, "principles"), (11, "synthesis"), (13, "answer"))]]


ADAPTERS: dict[str, Callable] = {f.__name__: f for f in (raw_source, canonical, draft, completion, judgment)}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, adapter: str, table: str = "documents") -> DataFrame:
    return spark_table(spark, sf_dir, table).selectExpr(*ADAPTERS[adapter](Spark))


def cte(adapter: str, table: str = "documents") -> str:
    """The adapter as a named subquery of the oracle."""
    return f"{adapter} as (select {', '.join(ADAPTERS[adapter](Duck))} from {table})"


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("paper_id"))


EXCLUDED = "excluded as (select cast(doc_id as varchar) as paper_id from documents where doc_id % 7 = 0)"
