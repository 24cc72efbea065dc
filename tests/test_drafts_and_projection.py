import pytest
from pyspark.sql import functions as F

from tessera.functions import drafts
from tessera.operators import project
from tessera.schemas import DRAFT

GOOD = {
    "usable": True, "rejection_reason": "", "task_family": "experimental_design", "task": "Design an experiment that tells two mechanisms apart. " * 4,
    "brainstorm": ["a", "b", "c"], "principles": ["d", "e", "f"], "synthesis": "s" * 50, "answer": "a" * 40, "required_constraints": ["g", "h"],
    "evaluation_criteria": ["i", "j"], "acceptable_alternatives": ["k"], "failure_modes": ["l"],
}


def errors(spark, **change):
    row = GOOD | change
    df = spark.createDataFrame([tuple(row[f.name] for f in DRAFT.fields)], DRAFT)
    return df.select(drafts.draft_errors({n: F.col(n) for n in df.columns}, F.lit("experimental_design"))).first()[0]


def test_rules_and_their_order(spark):
    assert errors(spark) == []
    assert errors(spark, task="Calculate the value. " + GOOD["task"]) == ["task asks for a numerical result"]
    assert errors(spark, task="According  to the\nPassage, " + GOOD["task"]) == ["task refers to unavailable source material"]
    assert errors(spark, usable=False) == ["teacher marked source unusable"]
    assert errors(spark, usable=False, rejection_reason="no data") == ["no data"]
    assert errors(spark, brainstorm=["STRASSE", " straße ", "c"]) == ["brainstorm contains duplicate items"]
    empty = errors(spark, task_family=None, task=None, synthesis=None, answer=None, **dict.fromkeys(("brainstorm", "principles", "required_constraints", "evaluation_criteria", "acceptable_alternatives", "failure_modes")))
    assert empty == [
        "teacher returned task family None; expected 'experimental_design'", "task does not clearly request scientific problem solving",
        "task length is outside 120..2000 characters", "synthesis length is outside 40..1200 characters", "answer length is outside 30..700 characters",
        "brainstorm must contain three to five ideas", "principles must contain three to six items", "brainstorm is empty", "principles is empty",
        "required constraints is empty", "evaluation criteria is empty", "acceptable alternatives is empty", "failure modes is empty",
    ]


def records(spark):
    body = [f.name for f in DRAFT.fields if f.name not in ("usable", "rejection_reason", "task_family")]
    rows = [(f"t{i}", f"p{i}", s, "experimental_design", *[GOOD[b] for b in body], "CC-BY-4.0", "u", "hidden source") for i, s in enumerate(["sft_train", "sft_validation", "grpo_train", "grpo_validation", "test"])]
    types = {f.name: f.dataType.simpleString() for f in DRAFT.fields}
    schema = "task_id string, paper_id string, split string, task_family string, " + ", ".join(f"{b} {types[b]}" for b in body) + ", source_license string, source_url string, source_text string"
    return spark.createDataFrame(rows, schema)


def test_projections_do_not_leak(spark):
    sft = project.guard_columns(project.sft_rows(records(spark)), project.SFT_FORBIDDEN)
    rl = project.guard_columns(project.rl_rows(records(spark)), project.RL_FORBIDDEN)
    assert {r.split for r in sft.collect()} == {"train", "validation"} and {r.split for r in rl.collect()} == {"train", "validation", "test"}
    row = sft.first()
    assert row.completion[0].content.startswith("<brainstorm>\n- a\n- b\n- c\n</brainstorm>\n<principles>\n- d")
    assert [m.role for m in row.prompt] == ["system", "user"] and "hidden source" not in str(row)
    assert "s" * 50 not in str(rl.first())
    with pytest.raises(RuntimeError, match="source_text"):
        project.guard_columns(records(spark), project.SFT_FORBIDDEN)
    assert project.wrong_sizes(rl, {"train": 1, "validation": 2}) == {"validation": (1, 2), "test": (1, 0)}
    with pytest.raises(ValueError, match="absent|missing"):
        project.require_splits(sft, ("train", "test"), ("prompt",))
    with pytest.raises(ValueError, match="rubric"):
        project.require_splits(sft, ("train",), ("rubric",))
