"""Rules that a drafted task and its review must meet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, fold, has_duplicates, normalize_ws, once
from tessera.schemas import REVIEW_FLAGS, RUBRIC

#: Task families, in the order of the quota table.
TASK_FAMILIES = (
    "mechanism_guided_design", "experimental_design", "troubleshooting", "hypothesis_development", "cross_domain_synthesis",
)

#: The version that is part of every task id.
PROMPT_VERSION = "scientific-problem-solving-v3"

#: What the request to a teacher says about each family.
FAMILY_GUIDANCE = {
    "mechanism_guided_design": "Ask the student to design or improve a scientific system by using mechanisms supported by the source.",
    "experimental_design": "Ask the student to propose experiments that test a mechanism, distinguish hypotheses, or diagnose a causal process.",
    "troubleshooting": "Present a plausible scientific failure or unexpected behavior and ask the student to develop and synthesize mechanistic remedies.",
    "hypothesis_development": "Present an observation and ask the student to develop several mechanistic hypotheses, identify discriminating principles, and select a leading explanation.",
    "cross_domain_synthesis": "Ask the student to transfer or combine scientific principles across systems into a defensible design or research direction.",
}

#: Phrases that point at a source the student cannot see.
SOURCE_PHRASES = (
    "according to the passage", "according to the source", "in the source text", "in the paper", "the article states",
)
#: Phrases that ask for a number.
NUMERIC_PHRASES = ("calculate", "compute", "estimate the value", "determine the value", "what is the value", "how many")
#: Cues of scientific problem solving; one at least must occur.
SOLVING_CUES = (
    "design", "develop", "propose", "hypoth", "experiment", "diagnos", "troubleshoot", "synthesi", "explain",
)
#: Bounds that the validator applies, and their messages.
LENGTHS = (("task", 120, 2000), ("synthesis", 40, 1200), ("answer", 30, 700))
SIZES = (("brainstorm", 3, 5, "brainstorm must contain three to five ideas"), ("principles", 3, 6, "principles must contain three to six items"))
#: List bounds of the declared draft.
LIST_BOUNDS = {
    "brainstorm": (3, 5), "principles": (3, 6), "required_constraints": (2, 8), "evaluation_criteria": (2, 8),
    "acceptable_alternatives": (1, 6), "failure_modes": (1, 6),
}
LIST_FIELDS = ("brainstorm", "principles", *RUBRIC)


def _quoted(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("None"))


def plain_task(task: Column) -> Column:
    return fold(normalize_ws(F.coalesce(task, F.lit(""))))


def plain_flags(plain: Column) -> dict[str, Column]:
    """What a task, folded and with single blanks, says."""
    return {
        "mentions_source": contains_any(plain, SOURCE_PHRASES),
        "asks_number": contains_any(plain, NUMERIC_PHRASES),
        "has_cue": contains_any(plain, SOLVING_CUES),
    }


def phrase_flags(task: Column) -> Column:
    """Struct of the three flags; the task is folded once."""
    return once(plain_task(task), lambda plain: F.struct(*[c.alias(n) for n, c in plain_flags(plain).items()]))


def draft_errors(draft: Mapping[str, Column], requested: Column) -> Column:
    """Messages in their order; an unusable draft has just its reason."""
    return once(plain_task(draft["task"]), lambda plain: _errors(draft, requested, plain_flags(plain)))


def _errors(draft: Mapping[str, Column], requested: Column, flags: Mapping[str, Column]) -> Column:
    rules: list[tuple[Column, Column | str]] = [
        (
            ~draft["task_family"].eqNullSafe(requested),
            F.concat(F.lit("teacher returned task family "), _quoted(draft["task_family"]), F.lit("; expected "), _quoted(requested)),
        ),
        (flags["mentions_source"], "task refers to unavailable source material"),
        (flags["asks_number"], "task asks for a numerical result"),
        (~flags["has_cue"], "task does not clearly request scientific problem solving"),
    ]
    for field, low, high in LENGTHS:
        n = F.length(F.coalesce(draft[field], F.lit("")))
        rules.append((~n.between(low, high), f"{field} length is outside {low}..{high} characters"))
    filled = {f: F.coalesce(draft[f], F.array().cast("array<string>")) for f in LIST_FIELDS}
    for field, low, high, message in SIZES:
        rules.append((~F.size(filled[field]).between(low, high), message))
    for field in LIST_FIELDS:
        name = field.replace("_", " ")
        rules.append((F.size(filled[field]) == 0, f"{name} is empty"))
        rules.append(((F.size(filled[field]) > 0) & has_duplicates(filled[field]), f"{name} contains duplicate items"))
    found = F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))
    reason = F.coalesce(F.nullif(draft["rejection_reason"], F.lit("")), F.lit("teacher marked source unusable"))
    return F.when(F.coalesce(draft["usable"], F.lit(False)), found).otherwise(F.array(reason))


def schema_violations(draft: Mapping[str, Column]) -> Column:
    """Names of fields outside the declared bounds (null lists are allowed), in field order."""
    bad = [
        F.when(draft["usable"].isNull(), F.lit("usable")),
        F.when(draft["rejection_reason"].isNull(), F.lit("rejection_reason")),
        F.when(draft["task_family"].isNotNull() & ~draft["task_family"].isin(*TASK_FAMILIES), F.lit("task_family")),
        *[F.when(draft[f].isNotNull() & ~F.size(draft[f]).between(*b), F.lit(f)) for f, b in LIST_BOUNDS.items()],
    ]
    return F.array_compact(F.array(*bad))


def review_accepts(review: Mapping[str, Column]) -> Column:
    """All nine flags are true; a null flag is not."""
    ok = F.lit(True)
    for flag in REVIEW_FLAGS:
        ok = ok & F.coalesce(review[flag], F.lit(False))
    return ok


def review_reason(critique: Column) -> Column:
    return F.coalesce(F.nullif(critique, F.lit("")), F.lit("critic rejected task"))


def task_id(split: Column, family: Column, paper: Column, sha: Column, version: str = PROMPT_VERSION) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(version), split, family, paper, sha), 256), 1, 20)


#: The requests to a teacher and a critic.
TEACHER_REQUEST = ("REQUESTED TASK FAMILY\n", "\n\nFAMILY GUIDANCE\n", "\n\nSCIENTIFIC SOURCE TEXT\n\n")
CRITIC_REQUEST = ("SCIENTIFIC SOURCE TEXT\n\n", "\n\nPROPOSED TASK\n\n")


def teacher_request(family: str, source_text: str) -> str:
    a, b, c = TEACHER_REQUEST
    return a + family + b + FAMILY_GUIDANCE[family] + c + source_text


def critic_request(source_text: str, draft_json: str) -> str:
    a, b = CRITIC_REQUEST
    return a + source_text + b + draft_json


def teacher_prompt(family: Column, source_text: Column) -> Column:
    guide = F.create_map(*[F.lit(x) for pair in FAMILY_GUIDANCE.items() for x in pair])
    a, b, c = map(F.lit, TEACHER_REQUEST)
    return F.concat(a, family, b, F.element_at(guide, family), c, source_text)


def critic_prompt(source_text: Column, draft_json: Column) -> Column:
    a, b = map(F.lit, CRITIC_REQUEST)
    return F.concat(a, source_text, b, draft_json)
