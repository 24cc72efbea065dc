"""What a student sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The system turn and the response instructions of every task.
SYSTEM_TASK = (
    "Solve the self-contained scientific problem-solving task. Develop several distinct candidate ideas, identify the governing "
    "scientific principles and constraints, synthesize the strongest direction, and give a concise final answer."
)
RESPONSE_INSTRUCTIONS = """Respond in exactly this order, with no text outside the tags:
<brainstorm>
three to five distinct candidate ideas
</brainstorm>
<principles>
the scientific constraints and design principles
</principles>
<synthesis>
compare or combine the candidates using the principles
</synthesis>
<answer>
a concise final proposal or conclusion
</answer>"""

#: The instructions of teacher, critic and judge; prompt versions in ids and memo keys stand for them.
TEACHER_SYSTEM = """You create high-quality scientific problem-solving tasks from source text.

The student will see only the task, never the source. Use the source as scientific grounding
for one NEW, SELF-CONTAINED task. Put all scenario facts and constraints needed to solve the
task directly in the task. Never mention a passage, paper, source, article, or unavailable
material. Focus on qualitative mechanisms, scientific design, hypotheses, experimentation,
troubleshooting, and synthesis—not arithmetic or retrieval.

Create a reference work product with:
1. three to five distinct candidate ideas in brainstorm;
2. scientific constraints and design principles;
3. a synthesis that compares or combines candidates using those principles; and
4. a concise, decisive answer.

HARD LENGTH LIMITS (count characters, including spaces):
- task: 300–1,600 characters;
- each brainstorm idea: 60–240 characters;
- each principle: 40–200 characters;
- synthesis: 150–750 characters;
- answer: 120–600 characters;
- each hidden-rubric item: 30–180 characters.
Treat these as strict output requirements. Prefer one compact paragraph for synthesis and
one compact paragraph for answer. Do not turn the task or answer into a long protocol.

Also create a hidden grading rubric containing required constraints, evaluation criteria,
acceptable alternative approaches, and failure modes. The reference is one strong solution,
not the only valid solution. Never introduce scientific claims unsupported by the source.
When unusable, set task_family and every task, response, and rubric field to null."""
CRITIC_SYSTEM = """You are a strict scientific dataset reviewer.

Compare the proposed task and reference work product with the source text. Accept only when:
- the task stands alone and never refers to the source;
- the task is qualitative rather than a calculation exercise;
- brainstorming contains genuinely distinct, scientifically plausible directions;
- principles and constraints are supported;
- synthesis uses the stated principles rather than merely repeating ideas;
- the final answer is supported and responsive; and
- the hidden rubric permits scientifically defensible alternatives.

Reject answer leakage, unsupported claims, trivial variations presented as diverse ideas,
incoherent synthesis, or a rubric that rewards only phrase matching."""
JUDGE_SYSTEM = """You are a strict but open-minded grader of scientific problem solving.

For every item, score the student's structured response independently on four dimensions.
Use integer scores from 0 to 4:
0 = missing, irrelevant, or scientifically wrong
1 = weak, with major omissions or errors
2 = adequate but incomplete
3 = strong and mostly complete
4 = excellent, coherent, and scientifically defensible

Dimensions:
- brainstorm: distinct, relevant, scientifically plausible candidate ideas;
- principles: appropriate scientific constraints and design principles;
- synthesis: candidates are compared or combined coherently using the principles;
- answer: the final proposal is scientifically sound and directly answers the task.

Use the hidden rubric as criteria, not as a phrase-matching answer key. Accept scientifically
valid alternatives. Penalize unsupported claims, violated constraints, contradictions,
trivial variations presented as different ideas, and synthesis that does not support the
answer. Return exactly one judgment for every item_index."""
JUDGE_REQUEST = "Grade this JSON batch. Score each response independently and allow valid alternatives.\n\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def task_prompt(task: Column) -> Column:
    said = F.concat(F.lit("SCIENTIFIC PROBLEM-SOLVING TASK\n"), task, F.lit("\n\n" + RESPONSE_INSTRUCTIONS))
    return F.array(message("system", F.lit(SYSTEM_TASK)), message("user", said))
