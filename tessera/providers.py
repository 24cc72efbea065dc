"""Teacher, critic and judge over an injected transport: requests, retries, structured answers, refusals.

A transport is a function (request document, timeout in seconds) -> response document, so nothing here needs a network: the caller
brings a client, tests bring a function.  Providers are pickled to executors with their transport.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from tessera.functions import drafts
from tessera.functions.prompts import CRITIC_SYSTEM, JUDGE_REQUEST, JUDGE_SYSTEM, TEACHER_SYSTEM

Transport = Callable[[dict, float], Mapping]
USAGE = ("input_tokens", "output_tokens", "total_tokens")


class Refused(RuntimeError):
    """The model declined the request."""


class NoOutput(RuntimeError):
    """The response holds no parsed output."""


def structured(response: Mapping) -> Mapping:
    """The parsed output of a response: its own, else the first that a message holds."""
    if isinstance(response.get("output_parsed"), Mapping):
        return response["output_parsed"]
    parts = [part for out in response.get("output") or () if out.get("type") == "message" for part in out.get("content") or ()]
    for part in parts:
        if part.get("refusal"):
            raise Refused(f"the request was refused: {part['refusal']}")
        if isinstance(part.get("parsed"), Mapping):
            return part["parsed"]
    raise NoOutput("the response holds no structured output")


def call_meta(response: Mapping, model: str) -> dict[str, Any]:
    """Response id, model and token counts, as the journals keep them."""
    counts = response.get("usage") or {}
    return {
        "response_id": response.get("id"), "model": response.get("model") or model,
        "usage": {k: int(counts[k]) for k in USAGE if counts.get(k) is not None},
    }


@dataclass(frozen=True)
class Caller:
    """One model behind a transport.  Timeouts and lost connections are tried again, with doubled waits; other errors are not."""

    transport: Transport
    model: str
    max_retries: int = 3
    timeout: float = 120.0
    wait: float = 0.5

    def __post_init__(self):
        if self.max_retries < 0 or self.timeout <= 0:
            raise ValueError("retries cannot be negative and the timeout must be positive")

    def ask(self, system: str, user: str, form: str) -> tuple[Mapping, dict[str, Any]]:
        turns = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        request = {"model": self.model, "input": turns, "form": form, "store": False}
        for turn in range(self.max_retries + 1):
            try:
                response = self.transport(request, self.timeout)
                return structured(response), call_meta(response, self.model)
            except (TimeoutError, ConnectionError):
                if turn == self.max_retries:
                    raise
                time.sleep(self.wait * 2**turn)
        raise AssertionError


@dataclass(frozen=True)
class StructuredProvider:
    """Drafts by a teacher; drafts that pass validation are reviewed by a critic."""

    teacher: Caller
    critic: Caller

    def __call__(self, source: Mapping, split: str, family: str) -> dict[str, Any]:
        draft, meta = self.teacher.ask(TEACHER_SYSTEM, drafts.teacher_request(family, source["source_text"]), "draft")
        return {"draft": dict(draft), "teacher": meta}

    def review(self, source: Mapping, draft: Mapping) -> dict[str, Any]:
        said = drafts.critic_request(source["source_text"], json.dumps(draft, ensure_ascii=False))
        review, meta = self.critic.ask(CRITIC_SYSTEM, said, "review")
        return {"review": dict(review), "critic": meta}


@dataclass(frozen=True)
class StructuredJudge:
    """A judge of batches of items; ``operators.reward.judge_misses`` checks that it answers each item once."""

    caller: Caller

    def ask(self, items: Sequence[Mapping]) -> tuple[list[dict], dict[str, Any]]:
        """The judgments, and response id, model and token counts of the call that gave them."""
        answer, meta = self.caller.ask(JUDGE_SYSTEM, JUDGE_REQUEST + json.dumps(list(items), ensure_ascii=False), "judgments")
        return [dict(j) for j in answer["judgments"]], meta

    def __call__(self, items: Sequence[Mapping]) -> list[dict]:
        return self.ask(items)[0]


def require_credential(*names: str, environment: Mapping[str, str] | None = None) -> str:
    """The first of these environment variables that is set; none is an error that names them."""
    values = os.environ if environment is None else environment
    for name in names:
        if values.get(name, "").strip():
            return values[name].strip()
    raise RuntimeError(f"a credential is needed: set {' or '.join(names)}")


def require_namespace(repo_id: str, whoami: Callable[[], Mapping]) -> Mapping:
    """Who may publish to the namespace of ``repo_id``: the user of that name or a member of that organisation."""
    namespace, slash, _ = repo_id.partition("/")
    if not slash:
        raise ValueError("a repository is named namespace/name")
    try:
        identity = whoami()
    except Exception as error:
        raise RuntimeError("publication needs a login") from error
    groups = [o.get("name") for o in identity.get("orgs") or () if isinstance(o, Mapping)]
    allowed = sorted({str(n) for n in (identity.get("name"), *groups) if n})
    if namespace not in allowed:
        raise RuntimeError(f"this login cannot publish to {namespace}; it may use {allowed}")
    return identity
