"""Closed-schema TOML configuration of the four stages, as one table of sections.

A stage is a set of sections; a section has defaults (``...`` marks a value that must be given) and rules.
Unknown sections and keys are errors, and so are values of another kind than the default's.
"""

from __future__ import annotations

import copy
import os
import tomllib
from collections.abc import Callable, Mapping, MutableMapping
from pathlib import Path
from typing import Any

from tessera.functions.completions import check_coefficients
from tessera.functions.drafts import TASK_FAMILIES
from tessera.operators.journal import decreased
from tessera.operators.quotas import check_quotas

Rule = tuple[Callable[[dict], bool], str]
SEED = 17


def _reward_rule(s: dict) -> bool:
    check_coefficients(s["format_base_reward"], s["semantic_reward_weight"])
    return True


def _placed(kind: str) -> Rule:
    where = {"hub": ("hub_repo",), "local": ("local_path",)}
    return (lambda s: s["source"] in where and all(s[k] for k in where[s["source"]])), f"{kind}.source must be 'hub' or 'local', with its place"


#: Sections, keys, defaults and ranges of the configuration files.
_REPO: Rule = ((lambda s: not s["push"] or "/" in s["repo_id"]), "hub.repo_id must read namespace/name")
_RUNTIME = ({"enable_mps_fallback": True, "tokenizers_parallelism": False, "pin_memory_on_cuda_only": True}, [])
_MODEL = ({"model_id": ...}, [])
_DATA = ({"source": "hub", "hub_repo": "", "hub_config": "", "local_path": ""}, [_placed("data"), ((lambda s: s["source"] != "hub" or s["hub_config"]), "data.hub_config is required for hub data")])
_JOB_OUTPUT = ({"directory": ..., "resume": "auto"}, [((lambda s: bool(s["directory"] and s["resume"])), "output.directory and output.resume cannot be empty")])
_JOB_HUB = ({"repo_id": ..., "push": True, "strategy": "all_checkpoints", "private": False, "always_push": True}, [_REPO])
_INFERENCE = ({"max_new_tokens": 512, "do_sample": False, "temperature": 1.0, "top_p": 1.0}, [])
_COMMON_TRAINING = {
    "max_steps": -1, "train_batch_size": 1, "gradient_checkpointing": True, "gradient_checkpointing_use_reentrant": False, "optimizer": "adamw_torch",
    "save_strategy": "steps", "save_steps": 25, "save_total_limit": None, "logging_first_step": True, "report_to": "none", "seed": SEED,
}
_SFT_TRAINING = (
    _COMMON_TRAINING | {
        "num_train_epochs": 3.0, "learning_rate": 1e-4, "eval_batch_size": 1, "gradient_accumulation_steps": 8, "max_sequence_length": 1024,
        "mps_pad_to_multiple_of": 128, "other_pad_to_multiple_of": 8, "mps_empty_cache_steps": 5, "completion_only_loss": True, "loss_type": "nll",
        "warmup_steps": 10, "eval_strategy": "steps", "eval_steps": 25, "logging_steps": 5,
    }, [],
)
_RL_TRAINING = (
    _COMMON_TRAINING | {
        "num_train_epochs": 1.0, "learning_rate": 5e-6, "eval_batch_size": 4, "gradient_accumulation_steps": 4, "num_generations": 4,
        "num_generations_eval": 4, "max_completion_length": 512, "temperature": 0.8, "top_p": 0.95, "top_k": 0, "beta": 0.0, "scale_rewards": "group",
        "multi_objective_aggregation": "sum_then_normalize", "loss_type": "dapo", "warmup_steps": 5, "eval_strategy": "epoch", "eval_steps": None,
        "logging_steps": 1, "log_completions": True, "num_completions_to_print": 4, "use_vllm": False,
    },
    [
        ((lambda s: min(s["num_generations"], s["num_generations_eval"]) >= 2), "two generations per prompt are needed at least"),
        ((lambda s: s["eval_batch_size"] % s["num_generations_eval"] == 0), "training.eval_batch_size must be a multiple of training.num_generations_eval"),
    ],
)
_LORA = (
    {"rank": 16, "alpha": 32, "dropout": 0.05, "target_modules": "all-linear"},
    [((lambda s: s["rank"] > 0 and s["alpha"] > 0 and 0 <= s["dropout"] < 1), "lora.rank and lora.alpha must be positive, lora.dropout in [0, 1)")],
)
_REWARD = (
    {"judge_model": ..., "cache_path": ..., "format_base_reward": 0.10, "semantic_reward_weight": 0.90, "function_weights": [1.0], "max_retries": 3, "timeout_seconds": 120.0},
    [(_reward_rule, ""), ((lambda s: bool(s["function_weights"])), "reward.function_weights cannot be empty")],
)
_GENERATION = (
    {"concurrency": 8, "max_attempts": 2500, "max_retries": 3, "timeout_seconds": 120.0},
    [((lambda s: s["concurrency"] >= 1 and s["max_attempts"] >= 1 and s["max_retries"] >= 0 and s["timeout_seconds"] > 0), "generation limits are out of range")],
)
_SOURCE = (
    {"dataset_id": ..., "split": "train", "candidate_limit": 2500, "max_records_scanned": 200_000, "min_chars": 1200, "max_chars": 6000, "seed": SEED},
    [
        ((lambda s: s["candidate_limit"] > 0 and s["max_records_scanned"] > 0), "source limits must be positive"),
        ((lambda s: 0 < s["min_chars"] < s["max_chars"]), "source.min_chars must be positive and below source.max_chars"),
    ],
)
_GEN_OUTPUT = (
    {"name": ..., "raw_sources_path": ..., "accepted_path": ..., "rejected_path": ..., "dataset_directory": ..., "parquet_directory": "data/processed", "parquet_prefix": ..., "manifest_path": ...},
    [((lambda s: all(s.values()) and not set(s["name"]) & set("/\\")), "output names and paths must be set, output.name without slashes")],
)
_GEN_HUB = ({"repo_id": "", "config_name": ..., "push": True, "private": False}, [_REPO, ((lambda s: bool(s["config_name"])), "hub.config_name cannot be empty")])


def _targets(**defaults: int):
    return (dict(defaults), [((lambda s: all(v > 0 for v in s.values())), "targets must be positive")])


def _weights_fit(s: dict) -> bool:
    check_quotas({"any": 1}, s)
    return True


_WEIGHTS = ({f: ... for f in TASK_FAMILIES}, [(_weights_fit, "")])
_CALLS = ({"teacher_model": ..., "critic_model": ...}, [])
_GEN = {"models": _CALLS, "task_family_weights": _WEIGHTS, "source": _SOURCE, "generation": _GENERATION, "output": _GEN_OUTPUT, "hub": _GEN_HUB}
_JOB = {"runtime": _RUNTIME, "model": _MODEL, "data": _DATA, "output": _JOB_OUTPUT, "inference": _INFERENCE, "hub": _JOB_HUB}

STAGES: dict[str, dict[str, tuple[dict, list[Rule]]]] = {
    "sft": _JOB | {"lora": _LORA, "training": _SFT_TRAINING},
    "grpo": _JOB | {"adapter": ({"source": "hub", "hub_repo": "", "local_path": ""}, [_placed("adapter")]), "reward": _REWARD, "training": _RL_TRAINING},
    "generate-sft": _GEN | {"targets": _targets(train=500, validation=75)},
    "generate-grpo": _GEN | {
        "targets": _targets(train=500, validation=75, test=100),
        "input": ({"sft_canonical_path": ...}, [((lambda s: bool(s["sft_canonical_path"])), "input.sft_canonical_path cannot be empty")]),
    },
}
SPLITS = {"generate-sft": {"train": "sft_train", "validation": "sft_validation"}, "generate-grpo": {"train": "grpo_train", "validation": "grpo_validation", "test": "test"}}


def _section(name: str, spec: tuple[dict, list[Rule]], given: Any) -> dict:
    defaults, rules = spec
    if not isinstance(given, dict):
        raise ValueError(f"[{name}] must be a table")
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown keys in [{name}]: {', '.join(unknown)}")
    out = copy.deepcopy(defaults) | given
    if missing := sorted(k for k, v in out.items() if v is ...):
        raise ValueError(f"[{name}] lacks {', '.join(missing)}")
    for key, default in defaults.items():
        value = out[key]
        if default in (..., None) or value is None:
            continue
        same = isinstance(value, (int, float)) and not isinstance(value, bool) if isinstance(default, float) else type(value) is type(default) or (key == "target_modules" and isinstance(value, list))
        if not same:
            raise ValueError(f"{name}.{key} must be of type {type(default).__name__}")
    for fits, message in rules:
        if not fits(out):
            raise ValueError(message)
    return out


def resolve(stage: str, document: Mapping[str, Any]) -> dict[str, dict]:
    """Defaults, given values and rules of a stage's sections; generation budgets must cover the targets."""
    sections = STAGES[stage]
    if unknown := sorted(set(document) - set(sections)):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    config = {name: _section(name, spec, document.get(name, {})) for name, spec in sections.items()}
    if stage.startswith("generate"):
        total = sum(config["targets"].values())
        if min(config["source"]["candidate_limit"], config["generation"]["max_attempts"]) < total:
            raise ValueError("source.candidate_limit and generation.max_attempts cannot be smaller than the targets' total")
    return config


def load(stage: str, path: str) -> dict[str, dict]:
    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(f"no configuration at {file}")
    with file.open("rb") as handle:
        return resolve(stage, tomllib.load(handle))


def split_targets(stage: str, config: Mapping[str, dict]) -> dict[str, int]:
    return {SPLITS[stage][k]: v for k, v in config["targets"].items()}


def with_overrides(config: Mapping[str, dict], *, resume: str | None = None, push: bool | None = None, smoke: bool = False) -> dict[str, dict]:
    """A changed copy; a smoke run takes one step, into a folder of its own, and publishes nothing."""
    out = copy.deepcopy(dict(config))
    if resume is not None:
        out["output"]["resume"] = resume
    if push is not None:
        out["hub"]["push"] = push
    if smoke:
        out["output"]["directory"] += "-smoke"
        out["output"]["resume"] = "none"
        out["hub"]["push"] = False
        out["training"]["max_steps"] = 1
    return out


def configure_environment(runtime: Mapping[str, Any], environment: MutableMapping[str, str] | None = None) -> None:
    """Settings that libraries read from the environment, from the [runtime] section."""
    env = os.environ if environment is None else environment
    if runtime["enable_mps_fallback"]:
        env["PYTORCH_ENABLE_MPS_FALLBACK"] = "1"
    env["TOKENIZERS_PARALLELISM"] = str(runtime["tokenizers_parallelism"]).lower()


def contract(stage: str, config: Mapping[str, dict], prompt_version: str) -> dict[str, Any]:
    """What may not change while journals are kept; targets may grow, budgets and hub options are free."""
    source, output = config["source"], config["output"]
    fixed = {
        "stage": stage, "prompt_version": prompt_version, "models": config["models"], "task_family_weights": config["task_family_weights"],
        "source": {k: source[k] for k in ("dataset_id", "split", "min_chars", "max_chars", "seed")},
        "journal": {k: output[k] for k in ("name", "raw_sources_path", "accepted_path", "rejected_path")},
    }
    return fixed | ({"sft_canonical_path": config["input"]["sft_canonical_path"]} if "input" in config else {})


def check_manifest(manifest: Mapping[str, Any] | None, stage: str, config: Mapping[str, dict], prompt_version: str) -> None:
    if not manifest:
        return
    if manifest.get("immutable_contract") != contract(stage, config, prompt_version):
        raise RuntimeError("the generation contract differs from the manifest's; use a new output name and paths")
    if less := decreased(manifest.get("config", {}).get("targets", {}), config["targets"]):
        raise RuntimeError(f"targets cannot be decreased for existing journals: {less}")
