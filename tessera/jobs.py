"""End-to-end generation jobs: manifest, pool, quota filling, projection, guards, sinks."""

from __future__ import annotations

import os
import platform
from collections.abc import Callable, Mapping
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config as cf
from tessera import providers
from tessera.functions.drafts import PROMPT_VERSION
from tessera.operators import audit, journal, project, reward
from tessera.operators.numbering import numbered
from tessera.schemas import ACCEPTED, EXCERPT, LONG, REJECTED, RUBRIC
from tessera.sources import corpus, files, remote
from tessera.streaming.fill import Provider, fill_quotas

#: Environment variables that hold credentials, of the hub and of the model service.
CREDENTIALS = ("HF_TOKEN", "OPENAI_API_KEY")


def prepare(spark: SparkSession, stage: str, config: Mapping[str, dict]) -> None:
    """Check the manifest, or the journals where there is none, and open the run."""
    out, models, source = config["output"], config["models"], config["source"]
    path = out["manifest_path"]
    if files.exists(spark, path):
        cf.check_manifest(files.read_json(spark, path), stage, config, PROMPT_VERSION)
    else:
        rows = journal.union(files.read_jsonl(spark, out["accepted_path"], ACCEPTED), files.read_jsonl(spark, out["rejected_path"], REJECTED))
        journal.require_compatible(
            rows, prompt_version=PROMPT_VERSION, dataset=source["dataset_id"], split_name=source["split"], splits=list(cf.split_targets(stage, config)),
            families=list(config["task_family_weights"]), teacher=models["teacher_model"], critic=models["critic_model"],
        )
    files.write_json(spark, path, {"status": "in_progress", "immutable_contract": cf.contract(stage, config, PROMPT_VERSION), "config": config})


def acquire(spark: SparkSession, raw: DataFrame, config: Mapping[str, dict], identity: str, excluded: DataFrame | None = None) -> DataFrame:
    """The cached pool where it still fits, else a new one in its place, with its order as ``stream_idx``."""
    s, path = config["source"], config["output"]["raw_sources_path"]
    schema = T.StructType([*EXCERPT.fields, T.StructField("stream_idx", LONG)])
    none = spark.createDataFrame([], "paper_id string")
    cached = files.read_jsonl(spark, path, schema)
    fits = corpus.cache_usable(cached, excluded if excluded is not None else none, limit=s["candidate_limit"], dataset=s["dataset_id"], split=s["split"])
    if not fits.first().usable:
        pool = corpus.source_pool(
            raw, identity=identity, dataset=s["dataset_id"], split=s["split"], max_papers=s["candidate_limit"], max_scanned=s["max_records_scanned"],
            min_chars=s["min_chars"], max_chars=s["max_chars"], seed=s["seed"], exclude=excluded,
        )
        placed = numbered(pool, ["order_key", identity], name="stream_idx")
        files.write_jsonl(placed.select(*schema.names), path)
        cached = files.read_jsonl(spark, path, schema)
    return cached


def run_generation(
    spark: SparkSession, stage: str, config: Mapping[str, dict], raw: DataFrame, identity: str, provider: Provider,
    publisher: remote.Publisher | None = None, whoami: Callable[[], Mapping] | None = None, **spread,
) -> dict[str, Any]:
    """Fill the quotas of a stage, write its projection and, if the configuration says so, publish it; returns the run's summary.

    Whether publication can work is asked before anything is paid for.  ``spread`` goes to ``fill_quotas``.
    """
    out, targets, hub = config["output"], cf.split_targets(stage, config), config["hub"]
    if hub["push"]:
        if publisher is None or whoami is None:
            raise RuntimeError("publication needs a publisher and a login")
        providers.require_namespace(hub["repo_id"], whoami)
    prepare(spark, stage, config)
    excluded = None
    if stage == "generate-grpo":
        sft = files.read_jsonl(spark, config["input"]["sft_canonical_path"], ACCEPTED)
        if sft.isEmpty():
            raise FileNotFoundError("the canonical SFT journal is needed first")
        excluded = sft.select("paper_id").distinct()
    pool = acquire(spark, raw, config, identity, excluded)
    need = sum(targets.values())
    if (have := pool.count()) < need:
        raise RuntimeError(f"the pool has {have} sources for {need} targets")
    if excluded is not None and not journal.overlap(pool, excluded).isEmpty():
        raise RuntimeError("the pool shares papers with the SFT set")
    chosen = fill_quotas(
        spark, pool, targets, config["task_family_weights"], accepted_path=out["accepted_path"], rejected_path=out["rejected_path"], provider=provider,
        concurrency=config["generation"]["concurrency"], max_attempts=config["generation"]["max_attempts"], **spread,
    )
    if excluded is not None and not journal.overlap(chosen, excluded).isEmpty():
        raise RuntimeError("accepted tasks share papers with the SFT set")
    if stage == "generate-sft":
        table = project.guard_columns(project.sft_rows(chosen), project.SFT_FORBIDDEN)
    else:
        table = project.guard_columns(project.rl_rows(chosen), project.RL_FORBIDDEN)
    saved = files.save_projection(table, out["dataset_directory"], config["targets"])
    parts = files.save_split_files(saved, out["parquet_directory"], out["parquet_prefix"])
    accepted, rejected = (files.read_jsonl(spark, out[k], s) for k, s in (("accepted_path", ACCEPTED), ("rejected_path", REJECTED)))
    rate = audit.acceptance_rate(accepted, rejected).first()
    result = {
        "name": out["name"], "selected_accepted": need, "accepted_journal": rate.accepted, "rejected_journal": rate.rejected, "acceptance_rate": rate.rate,
        "dataset_directory": out["dataset_directory"], "parquet_files": parts, "splits": dict(config["targets"]),
    }
    if excluded is not None:
        result["excluded_sft_papers"] = excluded.count()
    if hub["push"]:
        remote.publish(saved, publisher, hub["repo_id"], config=hub["config_name"])
        result["published"] = {"repository": hub["repo_id"], "config": hub["config_name"]}
    files.write_json(spark, out["manifest_path"], {"status": "complete", "immutable_contract": cf.contract(stage, config, PROMPT_VERSION), "config": config, "result": result})
    return result


def preflight(checks: Mapping[str, Any]) -> list[dict[str, str]]:
    """Run every check, whatever the others say: (name, status, detail)."""
    rows = []
    for name, check in checks.items():
        try:
            rows.append({"name": name, "status": "passed", "detail": str(check())})
        except Exception as error:  # the failure is the check's result
            rows.append({"name": name, "status": "failed", "detail": f"{type(error).__name__}: {error}"})
    return rows


NEEDED = {"sft": ("prompt", "completion"), "grpo": ("prompt", "task", *RUBRIC)}
SMOKE = {"train": 8, "validation": 4}
#: (stage, configuration, {split: rows}, checkpoint or None) -> {"metrics": mapping, "history": list of mappings}
Trainer = Callable[[str, Mapping, dict[str, DataFrame], str | None], Mapping[str, Any]]


def versions() -> dict[str, str]:
    """Versions of what a run depends on; one that is absent reads ``missing``."""
    out = {"python": platform.python_version()}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "missing"
    return out


def credentials(config: Mapping[str, Any]) -> dict[str, bool]:
    """Which credentials the environment has, never their values."""
    return {name.lower(): bool(os.environ.get(name, "").strip()) for name in CREDENTIALS}


def run_manifest(stage: str, config: Mapping[str, dict], *, resume: str | None, smoke: bool, runtime: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A reproducible record of a resolved run, without secrets."""
    return {
        "stage": stage, "config": config, "runtime": dict(runtime or {}), "versions": versions(), "resume_from_checkpoint": resume,
        "smoke_test": smoke, "credentials": credentials(config),
    }


def training_tables(spark: SparkSession, stage: str, config: Mapping[str, dict], smoke: bool) -> dict[str, DataFrame]:
    if config["data"]["source"] != "local":
        raise RuntimeError("hub data cannot be read without a network connector")
    table = project.require_splits(files.load_training(spark, config["data"]["local_path"]), ("train", "validation"), NEEDED[stage])
    if smoke:
        table = audit.smoke_subset(table, SMOKE, order="task_id" if "task_id" in table.columns else "prompt")
    return {split: table.where(F.col("split") == split).drop("split") for split in ("train", "validation")}


def run_training(spark: SparkSession, stage: str, config: Mapping[str, dict], trainer: Trainer, *, smoke: bool = False) -> dict[str, Any]:
    """Hand the tables of a stage to a trainer; manifest, metrics and history are written beside its output.

    Model training itself is the trainer's; one process at a time writes an output folder.
    """
    cf.configure_environment(config["runtime"])
    folder = config["output"]["directory"].rstrip("/")
    resume = files.resolve_resume(spark, folder, config["output"]["resume"])
    tables = training_tables(spark, stage, config, smoke)
    with files.single_writer(spark, folder):
        files.write_json(spark, f"{folder}/run_manifest.json", run_manifest(stage, config, resume=resume, smoke=smoke))
        done = trainer(stage, config, tables, resume)
        files.write_json(spark, f"{folder}/metrics.json", done.get("metrics") or {})
        files.write_json_lines(spark, f"{folder}/history.jsonl", done.get("history") or [])
    return {"stage": stage, "directory": folder, "resume_from_checkpoint": resume, "smoke_test": smoke, "metrics": dict(done.get("metrics") or {})}


def doctor(spark: SparkSession, stage: str, config: Mapping[str, dict], whoami: Callable[[], Mapping] | None = None) -> dict[str, Any]:
    """Read-only checks of a training stage: versions, data, resume state, memo, adapter, credentials, publication."""

    def stack() -> dict[str, str]:
        found = versions()
        if missing := sorted(n for n, v in found.items() if v == "missing"):
            raise RuntimeError(f"missing packages: {', '.join(missing)}")
        return found

    def data() -> dict[str, int]:
        return {split: rows.count() for split, rows in training_tables(spark, stage, config, False).items()}

    def checkpoint() -> dict[str, Any]:
        out = config["output"]
        return {"output_directory": out["directory"], "configured_resume": out["resume"], "resolved_resume": files.resolve_resume(spark, out["directory"], out["resume"])}

    def adapter() -> dict[str, str]:
        if config["adapter"]["source"] != "local":
            raise RuntimeError("a hub adapter cannot be read without a network connector")
        path = config["adapter"]["local_path"]
        if not files.exists(spark, f"{path.rstrip('/')}/adapter_config.json"):
            raise FileNotFoundError(f"adapter_config.json not found in {path}")
        return {"source": "local", "path": path}

    def publication() -> dict[str, Any]:
        if whoami is None:
            raise RuntimeError("publication needs a login")
        return {"identity": providers.require_namespace(config["hub"]["repo_id"], whoami).get("name"), "repository": config["hub"]["repo_id"]}

    checks: dict[str, Callable[[], Any]] = {
        "training_stack": stack, "runtime": lambda: {"spark": spark.version, "cores": spark.sparkContext.defaultParallelism}, "dataset_schema": data, "checkpoint_state": checkpoint,
    }
    if stage == "grpo":
        checks["adapter"] = adapter
        checks["memo"] = lambda: {"judgments": reward.memo_of(spark, config["reward"]["cache_path"]).read().count()}
        checks["judge_credential"] = lambda: {"present": bool(providers.require_credential(CREDENTIALS[-1]))}
        checks["single_process"] = lambda: {"free": not files.exists(spark, f"{config['output']['directory'].rstrip('/')}.lock")}
    if config["hub"]["push"]:
        checks["hub_write_access"] = publication
    rows = preflight(checks)
    return {"stage": stage, "passed": all(r["status"] == "passed" for r in rows), "credentials": credentials(config), "checks": rows}
