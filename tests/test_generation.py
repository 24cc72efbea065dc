import copy
import json

import pytest

from tessera import cli, jobs
from tessera import config as cf
from tessera.functions.drafts import PROMPT_VERSION, TASK_FAMILIES
from tessera.operators import project
from tessera.plans.quotas import scripted
from tessera.schemas import ACCEPTED, EXCERPT, REJECTED
from tessera.sources import corpus, files
from tessera.streaming.fill import fill_quotas, fill_stream

WEIGHTS = dict.fromkeys(TASK_FAMILIES, 0.0) | {TASK_FAMILIES[0]: 1.0}


def sources(spark, n):
    rows = [(str(i), "t", f"text {i}", "corpus", "train", "u", "CC0", "CC0", f"sha{i}", i) for i in range(n)]
    return spark.createDataFrame(rows, EXCERPT.simpleString()[7:-1].replace(":", " ") + ", stream_idx long")


def test_resume_and_error_isolation(spark, tmp_path):
    a, r = f"{tmp_path}/accepted", f"{tmp_path}/rejected"
    run = lambda n, k: fill_quotas(spark, sources(spark, n), {"sft_train": k}, WEIGHTS, accepted_path=a, rejected_path=r, provider=scripted, concurrency=3)
    with pytest.raises(RuntimeError, match="sft_train/mechanism_guided_design"):
        run(4, 3)
    first = {x.paper_id for x in files.read_jsonl(spark, a, ACCEPTED).collect()}
    assert first == {"1", "2"}
    done = run(9, 4).collect()
    assert len(done) == 4 and {x.split for x in done} == {"sft_train"}
    rejected = files.read_jsonl(spark, r, REJECTED).collect()
    attempts = [x.paper_id for x in files.read_jsonl(spark, a, ACCEPTED).collect()] + [x.paper_id for x in rejected]
    assert len(attempts) == len(set(attempts))  # nothing is attempted twice
    failed = [x for x in rejected if x.stage == "api_error"]
    assert [x.reasons for x in failed] == [["RuntimeError: scripted failure"]]
    assert all(x.reasons == ["critic rejected task"] for x in rejected if x.stage == "critic" and int(x.paper_id) % 3 == 0) or rejected


def test_streaming_front_end(spark, tmp_path):
    src = f"{tmp_path}/pool"
    pool = sources(spark, 8).drop("stream_idx")
    pool.write.parquet(src)
    stream = spark.readStream.schema(pool.schema).parquet(src)
    q = fill_stream(stream, {"sft_train": 3}, WEIGHTS, accepted_path=f"{tmp_path}/a", rejected_path=f"{tmp_path}/r", provider=scripted, checkpoint=f"{tmp_path}/c")
    q.awaitTermination(120)
    assert files.read_jsonl(spark, f"{tmp_path}/a", ACCEPTED).count() == 3


def document(tmp_path, stage="generate-sft"):
    doc = {
        "models": {"teacher_model": "scripted", "critic_model": "scripted"}, "task_family_weights": {f: 1.0 for f in TASK_FAMILIES},
        "targets": {"train": 5, "validation": 5}, "source": {"dataset_id": "corpus", "candidate_limit": 40, "min_chars": 100, "max_chars": 2000},
        "generation": {"concurrency": 8, "max_attempts": 40},
        "output": {"name": "x", "raw_sources_path": f"{tmp_path}/{stage}/raw", "accepted_path": f"{tmp_path}/{stage}/acc", "rejected_path": f"{tmp_path}/{stage}/rej", "dataset_directory": f"{tmp_path}/{stage}/data", "parquet_directory": f"{tmp_path}/{stage}/parts", "parquet_prefix": "x", "manifest_path": f"{tmp_path}/{stage}/manifest.json"},
        "hub": {"config_name": "x", "push": False},
    }
    if stage == "generate-grpo":
        doc["targets"]["test"] = 5
        doc["input"] = {"sft_canonical_path": f"{tmp_path}/generate-sft/acc"}
    return doc


def test_both_jobs_end_to_end(spark, tmp_path):
    rows = [(i, str(i), None, ("word " * 30 + "\n\n") * 4, None, "{}", "CC0", "s2orc", f"title {i}") for i in range(120)]
    raw = spark.createDataFrame(rows, "row long, id string, paper_id string, text string, raw_fulltext string, metadata string, license string, source string, title string")
    for stage in ("generate-sft", "generate-grpo"):
        config = cf.resolve(stage, document(tmp_path, stage))
        result = jobs.run_generation(spark, stage, config, raw, "row", scripted)
        n = sum(config["targets"].values())
        assert result["selected_accepted"] == n and result["splits"] == config["targets"]
        table = files.load_training(spark, config["output"]["dataset_directory"])
        assert project.wrong_sizes(table, config["targets"]) == {}
        assert files.read_json(spark, config["output"]["manifest_path"])["status"] == "complete"
    sft, rl = (files.read_jsonl(spark, f"{tmp_path}/{s}/acc", ACCEPTED) for s in ("generate-sft", "generate-grpo"))
    assert sft.join(rl, "paper_id").count() == 0
    # a finished job runs again without a new attempt
    before = rl.count()
    jobs.run_generation(spark, "generate-grpo", config, raw, "row", scripted)
    assert files.read_jsonl(spark, f"{tmp_path}/generate-grpo/acc", ACCEPTED).count() == before


def test_manifest_contract(tmp_path):
    old = cf.resolve("generate-sft", document(tmp_path))
    manifest = {"immutable_contract": cf.contract("generate-sft", old, PROMPT_VERSION), "config": old}
    new = copy.deepcopy(old)
    new["generation"]["max_attempts"], new["targets"]["train"] = 90, 6
    cf.check_manifest(manifest, "generate-sft", new, PROMPT_VERSION)
    new["targets"]["train"] = 4
    with pytest.raises(RuntimeError, match="decreased"):
        cf.check_manifest(manifest, "generate-sft", new, PROMPT_VERSION)
    new = copy.deepcopy(old)
    new["models"]["teacher_model"] = "other"
    with pytest.raises(RuntimeError, match="contract"):
        cf.check_manifest(manifest, "generate-sft", new, PROMPT_VERSION)


def test_config_rules(tmp_path):
    job = {"model": {"model_id": "m"}, "data": {"source": "local", "local_path": "d"}, "output": {"directory": "out"}, "hub": {"repo_id": "a/b"}}
    config = cf.resolve("sft", job)
    assert config["training"]["max_sequence_length"] == 1024 and config["lora"] == {"rank": 16, "alpha": 32, "dropout": 0.05, "target_modules": "all-linear"}
    smoke = cf.with_overrides(config, push=True, smoke=True)
    assert smoke["training"]["max_steps"] == 1 and smoke["output"] == {"directory": "out-smoke", "resume": "none"} and not smoke["hub"]["push"]
    assert config["output"]["directory"] == "out" and config["hub"]["push"]
    rl = job | {"adapter": {"source": "local", "local_path": "x"}, "reward": {"judge_model": "j", "cache_path": "c"}}
    assert cf.resolve("grpo", rl)["training"]["num_generations"] == 4
    bad = [
        ("sft", job | {"extra": {}}), ("sft", job | {"lora": {"rnk": 1}}), ("sft", job | {"lora": {"rank": 0}}), ("sft", job | {"hub": {"repo_id": "ab"}}), ("sft", job | {"data": {}}),
        ("grpo", rl | {"reward": {"judge_model": "j", "cache_path": "c", "format_base_reward": 0.2}}), ("grpo", rl | {"training": {"eval_batch_size": 3}}), ("sft", job | {"training": {"seed": "x"}}),
        ("generate-sft", document(tmp_path) | {"targets": {"train": 0}}), ("generate-sft", document(tmp_path) | {"targets": {"train": 90}}), ("generate-sft", document(tmp_path) | {"task_family_weights": {"x": 1}}),
    ]
    for stage, doc in bad:
        with pytest.raises(ValueError):
            cf.resolve(stage, doc)


def test_checkpoints(spark, tmp_path):
    for name in ("checkpoint-9", "checkpoint-100", "checkpoint-final"):
        (tmp_path / name).mkdir()
    (tmp_path / "checkpoint-250").write_text("a file")
    assert files.latest_checkpoint(spark, str(tmp_path)).endswith("checkpoint-100")
    assert files.resolve_resume(spark, str(tmp_path), " Auto ").endswith("checkpoint-100")
    assert files.resolve_resume(spark, str(tmp_path), "NO") is None
    assert files.latest_checkpoint(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        files.resolve_resume(spark, str(tmp_path), str(tmp_path / "missing"))


def test_journal_files(spark, tmp_path):
    path = f"{tmp_path}/j"
    schema = "a string, b bigint"
    from pyspark.sql.types import _parse_datatype_string as parse

    assert files.read_jsonl(spark, path, parse(schema)).count() == 0
    files.append_jsonl(spark.createDataFrame([("é", None)], schema), path)
    files.append_jsonl(spark.createDataFrame([], schema), path)
    files.append_jsonl(spark.createDataFrame([("x", 2)], schema), path)
    assert sorted(map(tuple, files.read_jsonl(spark, path, parse(schema)).collect())) == [("x", 2), ("é", None)]
    (tmp_path / "j" / "bad.json").write_text("\n{broken\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, parse(schema)).collect()
    for place in ("/", "~", ".", "file:/"):
        with pytest.raises(ValueError):
            files.guard_path(place)
    files.write_json(spark, f"{tmp_path}/m.json", {"b": 1, "a": (1, tmp_path)})
    assert files.read_json(spark, f"{tmp_path}/m.json") == {"a": [1, str(tmp_path)], "b": 1}


def test_command_line(spark, tmp_path, capsys):
    toml = tmp_path / "c.toml"
    doc = document(tmp_path)
    lines = []
    for section, values in doc.items():
        lines += [f"[{section}]", *[f"{k} = {json.dumps(v)}" for k, v in values.items()]]
    toml.write_text("\n".join(lines))
    assert cli.main(["show-config", "--stage", "generate-sft", "--config", str(toml)]) == 0
    assert json.loads(capsys.readouterr().out)["source"]["seed"] == 17
    assert cli.main(["show-config", "--stage", "sft", "--config", str(tmp_path / "none")]) == 1
    assert "error" in capsys.readouterr().err


def test_preflight_runs_every_check():
    rows = jobs.preflight({"good": lambda: 1, "bad": lambda: 1 / 0, "later": lambda: "ok"})
    assert [r["status"] for r in rows] == ["passed", "failed", "passed"] and "ZeroDivisionError" in rows[1]["detail"]


def test_pool_shapes(spark):
    raw = spark.createDataFrame([(0, "x"), (7, "y")], "id long, text string")
    got = corpus.shaped(raw).collect()
    assert [r.id for r in got] == [None, "7"] and got[0].license is None


def test_no_shuffle_brings_texts_and_answers_together(spark):
    from pyspark.sql import functions as F

    from tessera.streaming.fill import generate

    batch = sources(spark, 12).withColumn("title", F.when(F.col("stream_idx") != 2, F.col("title")))
    batch = batch.select(F.col("stream_idx").alias("slot"), F.lit("sft_train").alias("split"), F.lit(TASK_FAMILIES[0]).alias("task_family"), *EXCERPT.names)
    called = generate(batch, scripted, 2)
    assert "Exchange" not in called._jdf.queryExecution().executedPlan().toString()
    got, want = {r.slot: r for r in called.collect()}, {r.slot: r for r in batch.collect()}
    assert got.keys() == want.keys() and all(got[k][n] == want[k][n] for k in want for n in EXCERPT.names)
    assert got[5].failure and got[5].draft is None and got[4].draft.answer == "a" * 60 and got[4].requested_task_family == TASK_FAMILIES[0]
