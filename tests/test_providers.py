import json
import sys
import time

import pytest
from pyspark import cloudpickle

from tessera import config as cf
from tessera import jobs, providers
from tessera.functions import prompts
from tessera.functions.drafts import TASK_FAMILIES
from tessera.operators import project
from tessera.operators import reward as rw
from tessera.plans.quotas import scripted
from tessera.schemas import ACCEPTED, DIMENSIONS, EXCERPT, MEMO, REJECTED, RUBRIC
from tessera.sources import files
from tessera.streaming import fill

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module
WEIGHTS = dict.fromkeys(TASK_FAMILIES, 0.0) | {TASK_FAMILIES[0]: 1.0}


def sources(spark, n):
    rows = [(str(i), "t", f"text {i}", "corpus", "train", "u", "CC0", "CC0", f"sha{i}", i) for i in range(n)]
    return spark.createDataFrame(rows, EXCERPT.simpleString()[7:-1].replace(":", " ") + ", stream_idx long")


def good(family, paper):
    return scripted({"paper_id": str(paper)}, "sft_train", family)


def test_structured_answers_refusals_and_metadata():
    message = lambda **part: {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"text": "x"}, part]}]}
    assert providers.structured({"output_parsed": {"a": 1}}) == {"a": 1}
    assert providers.structured(message(parsed={"b": 2})) == {"b": 2}
    with pytest.raises(providers.Refused, match="no thanks"):
        providers.structured(message(refusal="no thanks"))
    for empty in ({}, {"output": []}, message(parsed=None), {"output_parsed": "text"}):
        with pytest.raises(providers.NoOutput):
            providers.structured(empty)
    meta = providers.call_meta({"id": "r1", "usage": {"input_tokens": "3", "total_tokens": 5, "other": 9}}, "m")
    assert meta == {"response_id": "r1", "model": "m", "usage": {"input_tokens": 3, "total_tokens": 5}}
    assert providers.call_meta({}, "m") == {"response_id": None, "model": "m", "usage": {}}


def test_retries_and_timeout():
    seen = []

    def transport(request, timeout):
        seen.append((request, timeout))
        if len(seen) < 3:
            raise TimeoutError("slow")
        return {"output_parsed": {"ok": True}, "model": "served"}

    caller = providers.Caller(transport, "m", max_retries=2, timeout=7.0, wait=0.001)
    assert caller.ask("sys", "usr", "draft") == ({"ok": True}, {"response_id": None, "model": "served", "usage": {}})
    assert len(seen) == 3 and seen[0][1] == 7.0
    assert seen[0][0] == {"model": "m", "input": [{"role": "system", "content": "sys"}, {"role": "user", "content": "usr"}], "form": "draft", "store": False}
    seen.clear()
    with pytest.raises(TimeoutError):
        providers.Caller(transport, "m", max_retries=1, wait=0.001).ask("s", "u", "draft")
    assert len(seen) == 2

    def broken(request, timeout):
        seen.append(1)
        raise ValueError("bad request")

    seen.clear()
    with pytest.raises(ValueError):
        providers.Caller(broken, "m").ask("s", "u", "draft")
    assert len(seen) == 1
    for options in ({"max_retries": -1}, {"timeout": 0}):
        with pytest.raises(ValueError):
            providers.Caller(transport, "m", **options)


def teacher(request, timeout):
    said = request["input"][1]["content"]
    paper = int(said.rsplit("text ", 1)[1])
    if paper % 9 == 5:
        return {"output": [{"type": "message", "content": [{"refusal": f"not paper {paper}"}]}]}
    draft = good(TASK_FAMILIES[0], paper)["draft"]
    return {"id": f"t{paper}", "model": "teacher-1", "output_parsed": draft | {"task": "too short" if paper % 9 == 2 else draft["task"]}}


def critic(request, timeout):
    said = request["input"][1]["content"]
    assert "too short" not in said  # invalid drafts are not reviewed
    paper = int(said.split("text ", 1)[1].split("\n")[0])
    review = good(TASK_FAMILIES[0], paper)["review"]
    return {"id": f"c{paper}", "usage": {"total_tokens": 11}, "output_parsed": review}


def test_teacher_and_critic_fill_quotas(spark, tmp_path):
    provider = providers.StructuredProvider(providers.Caller(teacher, "t"), providers.Caller(critic, "c"))
    a, r = f"{tmp_path}/a", f"{tmp_path}/r"
    done = fill.fill_quotas(spark, sources(spark, 20), {"sft_train": 5}, WEIGHTS, accepted_path=a, rejected_path=r, provider=provider, concurrency=4).collect()
    assert len(done) == 5 and all(x.teacher.model == "teacher-1" and x.critic.usage.total_tokens == 11 for x in done)
    rejected = {int(x.paper_id): x for x in files.read_jsonl(spark, r, REJECTED).collect()}
    assert rejected[5].stage == "api_error" and rejected[5].reasons == ["Refused: the request was refused: not paper 5"]
    assert rejected[2].stage == "teacher_validation" and rejected[2].review is None
    assert rejected[3].stage == "critic"


def slow(source, split, family):
    time.sleep(1.0)
    return scripted(source, split, family)


def test_calls_of_a_batch_run_at_once(spark):
    batch = sources(spark, 8).selectExpr("*", "stream_idx + 1 as slot", "'sft_train' as split", f"'{TASK_FAMILIES[0]}' as task_family").coalesce(1)
    fill.generate(batch.limit(0), slow, 8).collect()
    began = time.time()
    assert len(fill.generate(batch, slow, 8).collect()) == 8
    assert time.time() - began < 5.0  # eight calls of a second each


def test_a_run_that_died_before_its_commit_is_finished(spark, tmp_path, monkeypatch):
    from tessera.sources.commits import CommitLog

    a, r = f"{tmp_path}/a", f"{tmp_path}/r"
    plain = CommitLog._stage

    def dying(self, table, rows):
        if table == "rejected":
            raise KeyboardInterrupt  # the accepted rows of the batch are written, the rejected ones are not
        return plain(self, table, rows)

    go = lambda n: fill.fill_quotas(spark, sources(spark, 12), {"sft_train": n}, WEIGHTS, accepted_path=a, rejected_path=r, provider=scripted, concurrency=6)
    monkeypatch.setattr(CommitLog, "_stage", dying)
    with pytest.raises(KeyboardInterrupt):
        go(6)
    monkeypatch.setattr(CommitLog, "_stage", plain)
    assert files.read_jsonl(spark, a, ACCEPTED).count() == files.read_jsonl(spark, r, REJECTED).count() == 0  # both or none
    calls = []
    asked = fill._ask
    monkeypatch.setattr(fill, "_ask", lambda rows, one, n: (calls.append([x.paper_id for x in rows.collect()]), asked(rows, one, n))[1])
    go(6)
    first = {str(i) for i in range(6)}
    assert not first & {p for c in calls for p in c}  # nothing is paid for twice
    attempts = [x.paper_id for s, p in ((ACCEPTED, a), (REJECTED, r)) for x in files.read_jsonl(spark, p, s).collect()]
    assert len(attempts) == len(set(attempts)) and first <= set(attempts)
    assert files.children(spark, f"{a}.calls") == []


def test_journals_are_compacted(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string as parse

    path, schema = f"{tmp_path}/j", parse("a long, b string")
    for k in range(5):
        files.append_jsonl(spark.createDataFrame([(k, None)], schema).coalesce(1), path)
    files.compact_jsonl(spark, path, schema, most=3)
    assert sum(c.endswith(".json") for c in files.children(spark, path)) == 1
    assert sorted(x.a for x in files.read_jsonl(spark, path, schema).collect()) == list(range(5))
    # a run that ended between the renames
    (tmp_path / "j").rename(tmp_path / "j.old")
    files.compact_jsonl(spark, path, schema, most=3)
    assert files.read_jsonl(spark, path, schema).count() == 5


def completion(i, broken=False):
    parts = "".join(f"<{d}>{d} {i}</{d}>" for d in DIMENSIONS)
    return parts + (" trailing" if broken else "")


def test_reward_callable_asks_once_and_skips_malformed(spark, tmp_path):
    asked = []

    def judge(items):
        with open(f"{tmp_path}/asked", "a") as log:
            log.write(json.dumps([i["student_response"] for i in items]) + "\n")
        return [{"item_index": i["item_index"], **{d: 4 if "brainstorm 0" in i["student_response"] else 2 for d in DIMENSIONS}, "brief_reason": "ok"} for i in items]

    score = rw.reward_function(spark, judge, f"{tmp_path}/memo", "m")
    columns = {"task": ["t"] * 4, **{r: [["x"], ["y"], [], ["z"]] for r in RUBRIC}, "extra": [1, 2, 3, 4]}
    said = [completion(0), [{"role": "assistant", "content": completion(1)}], completion(2, broken=True), []]
    assert score(said, **columns) == pytest.approx([1.0, 0.1 + 0.9 * 0.5, 0.0, 0.0])
    assert score(said, **columns) == pytest.approx([1.0, 0.55, 0.0, 0.0])  # from the memo
    assert score([], task=[]) == []
    asked = [x for line in open(f"{tmp_path}/asked") for x in json.loads(line)]
    assert sorted(asked) == [completion(0), completion(1)]
    memo = files.read_memo(spark, f"{tmp_path}/memo", MEMO).collect()
    assert len(memo) == 2 and {m.request.student_response for m in memo} == set(asked) and all(m.judgment.brief_reason == "ok" for m in memo)
    with pytest.raises(ValueError):
        rw.reward_function(spark, judge, "x", "m", base=0.5)


def test_judge_over_a_transport(spark):
    def transport(request, timeout):
        assert request["input"][0]["content"] == prompts.JUDGE_SYSTEM and request["form"] == "judgments"
        items = json.loads(request["input"][1]["content"].removeprefix(prompts.JUDGE_REQUEST))
        return {"output_parsed": {"judgments": [{"item_index": i["item_index"], **dict.fromkeys(DIMENSIONS, 3)} for i in items]}}

    judge = providers.StructuredJudge(providers.Caller(transport, "j"))
    assert judge([{"item_index": 0, "task": "é"}, {"item_index": 1}]) == [{"item_index": i, **dict.fromkeys(DIMENSIONS, 3)} for i in range(2)]


def test_credentials_and_namespaces():
    assert providers.require_credential("A", "B", environment={"A": " ", "B": " key "}) == "key"
    with pytest.raises(RuntimeError, match="A or B"):
        providers.require_credential("A", "B", environment={})
    who = lambda: {"name": "me", "orgs": [{"name": "group"}, "odd", {}]}
    assert providers.require_namespace("me/x", who)["name"] == "me"
    assert providers.require_namespace("group/x", who)
    with pytest.raises(RuntimeError, match="cannot publish"):
        providers.require_namespace("other/x", who)
    with pytest.raises(ValueError):
        providers.require_namespace("x", who)
    with pytest.raises(RuntimeError, match="login"):
        providers.require_namespace("me/x", lambda: 1 / 0)


def test_chat_rendering(spark):
    turn = "array<struct<role:string,content:string>>"
    rows = [("train", [("system", "s"), ("user", "u")], [("assistant", "a")], "id"), ("validation", [("user", "v")], [("assistant", "b<end>")], "id")]
    table = spark.createDataFrame(rows, f"split string, prompt {turn}, completion {turn}, task_id string")
    got = project.render_chat(table, lambda ms: "|".join(f"{m['role']}:{m['content']}" for m in ms), end="<end>")
    assert sorted(map(tuple, got.collect())) == [("train", "system:s|user:u|assistant:a<end>"), ("validation", "user:v|assistant:b<end>")]


def job(tmp_path):
    return {"model": {"model_id": "m"}, "data": {"source": "local", "local_path": f"{tmp_path}/data"}, "output": {"directory": f"{tmp_path}/out"}, "hub": {"repo_id": "a/b"}}


def training_data(spark, tmp_path):
    rows = [("train" if i % 3 else "validation", f"t{i:02d}", f"p{i}", f"c{i}") for i in range(30)]
    spark.createDataFrame(rows, "split string, task_id string, prompt string, completion string").write.partitionBy("split").parquet(f"{tmp_path}/data")


def test_training_run_writes_manifest_metrics_and_history(spark, tmp_path, monkeypatch):
    training_data(spark, tmp_path)
    monkeypatch.setenv("HF_TOKEN", "secret-value")
    config = cf.resolve("sft", job(tmp_path))
    seen = {}

    def trainer(stage, config, tables, resume):
        seen.update({s: t.count() for s, t in tables.items()}, resume=resume, steps=config["training"]["max_steps"])
        with pytest.raises(RuntimeError, match="writer"):
            jobs.run_training(spark, stage, config, lambda *_: {})
        return {"metrics": {"loss": 0.5}, "history": [{"step": 1, "note": "é"}, {"step": 2, "path": tmp_path}]}

    result = jobs.run_training(spark, "sft", config, trainer)
    assert seen == {"train": 20, "validation": 10, "resume": None, "steps": -1} and result["metrics"] == {"loss": 0.5}
    manifest = files.read_json(spark, f"{tmp_path}/out/run_manifest.json")
    assert manifest["credentials"]["hf_token"] is True and "secret-value" not in json.dumps(manifest) and manifest["versions"]["pyspark"]
    assert (tmp_path / "out/history.jsonl").read_text() == '{"note": "\\u00e9", "step": 1}\n{"path": "%s", "step": 2}\n' % tmp_path
    assert files.read_json(spark, f"{tmp_path}/out/metrics.json") == {"loss": 0.5}
    smoke = cf.with_overrides(config, smoke=True)
    jobs.run_training(spark, "sft", smoke, lambda s, c, t, r: seen.update({k: v.count() for k, v in t.items()}) or {}, smoke=True)
    assert (seen["train"], seen["validation"]) == (8, 4) and (tmp_path / "out-smoke/run_manifest.json").exists()


def test_doctor_runs_all_probes(spark, tmp_path, monkeypatch):
    training_data(spark, tmp_path)
    config = cf.resolve("sft", job(tmp_path))
    got = jobs.doctor(spark, "sft", config, lambda: {"name": "a"})
    assert got["passed"] and [c["name"] for c in got["checks"]] == ["training_stack", "runtime", "dataset_schema", "checkpoint_state", "hub_write_access"]
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    rl = cf.resolve("grpo", job(tmp_path) | {"adapter": {"source": "local", "local_path": f"{tmp_path}/none"}, "reward": {"judge_model": "j", "cache_path": f"{tmp_path}/memo"}})
    state = {c["name"]: c["status"] for c in jobs.doctor(spark, "grpo", rl)["checks"]}
    assert state["dataset_schema"] == state["adapter"] == state["judge_credential"] == state["hub_write_access"] == "failed"
    assert state["memo"] == state["single_process"] == state["training_stack"] == "passed"


def test_environment_and_strict_checkpoints(spark, tmp_path):
    env = {}
    cf.configure_environment({"enable_mps_fallback": True, "tokenizers_parallelism": False}, env)
    assert env == {"PYTORCH_ENABLE_MPS_FALLBACK": "1", "TOKENIZERS_PARALLELISM": "false"}
    for name in ("checkpoint-9", "checkpoint-10"):
        (tmp_path / name).mkdir()
    assert files.latest_checkpoint(spark, str(tmp_path), strict=True).endswith("checkpoint-10")
    (tmp_path / "checkpoint-last").mkdir()
    with pytest.raises(ValueError):
        files.latest_checkpoint(spark, str(tmp_path), strict=True)


def test_commands(tmp_path, capsys, monkeypatch, spark):
    from tessera import cli

    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.startswith("tessera ")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["show-config", "--stage", "sft"]) == 1  # configs/sft.toml is not here
    assert "configs/sft.toml" in capsys.readouterr().err
    training_data(spark, tmp_path)
    doc = job(tmp_path)
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/sft.toml").write_text("\n".join(line for s, v in doc.items() for line in (f"[{s}]", *[f"{k} = {json.dumps(x)}" for k, x in v.items()])))
    (tmp_path / "my_trainer.py").write_text("def train(stage, config, tables, resume):\n    return {'metrics': {'rows': tables['train'].count(), 'push': config['hub']['push']}}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert cli.main(["sft", "--trainer", "my_trainer:train", "--smoke-test", "--resume", "none"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["metrics"] == {"rows": 8, "push": False} and out["directory"].endswith("out-smoke") and out["smoke_test"] is True
