import io
import json
import os
import sys

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_generation import document

from tessera import cli, jobs
from tessera import config as cf
from tessera.plans.quotas import scripted
from tessera.sources import files, remote

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Shelf:
    """A corpus in memory whose requests are noted in a folder that all processes see."""

    def __init__(self, folder, n, fail=()):
        self.folder, self.n, self.fail = str(folder), n, set(fail)
        os.makedirs(self.folder, exist_ok=True)

    def rows(self, where):
        made = [{"id": f"r{i}", "text": f"text {i}", "license": "CC0" if i % 3 else "CC-BY-4.0", "source": "s2orc", "title": None} for i in range(self.n)]
        return [r for r in made if all(r[k] == v for k, v in where.items())]

    def __call__(self, request):
        with open(f"{self.folder}/seen", "a") as f:
            f.write(json.dumps(request) + "\n")
        if request["op"] == "size":
            return {"rows": len(self.rows(request["where"]))}
        once = f"{self.folder}/failed-{request['offset']}"
        if request["offset"] in self.fail and not os.path.exists(once):
            open(once, "w").close()
            raise TimeoutError("slow")
        return {"rows": self.rows(request["where"])[request["offset"] : request["offset"] + request["rows"]]}

    def pages(self):
        with open(f"{self.folder}/seen") as f:
            return [r for r in map(json.loads, f) if r["op"] == "page"]


def test_reading_pages_limits_and_filters(spark, tmp_path):
    shelf = Shelf(tmp_path / "a", 2503, fail=(700,))
    df = remote.read_corpus(spark, shelf, "papers", partition_rows=600, page_rows=100, wait=0.01)
    assert df.rdd.getNumPartitions() == 5
    assert {r.id for r in df.collect()} == {f"r{i}" for i in range(2503)} and df.select("raw_fulltext").first()[0] is None
    few = Shelf(tmp_path / "b", 100_000)
    assert remote.read_corpus(spark, few, "papers", limit=10, page_rows=100).count() == 10
    assert [(p["offset"], p["rows"]) for p in few.pages()] == [(0, 10)]  # one page, and no row more
    some = Shelf(tmp_path / "c", 900)
    got = remote.read_corpus(spark, some, "papers", filterable="license", page_rows=50).where("license = 'CC-BY-4.0' and title is null and id <> 'r3'")
    assert got.count() == 299 and {p["where"]["license"] for p in some.pages()} == {"CC-BY-4.0"} and len(some.pages()) == 6
    assert remote.read_corpus(spark, Shelf(tmp_path / "d", 0), "papers").count() == 0


def test_a_restarted_stream_reads_nothing_twice(spark, tmp_path):
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    for n in (130, 130, 300):
        shelf = Shelf(tmp_path / "s", n)
        stream = remote.read_corpus(spark, shelf, "papers", streaming=True, page_rows=50, partition_rows=100)
        q = stream.select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        ids = [r.id for r in spark.read.parquet(out).collect()]
        assert sorted(ids) == sorted(f"r{i}" for i in range(n))
    asked = [(p["offset"], p["rows"]) for p in shelf.pages()]
    assert sum(n for _, n in asked) == 300 and len(asked) == len(set(asked))


class Hub:
    """A publisher over folders: staged parts lie apart, publishing moves them."""

    def __init__(self, folder):
        self.folder = str(folder)

    def stage(self, repo, run, name, content):
        at = f"{self.folder}/staged/{run}/{name}"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(content)

    def publish(self, repo, run, names, info):
        for name in names:
            to = f"{self.folder}/{repo}/{name}"
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(f"{self.folder}/staged/{run}/{name}", to)
        with open(f"{self.folder}/{repo}/info.json", "w") as f:
            json.dump(info, f)

    def discard(self, repo, run):
        import shutil

        shutil.rmtree(f"{self.folder}/staged/{run}", ignore_errors=True)

    def published(self, repo):
        found = [os.path.join(d, f) for d, _, names in os.walk(f"{self.folder}/{repo}") for f in names if f.endswith(".parquet")]
        return {f: pq.read_table(io.BytesIO(open(f, "rb").read())).to_pylist() for f in sorted(found)}

    def staged(self):
        return [f for _, _, names in os.walk(f"{self.folder}/staged") for f in names]


def test_publication_is_whole_or_nothing(spark, tmp_path):
    hub = Hub(tmp_path)
    table = spark.range(1000).repartition(4).selectExpr("case when id % 4 = 0 then 'validation' else 'train' end as split", "id", "cast(id as string) as text")
    remote.publish(table, hub, "me/data", config="x", part_rows=100)
    got = hub.published("me/data")
    assert sorted(r["id"] for rows in got.values() for r in rows) == list(range(1000)) and all(len(r) <= 250 for r in got.values())
    assert all(("validation-" in f) == (rows[0]["id"] % 4 == 0) and "split" not in rows[0] for f, rows in got.items())
    assert json.load(open(f"{tmp_path}/me/data/info.json")) == {"config": "x", "rows": 1000} and hub.staged() == []
    # one task fails: what the others have staged is not published
    broken = table.withColumn("text", F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        remote.publish(broken, hub, "me/other")
    assert hub.published("me/other") == {} and hub.staged() == []


def raw(spark, n=60):
    rows = [(i, str(i), None, ("word " * 30 + "\n\n") * 4, None, "{}", "CC0", "s2orc", f"title {i}") for i in range(n)]
    return spark.createDataFrame(rows, "row long, id string, paper_id string, text string, raw_fulltext string, metadata string, license string, source string, title string")


def test_push_publishes_the_projection(spark, tmp_path):
    doc = document(tmp_path)
    doc["hub"] = {"config_name": "x", "push": True, "repo_id": "me/tasks"}
    config, hub = cf.resolve("generate-sft", doc), Hub(tmp_path / "hub")
    calls = []
    with pytest.raises(RuntimeError, match="publisher"):
        jobs.run_generation(spark, "generate-sft", config, raw(spark), "row", lambda *a: calls.append(a))
    with pytest.raises(RuntimeError, match="cannot publish"):
        jobs.run_generation(spark, "generate-sft", config, raw(spark), "row", lambda *a: calls.append(a), hub, lambda: {"name": "you"})
    assert calls == [] and not files.exists(spark, config["output"]["manifest_path"])  # nothing is begun that cannot be published
    result = jobs.run_generation(spark, "generate-sft", config, raw(spark), "row", scripted, hub, lambda: {"name": "me"}, tasks=2, overplan=True)
    assert result["published"] == {"repository": "me/tasks", "config": "x"}
    assert sum(map(len, hub.published("me/tasks").values())) == 10


def test_doctor_with_a_login(spark, tmp_path, capsys, monkeypatch):
    table = spark.createDataFrame([("train" if i % 3 else "validation", f"p{i}", f"c{i}") for i in range(30)], "split string, prompt string, completion string")
    table.write.partitionBy("split").parquet(f"{tmp_path}/data")
    doc = {"model": {"model_id": "m"}, "data": {"source": "local", "local_path": f"{tmp_path}/data"}, "output": {"directory": f"{tmp_path}/out"}, "hub": {"repo_id": "a/b"}}
    (tmp_path / "c.toml").write_text("\n".join(line for s, v in doc.items() for line in (f"[{s}]", *[f"{k} = {json.dumps(x)}" for k, x in v.items()])))
    (tmp_path / "my_login.py").write_text("def whoami():\n    return {'name': 'a'}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert cli.main(["doctor", "--stage", "sft", "--config", str(tmp_path / "c.toml")]) == 1
    capsys.readouterr()
    assert cli.main(["doctor", "--stage", "sft", "--config", str(tmp_path / "c.toml"), "--login", "my_login:whoami"]) == 0
    assert json.loads(capsys.readouterr().out)["passed"] is True
