"""Filling quotas from a pool of sources, in micro-batches with resumable journals.

Each batch plans the most underfilled slots, leases the next sources for them, calls the provider on executors, and adds accepted and
rejected rows to their journals in one commit, which also ends the lease (``sources.commits``).  Everything that an earlier run
attempted is in the journals and is not attempted again.  ``fill_stream`` does the same behind Structured Streaming: every micro-batch of
arriving sources is one call of ``foreachBatch``.

A batch is as large as ``tasks`` tasks with ``concurrency`` calls at once can hold.  With ``overplan`` it plans as many attempts for a cell as the
acceptance rate so far asks for, so that batches stay large to the end; what is accepted beyond a target stays in the journal, and
the selection is the exact trim.  Leases keep two runs on the same journals (each with a ``holder`` name of its own) from paying for one source
twice; those of a run that died expire, or end when a run of its name starts.  Between batches only counts per cell and the place in the numbered queue of sources are kept.  Paid results are written before the commit, and a
run that died in between is finished by the next one.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import drafts
from tessera.operators import journal as jn
from tessera.operators import project, quotas
from tessera.operators.numbering import numbered
from tessera.schemas import ACCEPTED, CALL_META, DRAFT, EXCERPT, LONG, QUOTA, REJECTED, REVIEW, STR
from tessera.sources import files
from tessera.sources.commits import CommitLog

#: (source record, split, family) -> {"draft": dict, "review": dict or None, "teacher": meta, "critic": meta}.  A provider with a
#: method ``review`` (source record, draft) -> {"review": dict, "critic": meta} drafts only; valid drafts are reviewed after.
Provider = Callable[[dict, str, str], Mapping]
ANSWERS = ("draft", "review", "teacher", "critic")
CALLED = T.StructType(
    [T.StructField("slot", LONG), *EXCERPT.fields, T.StructField("requested_split", STR), T.StructField("requested_task_family", STR)]
    + [T.StructField(n, t) for n, t in zip(ANSWERS, (DRAFT, REVIEW, CALL_META, CALL_META))] + [T.StructField("failure", STR)]
)


class Limited:
    """A call that starts at most ``rate`` times a second in one process, however many threads make it."""

    def __init__(self, call: Callable, rate: float | None):
        if rate is not None and rate <= 0:
            raise ValueError("a rate of calls must be positive")
        self.call, self.rate = call, rate
        self._reset()

    def _reset(self) -> None:
        self.lock, self.free = threading.Lock(), 0.0

    def __getstate__(self):
        return {"call": self.call, "rate": self.rate}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def __call__(self, *args):
        if self.rate is not None:
            with self.lock:
                at = max(self.free, time.monotonic())
                self.free = at + 1.0 / self.rate
            time.sleep(max(0.0, at - time.monotonic()))
        return self.call(*args)


def _ask(rows: DataFrame, one: Callable[[dict], Mapping], concurrency: int, carried: Sequence[str] = ()) -> DataFrame:
    """(slot, answers as JSON, failure, the string columns ``carried``) of one call per row; up to ``concurrency`` calls of a task run at once."""

    def attempt(record: dict) -> tuple:
        try:
            got = one(record)
            return (record["slot"], *[json.dumps(got[k]) if got.get(k) is not None else None for k in ANSWERS], None)
        except Exception as error:  # one source's failure is a row, not the end of the run
            return (record["slot"], *[None] * len(ANSWERS), f"{type(error).__name__}: {error}")

    def call(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                got = pd.DataFrame(list(pool.map(attempt, pdf.to_dict("records"))), columns=["slot", *ANSWERS, "failure"])
                yield got.assign(**{c: pdf[c].to_numpy() for c in carried})

    return rows.mapInPandas(call, "slot long, " + ", ".join(f"{a} string" for a in (*ANSWERS, "failure", *carried)))


def generate(batch: DataFrame, provider: Provider, concurrency: int = 8, rate: float | None = None) -> DataFrame:
    """Call the provider once for every (source, slot) row; an exception becomes the row's ``failure``.

    Every task makes up to ``concurrency`` calls at once and starts at most ``rate`` a second.
    """
    spark, names = batch.sparkSession, EXCERPT.names
    two = hasattr(provider, "review")
    draft = Limited(lambda r: provider({n: r[n] for n in names}, r["split"], r["task_family"]), rate)
    asked = batch.select("slot", "split", "task_family", *names)
    parsed = lambda t, *more: t.select(
        "slot", *more, F.from_json("draft", DRAFT).alias("draft"), F.from_json("review", REVIEW).alias("review"),
        F.from_json("teacher", CALL_META).alias("teacher"), F.from_json("critic", CALL_META).alias("critic"), "failure",
    )
    cell = [F.col("split").alias("requested_split"), F.col("task_family").alias("requested_task_family")]
    if not two:  # texts go through the call with their answers, so nothing is shuffled to bring them together
        return parsed(_ask(asked, draft, concurrency, (*names, "split", "task_family")), *names, *cell)
    sources = batch.select("slot", *names, *cell)
    # drafts are paid for: they are written before validation reads them to choose what is reviewed
    answers = files.written(_ask(asked, draft, concurrency), "drafts")
    drafted = sources.join(parsed(answers), "slot")
    valid = project.with_errors(drafted.where("failure is null")).where(F.size("_errors") == 0).select("slot")
    asked = sources.select("slot", *names).join(answers.select("slot", F.col("draft").alias("said")), "slot").join(valid, "slot")
    reviewed = _ask(asked, Limited(lambda r: provider.review({n: r[n] for n in names}, json.loads(r["said"])), rate), concurrency)
    reviewed = parsed(reviewed).select("slot", F.col("review").alias("r"), F.col("critic").alias("c"), F.col("failure").alias("f"))
    return drafted.join(reviewed, "slot", "left").select(
        "slot", *names, "requested_split", "requested_task_family", "draft", F.col("r").alias("review"), "teacher", F.col("c").alias("critic"), F.coalesce("failure", "f").alias("failure")
    )


def outcomes(called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a batch, in the declared shapes."""
    fine, failed = project.with_errors(called.where("failure is null")), called.where("failure is not null")
    accepted = project.accepted_rows(fine).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ACCEPTED.fields])
    api = failed.select(
        *EXCERPT.names, "requested_split", "requested_task_family", F.lit("api_error").alias("stage"),
        F.lit(drafts.PROMPT_VERSION).alias("prompt_version"), F.array("failure").alias("reasons"),
    )
    rejected = project.rejected_rows(fine).unionByName(api, allowMissingColumns=True)
    return accepted, rejected.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REJECTED.fields])


class _Settled(Exception):
    pass


class Filler:
    """The state of a run: counts per cell, kept between batches."""

    def __init__(
        self, spark: SparkSession, targets: Mapping[str, int], weights: Mapping[str, float], accepted_path: str, rejected_path: str, provider: Provider,
        concurrency: int, *, tasks: int = 1, overplan: bool = False, rate: float | None = None, lease_s: float = 3600.0, holder: str = "fill",
    ):
        if concurrency < 1 or tasks < 1:
            raise ValueError("concurrency and tasks must be at least 1")
        self.spark, self.provider, self.concurrency, self.tasks = spark, provider, concurrency, tasks
        self.overplan, self.rate, self.lease_s = overplan, rate, lease_s
        self.log = CommitLog(spark, f"{accepted_path.rstrip('/')}.commits", {"accepted": (accepted_path, ACCEPTED), "rejected": (rejected_path, REJECTED)})
        self.holder, self.queues, self.shared = holder, [], False
        self.calls = f"{accepted_path.rstrip('/')}.calls"
        cells = quotas.quota_table(spark, targets, weights).collect()  # as many as the configuration names
        self.quota = spark.createDataFrame(cells, QUOTA)
        self.targets = {(r.split, r.task_family): r.target for r in cells}
        self.finish_calls()
        self.log.compact()
        self.look()

    def look(self) -> None:
        """Read counts from the journals, as of the newest commit."""
        self.version = self.log.manifest()["version"]
        self.counts = {(r.split, r.task_family): r.n for r in quotas.family_counts(self.accepted()).collect()}
        self.rejections = self.rejected().count()

    def accepted(self) -> DataFrame:
        return self.log.read("accepted")

    def rejected(self) -> DataFrame:
        return self.log.read("rejected")

    def deficits(self) -> dict[str, int]:
        return {f"{s}/{f}": t - self.counts.get((s, f), 0) for (s, f), t in sorted(self.targets.items()) if self.counts.get((s, f), 0) < t}

    def acceptance(self) -> float:
        """Share of attempts that were accepted so far, one of two where there are none."""
        good = sum(self.counts.values())
        return max(0.02, (good + 1) / (good + self.rejections + 2))

    def plan(self, leases: Mapping[str, Mapping]) -> list[tuple[str, str]]:
        """The cells of the next batch's attempts; what others hold on lease counts as filled at the rate so far."""
        rate = self.acceptance()
        held: dict[tuple[str, str], int] = {}
        for lease in leases.values():
            for _, split, family in lease["rows"]:
                held[split, family] = held.get((split, family), 0) + 1
        counts = {c: self.counts.get(c, 0) + (math.ceil(held[c] * rate) if c in held else 0) for c in self.targets}
        aim = {c: counts[c] + (math.ceil((t - counts[c]) / rate) if self.overplan else t - counts[c]) for c, t in self.targets.items() if counts[c] < t}
        return quotas.next_slots(aim, counts, self.tasks * self.concurrency)

    def queue(self, sources: DataFrame, order: str) -> DataFrame:
        """Sources not attempted yet, numbered from 1 in their order, in the shared folder.  Only narrow keys are numbered, range by range."""
        todo = jn.remaining(sources, self.accepted(), self.rejected())
        keys = todo.groupBy("paper_id").agg(F.min(order).alias("_at"))
        ranked = numbered(keys, ["_at", "paper_id"]).select("paper_id", "place")
        rows = todo.dropDuplicates(["paper_id"]).join(ranked, "paper_id").select(*EXCERPT.names, "place")
        path = files.scratch(self.spark, "queue")
        rows.repartitionByRange("place").sortWithinPartitions("place").write.parquet(path)
        self.queues.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def others(self, state: Mapping) -> dict[str, Mapping]:
        """Leases of other runs that have not expired."""
        return {k: v for k, v in state.get("leases", {}).items() if v["holder"] != self.holder and v["expires"] > time.time()}

    def lease(self, name: str, wanted: list[tuple[str, str, str]]) -> list[str]:
        """Lease (paper, split, family) rows, at most a batch; the papers that no other run holds."""
        got: list[str] = []

        def take(state: dict) -> dict:
            held = {r[0] for v in self.others(state).values() for r in v["rows"]}
            rows = [list(r) for r in wanted if r[0] not in held]
            got[:] = [r[0] for r in rows]
            # one batch at a time: an older lease of this holder is of a run that is gone
            return {**state, "leases": {**self.others(state), name: {"holder": self.holder, "expires": time.time() + self.lease_s, "rows": rows}}}

        version = self.log.commit(state=take)
        if version != self.version + 1:
            self.look()
            self.shared = True
        if self.shared:
            # others have committed since the queue was made: what they have attempted is not mine to do
            papers = self.spark.createDataFrame([(p,) for p in got], "paper_id string")
            got = [r.paper_id for r in jn.remaining(papers, self.accepted(), self.rejected()).collect()]
        self.version = version
        return got

    def batch(self, queue: DataFrame, begin: int) -> int:
        """Attempt the sources after place ``begin``; returns how many places it took."""
        slots = self.plan(self.others(self.log.manifest()["state"]))
        if not slots:
            return 0
        near = queue.where(F.col("place").between(begin + 1, begin + len(slots)))
        papers = {r.place: r.paper_id for r in near.select("place", "paper_id").collect()}  # one batch
        if not papers:
            return 0
        name = uuid.uuid4().hex
        mine = set(self.lease(name, [(papers[begin + k], *cell) for k, cell in enumerate(slots, 1) if begin + k in papers]))
        places = [(begin + k, k, *cell) for k, cell in enumerate(slots, 1) if papers.get(begin + k) in mine]
        path = f"{self.calls}/{name}"
        if places:
            chosen = near.join(F.broadcast(self.spark.createDataFrame(places, "place bigint, slot bigint, split string, task_family string")), "place").drop("place")
            chosen = chosen.repartitionByRange(self.tasks, "slot") if self.tasks > 1 else chosen.coalesce(1)
            called = generate(chosen, self.provider, self.concurrency, self.rate / self.tasks if self.rate else None)
            called.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CALLED.fields]).write.parquet(path)
            self.settle(path)
        return len(papers)

    def settle(self, path: str, *, again: bool = False) -> None:
        """Commit a batch's outcomes and end its lease, at once, and drop its calls; ``again``: what an earlier run has committed is left out."""
        called, name = self.spark.read.schema(CALLED).parquet(path), path.rstrip("/").rsplit("/", 1)[1]
        good, bad = outcomes(jn.remaining(called, self.accepted(), self.rejected()) if again else called)

        def end(state: dict) -> dict:
            settled = {k: t for k, t in state.get("settled", {}).items() if t > time.time() - 2 * self.lease_s}
            if name in settled:
                raise _Settled
            return {**state, "leases": {k: v for k, v in state.get("leases", {}).items() if k != name}, "settled": {**settled, name: time.time()}}

        try:
            version = self.log.commit({"accepted": good, "rejected": bad}, state=end)
        except _Settled:  # another run has found these calls and settled them
            files.remove(self.spark, path)
            self.look()
            return
        if not again:
            n = called.count()
            found = {(r.split, r.task_family): r.n for r in quotas.family_counts(good).collect()}
            for cell, k in found.items():
                self.counts[cell] = self.counts.get(cell, 0) + k
            self.rejections += n - sum(found.values())
            if version == self.version + 1:
                self.version = version
        files.remove(self.spark, path)

    def finish_calls(self) -> None:
        """Settle what a run left behind that died after its calls; calls of a run that still holds its lease are its own."""
        held = self.others(self.log.manifest()["state"])
        for path in files.children(self.spark, self.calls):
            if files.exists(self.spark, f"{path}/_SUCCESS"):
                self.settle(path, again=True)
            elif path.rsplit("/", 1)[1] not in held:
                files.remove(self.spark, path)  # not written whole: they count for nothing

    def run(self, queue: DataFrame) -> bool:
        """Batches until the quotas are full (True) or the queue ends (False); the queue's files go."""
        at = n = 0
        while self.deficits() and (n := self.batch(queue, at)):
            at += n
            if self.log.compact():
                self.look()
        while self.queues:
            files.remove(self.spark, self.queues.pop())
        self.log.vacuum()
        return not self.deficits()


def fill_quotas(
    spark: SparkSession, sources: DataFrame, targets: Mapping[str, int], weights: Mapping[str, float], *, accepted_path: str, rejected_path: str,
    provider: Provider, concurrency: int = 8, max_attempts: int | None = None, order: str = "stream_idx", **spread,
) -> DataFrame:
    """Run batches until the quotas are full or the sources end; returns the exact, trimmed selection.

    ``spread``: ``tasks``, ``overplan``, ``rate`` (calls a second, of all tasks together), ``lease_s`` and ``holder`` of ``Filler``.
    """
    filler = Filler(spark, targets, weights, accepted_path, rejected_path, provider, concurrency, **spread)
    if max_attempts is not None:
        sources = jn.within_budget(sources, max_attempts, filler.accepted(), filler.rejected(), order=order)
    if filler.deficits() and not filler.run(filler.queue(sources, order)):
        raise RuntimeError(f"sources ran out before the quotas were full; still missing: {filler.deficits()}; completed work is kept, so add sources or attempts and run again")
    return quotas.trim(filler.accepted(), filler.quota)


def fill_stream(
    stream: DataFrame, targets: Mapping[str, int], weights: Mapping[str, float], *, accepted_path: str, rejected_path: str, provider: Provider,
    checkpoint: str, concurrency: int = 8, order: str = "paper_id", **spread,
):
    """Structured Streaming front end: attempts arriving excerpts while quotas are open; returns the query."""
    spark = stream.sparkSession

    def each(batch: DataFrame, _: int) -> None:
        filler = Filler(spark, targets, weights, accepted_path, rejected_path, provider, concurrency, **spread)
        if filler.deficits():
            filler.run(filler.queue(batch, order))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
