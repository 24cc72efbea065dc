"""A remote corpus as a Spark data source, and publication of a table as a data source writer, over injected transports.

Reading: ``corpus_source(fetch)`` is a data source for ``spark.read.format(...)`` and ``spark.readStream.format(...)``.  ``fetch`` takes a request
document and answers one; nothing here opens a connection.  Requests are

* ``{"op": "size", "dataset", "split", "where"}`` -> ``{"rows": n}``
* ``{"op": "page", "dataset", "split", "where", "offset", "rows"}`` -> ``{"rows": [record, ...]}``, exactly as many as asked for.

Partitions are ranges of rows, read page by page, so no task holds more than a page; a lost task reads its range again.  The option ``limit``
is planned into the ranges, so what lies beyond it is never asked for; equality filters on columns that the corpus can filter by
(option ``filterable``) go into ``where``, and Spark applies all others.

Writing: ``publication(publisher)`` stages what tasks write in parts and publishes all parts of a run at once when every task has
ended; a run that fails publishes nothing, and parts of failed or repeated attempts are discarded.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.schemas import RAW_SOURCE

Fetch = Callable[[dict], Mapping]


@dataclass
class Rows(InputPartition):
    """Rows [start, end) of a split."""

    start: int
    end: int


@dataclass
class Corpus:
    """What a reader knows of its corpus; pickled to tasks."""

    fetch: Fetch
    options: Mapping[str, str]
    schema: StructType
    where: dict[str, Any] = field(default_factory=dict)

    def option(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def ask(self, **request) -> Mapping:
        """One request; timeouts and lost connections are tried again, with doubled waits."""
        request = {"dataset": self.options["dataset"], "split": self.options.get("split", "train"), "where": dict(self.where), **request}
        retries, wait = self.option("retries", 3), float(self.options.get("wait", 0.5))
        for turn in range(retries + 1):
            try:
                return self.fetch(request)
            except (TimeoutError, ConnectionError):
                if turn == retries:
                    raise
                time.sleep(wait * 2**turn)
        raise AssertionError

    def size(self) -> int:
        return int(self.ask(op="size")["rows"])

    def ranges(self, start: int, end: int) -> list[Rows]:
        step = self.option("partition_rows", 10_000)
        return [Rows(a, min(a + step, end)) for a in range(start, end, step)]

    def pages(self, part: Rows) -> Iterator[pa.RecordBatch]:
        page, kind = self.option("page_rows", 100), to_arrow_schema(self.schema)
        for at in range(part.start, part.end, page):
            n = min(page, part.end - at)
            rows = list(self.ask(op="page", offset=at, rows=n)["rows"])
            if len(rows) != n:
                raise RuntimeError(f"the corpus answered {len(rows)} rows for {n} at {at}")
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.schema.names} for r in rows], schema=kind)


class CorpusReader(DataSourceReader):
    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def pushFilters(self, filters: list[Filter]):
        able = {c.strip() for c in self.corpus.options.get("filterable", "").split(",")}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in able and self.corpus.where.get(f.attribute[0], f.value) == f.value:
                self.corpus.where[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> Sequence[Rows]:
        limit = self.corpus.options.get("limit")
        n = self.corpus.size()
        return self.corpus.ranges(0, n if limit is None else min(n, int(limit))) or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return self.corpus.pages(partition)


class CorpusStream(DataSourceStreamReader):
    """New rows of a growing split; the offset is the number of rows read."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def initialOffset(self) -> dict:
        return {"rows": self.corpus.option("from", 0)}

    def latestOffset(self) -> dict:
        return {"rows": self.corpus.size()}

    def partitions(self, start: dict, end: dict) -> Sequence[Rows]:
        return self.corpus.ranges(start["rows"], end["rows"])

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return self.corpus.pages(partition)


def corpus_source(fetch: Fetch, name: str = "remote_corpus", record: StructType = RAW_SOURCE) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; options: dataset, split, limit, filterable, page_rows, partition_rows, retries, wait."""

    class RemoteCorpus(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return record

        def _corpus(self, schema: StructType) -> Corpus:
            return Corpus(fetch, dict(self.options), schema)

        def reader(self, schema: StructType) -> DataSourceReader:
            return CorpusReader(self._corpus(schema))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return CorpusStream(self._corpus(schema))

    return RemoteCorpus


def read_corpus(spark: SparkSession, fetch: Fetch, dataset: str, *, split: str = "train", limit: int | None = None, streaming: bool = False, **options) -> DataFrame:
    """Rows of a remote corpus in the declared shape; ``limit`` takes the first rows of the split and asks for no others."""
    spark.dataSource.register(corpus_source(fetch))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = (spark.readStream if streaming else spark.read).format("remote_corpus").option("dataset", dataset).option("split", split)
    for key, value in {**options, **({} if limit is None else {"limit": limit})}.items():
        reader = reader.option(key, str(value))
    return reader.load()


class Publisher(Protocol):
    def stage(self, repo: str, run: str, name: str, content: bytes) -> None: ...

    def publish(self, repo: str, run: str, names: list[str], info: dict) -> None: ...

    def discard(self, repo: str, run: str) -> None: ...


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]
    rows: int


class PublicationWriter(DataSourceArrowWriter):
    """Parts of a table, Parquet files of bounded size, staged by tasks and published together."""

    def __init__(self, publisher: Publisher, options: Mapping[str, str]):
        self.publisher, self.repo, self.run = publisher, options["repo"], uuid.uuid4().hex
        self.config, self.part_rows = options.get("config", "default"), int(options.get("part_rows", 50_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        attempt, names, total, waiting = uuid.uuid4().hex, [], 0, {}

        def stage(split: str) -> None:
            table = pa.Table.from_batches(waiting.pop(split))
            content = io.BytesIO()
            pq.write_table(table, content)
            name = f"{self.config}/{split}-{attempt}-{len(names):05d}.parquet"
            self.publisher.stage(self.repo, self.run, name, content.getvalue())
            names.append(name)

        for batch in iterator:
            total += batch.num_rows
            for split in pc.unique(batch.column("split")).to_pylist() if "split" in batch.schema.names else ["train"]:
                own = batch.filter(pc.equal(batch.column("split"), split)).drop_columns(["split"]) if "split" in batch.schema.names else batch
                waiting.setdefault(split, []).append(own)
                if sum(b.num_rows for b in waiting[split]) >= self.part_rows:
                    stage(split)
        for split in list(waiting):
            stage(split)
        return Staged(names, total)

    def commit(self, messages: list[Staged | None]) -> None:
        told = [m for m in messages if m is not None]
        self.publisher.publish(self.repo, self.run, sorted(n for m in told for n in m.names), {"config": self.config, "rows": sum(m.rows for m in told)})
        self.publisher.discard(self.repo, self.run)  # what attempts staged that did not count

    def abort(self, messages: list[Staged | None]) -> None:
        self.publisher.discard(self.repo, self.run)


def publication(publisher: Publisher, name: str = "publication") -> type[DataSource]:
    """A data source class that tables can be written to; options: repo, config, part_rows."""

    class Publication(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            return PublicationWriter(publisher, dict(self.options))

    return Publication


def publish(table: DataFrame, publisher: Publisher, repo: str, *, config: str = "default", part_rows: int = 50_000) -> None:
    """Publish a table, split by its column ``split`` where it has one, whole or not at all."""
    spark = table.sparkSession
    spark.dataSource.register(publication(publisher))
    table.write.format("publication").option("repo", repo).option("config", config).option("part_rows", str(part_rows)).mode("append").save()
