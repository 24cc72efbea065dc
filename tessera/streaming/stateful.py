"""Operators on unbounded streams that keep their own state: a seeded shuffle buffer, and the first row of every paper.

State lives in the state store with the query's checkpoint, so a query that is restarted goes on where its last whole micro-batch
ended and gives what it would have given.  Both need the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Buffer(StatefulProcessor):
    """Up to ``size`` rows of a lane; each row that comes after puts out the one whose place it takes.

    A row that flushes puts out the rest of its lane, in a seeded order.
    """

    def __init__(self, names: Sequence[str], schema: T.StructType, order: str, flush: str, seed: int, size: int):
        self.names, self.schema, self.order, self.flush, self.seed, self.size = list(names), schema, order, flush, seed, size

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType()), T.StructField("held", T.LongType())]))
        self.slots = handle.getMapState("slots", T.StructType([T.StructField("at", T.LongType())]), self.schema)

    def _place(self, lane, n: int, of: int) -> int:
        return int.from_bytes(hashlib.md5(f"{self.seed}:{lane}:{n}".encode()).digest()[:8], "big") % of

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        lane, (n, held) = key[0], self.count.get() if self.count.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: (bool(r[self.flush]), r[self.order] is not None, r[self.order] or 0)):
            if r[self.flush]:
                left = sorted(range(held), key=lambda i: self._place(lane, -1 - i, 1 << 62))
                for at in left:
                    yield Row(**dict(zip(self.names, self.slots.getValue((at,)))))
                    self.slots.removeKey((at,))
                held = 0
                continue
            if held < self.size:
                at, held = held, held + 1
            else:
                at = self._place(lane, n, self.size)
                yield Row(**dict(zip(self.names, self.slots.getValue((at,)))))
            self.slots.updateValue((at,), tuple(r[c] for c in self.names))
            n += 1
        self.count.update((n, held))

    def close(self) -> None:
        pass


def shuffled(stream: DataFrame, *, lane: str, order: str, flush: str, seed: int = 17, buffer: int = 20_000) -> DataFrame:
    """The stream's rows in a seeded order that a bounded buffer allows: a row leaves when a later one takes its place.

    ``lane`` names the buffer of a row (as many buffers work at once as there are lanes), ``order`` its place in its lane, which makes the
    result independent of how micro-batches order their rows (rows of a micro-batch and lane are sorted by it, in memory), and ``flush`` is true for a
    row that only asks for the rest of its lane.  No buffer ever holds more than ``buffer`` rows.
    """
    if buffer < 1:
        raise ValueError("a buffer holds at least one row")
    kept = T.StructType([f for f in stream.schema.fields if f.name not in (lane, flush)])
    processor = _Buffer(kept.names, kept, order, flush, seed, buffer)
    return stream.groupBy(lane).transformWithState(processor, kept, outputMode="Append", timeMode="None")


class _First(StatefulProcessor):
    """The smallest row of a paper so far; a row is put out when it takes the first place."""

    def __init__(self, schema: T.StructType, order: Sequence[str], ttl_ms: int | None):
        self.schema, self.order, self.ttl_ms = schema, list(order), ttl_ms

    def init(self, handle) -> None:
        self.best = handle.getValueState("best", self.schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        names = self.schema.names
        place = lambda r: tuple(r[c] for c in self.order)
        old = Row(**dict(zip(names, self.best.get()))) if self.best.exists() else None
        new = min(rows, key=place)
        if old is None or place(new) < place(old):
            self.best.update(tuple(new[c] for c in names))
            yield Row(**{c: new[c] for c in names})

    def close(self) -> None:
        pass


def first_per_paper(stream: DataFrame, order: Sequence[str] = ("order_key",), *, ttl_ms: int | None = None) -> DataFrame:
    """Rows that are the first of their ``paper_id`` when they come; a row with a smaller order replaces an earlier answer.

    The last answer for a paper is that of ``first_qualifying`` on all rows, whatever the micro-batches were (``settled`` picks it).  With
    ``ttl_ms`` a paper is forgotten so long after its last change, so state does not grow for ever; a paper that comes again
    after that is answered anew.  The order columns must not be null.
    """
    processor = _First(stream.schema, order, ttl_ms)
    return stream.groupBy("paper_id").transformWithState(processor, stream.schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def settled(answers: DataFrame, order: Sequence[str] = ("order_key",)) -> DataFrame:
    """The answers that stand, of all that ``first_per_paper`` has put out."""
    from tessera.sources.corpus import first_qualifying

    return first_qualifying(answers, tuple(order))
