"""A memo of judgments as bucketed Parquet files, with a Bloom filter beside each, so that a lookup reads the files that may hold its keys.

Rows are dealt into buckets by a hash of their key; a commit writes one file a bucket and, in the same commit, one filter a file.  A lookup
sends its keys past the filters of their buckets (as many as there are commits since the last compaction) and opens the files that are
left.  ``seq`` counts commits, so the last written row of a key is told without clocks; ``compact`` keeps that row only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schemas import LONG, MEMO, STR
from tessera.sources import files
from tessera.sources.commits import CommitLog, Conflict

FILTERS = T.StructType([T.StructField("file", STR), T.StructField("bucket", LONG), T.StructField("buckets", LONG), T.StructField("keys", LONG), T.StructField("bits", T.BinaryType())])
HASHES = 5
BITS_A_KEY = 10  # with five hashes about one key in a hundred passes a filter by chance


def is_store(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path.rstrip('/')}/log")


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bit places of keys with these two hashes, a row each."""
    with np.errstate(over="ignore"):
        return ((h1.view(np.uint64)[:, None] + np.arange(HASHES, dtype=np.uint64) * (h2.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("h1", F.xxhash64("cache_key")).withColumn("h2", F.xxhash64(F.lit("memo"), "cache_key"))


class MemoStore:
    """(cache_key, ..., seq) rows of ``schema``, of which the last written one of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = MEMO, *, bucket_rows: int = 50_000, most_files: int = 8):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.bucket_rows, self.most_files = bucket_rows, most_files
        tables = {"rows": (f"{self.path}/rows", schema), "filters": (f"{self.path}/filters", FILTERS)}
        self.log = CommitLog(spark, f"{self.path}/log", tables, form="parquet")

    def take_in(self, rows: DataFrame) -> int:
        """Rows of another memo, with their own ``seq``, into an empty store."""
        base = self.log.manifest()
        if base["tables"]["rows"]:
            raise RuntimeError(f"{self.path} has rows already")
        last = rows.agg(F.max("seq")).first()[0]
        return self._write(rows, base["version"], int(last or 0))

    def append(self, rows: DataFrame, tries: int = 5) -> int:
        """Add rows (``seq`` is given here) in one commit; returns its number.  Compacts where lookups would meet many files."""
        for k in range(tries):
            base = self.log.manifest()
            seq = base["state"].get("seq", -1) + 1
            try:
                done = self._write(rows.drop("seq").withColumn("seq", F.lit(seq).cast("long")), base["version"], seq)
                break
            except Conflict:  # another writer was faster; its rows are older than these
                if k == tries - 1:
                    raise
        if len(self.log.manifest()["tables"]["rows"]) > self.most_files * max(1, self.log.manifest()["state"].get("buckets", 1)):
            self.compact()
        return done

    def compact(self) -> bool:
        """Keep the last row of every key, in one file a bucket; False where another writer was faster."""
        from tessera.operators.reward import latest

        base = self.log.manifest()
        if not base["tables"]["rows"]:
            return False
        kept = latest(self.log.read("rows", base["version"]), keep_seq=True).select(*self.schema.names)
        try:
            self._write(kept, base["version"], base["state"].get("seq", 0), replace=True)
        except Conflict:
            return False
        return True

    def _write(self, rows: DataFrame, parent: int, seq: int, *, replace: bool = False) -> int:
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        rows = files.written(rows, "memo")
        n = rows.count()
        buckets = 1 << max(0, (max(0, n - 1) // self.bucket_rows)).bit_length()
        bucket = F.pmod(F.xxhash64("cache_key"), F.lit(buckets))
        listed = self.log._stage("rows", rows.repartitionByRange(buckets, bucket).sortWithinPartitions(bucket, "cache_key")) if n else []
        filters = self._filters(listed, buckets, max(1024, BITS_A_KEY * -(-n // buckets)))
        state = lambda s: {**s, "seq": max(seq, s.get("seq", -1)), "buckets": buckets if replace else max(buckets, s.get("buckets", 1))}
        both = {"rows": listed, "filters": filters}
        return self.log.commit(None if replace else both, replace=both if replace else None, expected=parent, state=state)

    def _filters(self, listed: list[str], buckets: int, bits: int) -> DataFrame:
        """One filter for every file and bucket in it; parts of a file come from several tasks and are put together."""
        if not listed:
            return self.spark.createDataFrame([], FILTERS)
        folder = f"{self.path}/rows"
        keys = self.spark.read.schema(self.schema).parquet(*[f"{folder}/{f}" for f in listed])
        name = F.regexp_extract(F.col("_metadata.file_path"), "/(commit-[^/]+/[^/]+)$", 1)
        keys = _hashed(keys.select("cache_key", name.alias("file"))).withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)))
        size = -(-bits // 8)
        bits = 8 * size  # a filter's size is told by its bytes

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple, list] = {}
            for batch in batches:
                frame = batch.to_pandas()
                for at, own in frame.groupby(["file", "bucket"], sort=False):
                    kept = found.setdefault(at, [0, np.zeros(size * 8, bool)])
                    kept[0] += len(own)
                    kept[1][_places(own["h1"].to_numpy(), own["h2"].to_numpy(), bits).ravel()] = True
                    if len(found) > 64:  # buckets come one after another: the earlier ones are over
                        done = next(iter(found))
                        yield rows_of([(done, found.pop(done))])
            yield rows_of(list(found.items()))

        def rows_of(items: list) -> pa.RecordBatch:
            columns = [[a[0] for a, _ in items], [a[1] for a, _ in items], [v[0] for _, v in items], [np.packbits(v[1]).tobytes() for _, v in items]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "bucket", "keys", "bits"])

        parts = keys.select("file", "bucket", "h1", "h2").mapInArrow(part, "file string, bucket long, keys long, bits binary")

        def whole(pdf):
            total = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
            first = pdf.iloc[:1].copy()
            first["keys"], first["bits"] = pdf["keys"].sum(), [total.tobytes()]
            return first

        one = parts.groupBy("file", "bucket").applyInPandas(whole, "file string, bucket long, keys long, bits binary")
        return one.withColumn("buckets", F.lit(buckets).cast("long")).select(*FILTERS.names)

    def read(self) -> DataFrame:
        """All rows, of which several may have one key."""
        return self.log.read("rows")

    def files_for(self, keys: DataFrame) -> list[str]:
        """The files that may hold any of ``keys`` (cache_key); their number is bounded by that of the store's files."""
        manifest = self.log.manifest()
        listed = manifest["tables"]["filters"]
        if not listed:
            return []
        filters = self.log.read("filters", manifest["version"])
        sizes = filters.agg(F.collect_set("buckets").alias("b"), F.sum(F.octet_length("bits")).alias("n")).first()  # a few powers of two
        asked = _hashed(keys.select("cache_key").where("cache_key is not null").distinct())
        asked = asked.withColumn("buckets", F.explode(F.array(*[F.lit(b).cast("long") for b in sizes.b]))).withColumn("bucket", F.pmod("h1", "buckets"))
        met = asked.join(F.broadcast(filters) if (sizes.n or 0) <= 32 << 20 else filters, ["buckets", "bucket"]).select("file", "bits", "h1", "h2")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[str] = set()
            for batch in batches:
                found = []
                for file, bits, h1, h2 in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                    if file not in seen:
                        at = _places(np.array([h1]), np.array([h2]), 8 * len(bits))[0]
                        if all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in at.tolist()):
                            seen.add(file)
                            found.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["file"])

        return sorted(r.file for r in met.mapInArrow(test, "file string").distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The last written row of each of ``keys`` (cache_key) that the store has; only files that may hold one are read."""
        from tessera.operators.reward import latest
        from tessera.sources.commits import read_listed

        rows = read_listed(self.spark, f"{self.path}/rows", self.files_for(keys), self.schema, "parquet")
        return latest(rows.join(keys.select("cache_key").distinct(), "cache_key", "left_semi"), keep_seq=True)
