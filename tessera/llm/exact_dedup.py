"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot holds distinct texts already kept: one row per digest.  It never changes, so each of its buckets gets one
static binary-fuse filter (three probes, about nine bits a key for 8-bit fingerprints).  An incoming batch is handled in
two ways:

* its digests are grouped among themselves (new-batch duplicates), and
* one digest per group goes through the filter of its bucket; the few positives join the
  exact bucket by digest, and their texts are compared byte for byte.

``take_in`` keeps snapshots as folders of filters and rows: every batch is held against all of them and what it adds is the next
one, so filters are built once.  ``exact_dedup`` does the same within one table, of which a part is the snapshot.

Digests are uniform, so a bucket holds close to ``BUCKET_KEYS`` keys whatever the data; a
group of copies is one digest by then, because grouping pre-aggregates before the shuffle.

Defined results: null text counts as empty, and all empty texts are equal; texts of any length are taken whole; white space runs
``[\\x20\\x09-\\x0D]+`` count as one space; of equal texts the row with the smallest id stays (a snapshot's row before any
incoming one); a row repeated with its id is one more row of its group, and both are marked as kept where their id is the group's; an
id that stands for several texts belongs to each text's group; a row without an id stays only where its whole group has none (all such
rows are then marked as kept); other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize

BUCKET_KEYS = 200_000
_U64 = np.uint64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


# --- binary-fuse filter -------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the key reaches every bit of the result."""
    with np.errstate(over="ignore"):
        h = keys + _U64(seed)
        h = (h ^ (h >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U64(33))


def _layout(n: int) -> tuple[int, int]:
    """(segment length, number of segments) for n keys; three neighbouring segments per key."""
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    length = min(length, 1 << 18)
    factor = 1.125 if n > 100_000 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))
    cells = int(np.ceil(n * factor)) + 8
    return length, max(1, -(-cells // length) - 2)


def _cells(hashes: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three cells of each hash: one in each of three neighbouring segments."""
    first = ((hashes >> _U64(32)) * _U64(segments) >> _U64(32)).astype(np.int64)
    mask = _U64(length - 1)
    offsets = [(hashes & mask), ((hashes >> _U64(18)) & mask), ((_mix(hashes, 0x9E37) >> _U64(7)) & mask)]
    return np.stack([(first + i) * length + o.astype(np.int64) for i, o in enumerate(offsets)])


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> _U64(32))) & _U64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) over 64-bit keys.

    Peels in rounds: all cells with a single key at once; keys are then assigned in
    reverse rounds.  Another seed is tried in the rare case that peeling gets stuck.
    """
    keys = np.unique(keys.astype(_U64))
    length, segments = _layout(len(keys))
    for seed in range(1, 64):
        hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        cells = _cells(hashes, length, segments)
        size = (segments + 2) * length
        count = np.bincount(cells.ravel(), minlength=size)
        index = np.arange(len(keys), dtype=np.int64)
        held = np.zeros(size, np.int64)  # xor of the keys' numbers in a cell
        for row in cells:
            np.bitwise_xor.at(held, row, index)
        alive, rounds = np.ones(len(keys), bool), []
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(held[single], return_index=True)
            cell = single[at]
            rounds.append((key, cell))
            alive[key] = False
            touched = cells[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(key, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if alive.any():
            length = min(length * 2, 1 << 18) if seed % 8 == 0 else length
            segments += segments // 16 + 1
            continue
        prints = np.zeros(size, np.uint8)
        want = _fingerprint(hashes)
        for key, cell in reversed(rounds):
            three = prints[cells[0, key]] ^ prints[cells[1, key]] ^ prints[cells[2, key]]
            prints[cell] = want[key] ^ three ^ prints[cell]
        return seed, length, segments, prints.tobytes()
    raise RuntimeError("no seed peels these keys")


def might_hold(keys: np.ndarray, seed: int, length: int, segments: int, prints: bytes) -> np.ndarray:
    hashes = _mix(keys.astype(_U64), seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    cells = _cells(hashes, length, segments)
    table = np.frombuffer(prints, np.uint8)
    return (table[cells[0]] ^ table[cells[1]] ^ table[cells[2]]) == _fingerprint(hashes)


def _key64(digests: pd.Series) -> np.ndarray:
    """First 64 bits of each hex digest."""
    return np.frombuffer(bytes.fromhex("".join(d[:16] for d in digests)), ">u8").astype(_U64)


# --- operator -----------------------------------------------------------------------------


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes) of every row's normalised text."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t")).select(
        "doc_id", F.sha2("_t", 256).alias("digest"), F.octet_length("_t").cast("long").alias("n_bytes")
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the smallest id and the number of rows."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One binary-fuse filter per bucket of an immutable snapshot (columns digest, ...)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, prints = build_filter(_key64(pdf["digest"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "seg_len": [length], "segs": [segments], "prints": [prints]})

    return (
        _bucketed(snapshot.select("digest"), buckets)
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, seed int, seg_len int, segs int, prints binary")
    )


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``incoming`` (distinct digests) that the filter of their bucket may hold."""

    def probe(key, keys: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        if not len(filt) or not len(keys):
            return keys.iloc[:0][["digest"]]
        f = filt.iloc[0]
        return keys.loc[might_hold(_key64(keys["digest"]), int(f.seed), int(f.seg_len), int(f.segs), f.prints), ["digest"]]

    left = _bucketed(incoming.select("digest"), buckets).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string")


def _few(table: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """The table, as a broadcast where its rows, counted, stay within the bound."""
    n = max_bytes // row_bytes
    return F.broadcast(table) if table.limit(n + 1).count() <= n else table


def match_snapshot(incoming: DataFrame, incoming_text: DataFrame, snapshot: DataFrame, snapshot_text: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest, snapshot_id, hit) of incoming groups whose text is, byte for byte, in the snapshot.

    ``incoming`` and ``snapshot`` are ``grouped`` tables; the text tables hold (digest, text), normalised, for at least their digests.
    """
    positive = screen(incoming, filters, buckets)
    pairs = materialize(positive.join(snapshot.select("digest", F.col("keep_id").alias("snapshot_id")), "digest"))
    wanted = _few(pairs.select("digest").distinct(), 100)

    def texts(table, name):
        """One text per positive group; no other text is shuffled."""
        return table.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias(name))

    checked = pairs.join(texts(incoming_text, "new_text"), "digest").join(texts(snapshot_text, "old_text"), "digest")
    return checked.where(F.col("new_text") == F.col("old_text")).select("digest", "snapshot_id", F.lit(True).alias("hit"))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(normalised(F.col("text")).alias("text")).select(F.sha2("text", 256).alias("digest"), "text")


def _named(marked: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row (doc_id, digest) with its group (digest, g: keep_id, group_size); a row without a group stands alone."""
    keep = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("g.keep_id"))
    return marked.join(groups, "digest", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(~F.col("g.of_snapshot"), F.lit(True)).alias("own"), F.col("digest").alias("text_sha256"),
    ).withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")))


def exact_dedup(docs: DataFrame, is_snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Dedup a table of which ``is_snapshot`` marks the rows that an earlier run has taken in.

    By default the lower half of the id range is the snapshot and the upper half the batch,
    so that a match always keeps the smaller id.  Returns one row per input row: doc_id,
    keep_id, group_size, kept, text_sha256.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(digests(rows))
    if is_snapshot is None:
        low, high, n = marked.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
        is_snapshot = F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2)
    else:
        n = marked.count()
    is_snapshot = F.coalesce(is_snapshot, F.lit(False))  # rows that the mark is null for (no id) are of the batch
    buckets = max(1, -(-n // bucket_keys))
    old = grouped(marked.where(is_snapshot))
    new = grouped(marked.where(~is_snapshot))
    matched = match_snapshot(new, _texts(rows.where(~is_snapshot)), old, _texts(rows.where(is_snapshot)), snapshot_filters(old, buckets), buckets)
    # groups of the snapshot, with the incoming groups that match them; groups of the batch alone
    sizes = new.select("digest", F.col("keep_id").alias("new_keep"), F.col("group_size").alias("new_size"))
    joined = sizes.join(matched, "digest", "left")
    both = old.join(joined.where("hit").select("digest", "new_size"), "digest", "left")
    groups = materialize(
        both.select("digest", "keep_id", (F.col("group_size") + F.coalesce("new_size", F.lit(0))).alias("group_size"))
        .unionByName(joined.where("hit is null").select("digest", F.col("new_keep").alias("keep_id"), F.col("new_size").alias("group_size")))
        .where(F.col("group_size") > 1)
    )
    # one digest names two groups only if two different texts share it; then the larger id's row tells them apart
    hit = groups.groupBy("digest").agg(F.max(F.struct("keep_id", "group_size", F.lit(False).alias("of_snapshot"))).alias("g"))
    return _named(marked, hit).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# --- snapshots that stay ---------------------------------------------------------------------


def snapshots(spark, folder: str) -> list[str]:
    """Paths of a folder's snapshots, oldest first; one that was not finished does not count."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.toString() + "/filters/_SUCCESS"))
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().isdigit()]
    return [p.toString() for p in sorted(found, key=lambda p: int(p.getName())) if done(p)]


def take_in(batch: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, batch_id: int | None = None) -> DataFrame:
    """Dedup a batch against all snapshots of ``folder`` and add what it brings as the next one.

    ``batch_id`` (0 and up, each batch's larger than those before) names the snapshot: a batch that is tried again under its number is held
    against the earlier ones only, writes its snapshot anew and has the same result.  Without it every call is a new batch.

    Returns one row per row of the batch: doc_id, keep_id (of the snapshot's row where it has the text), group_size (rows
    of the batch, and the snapshot's), kept, text_sha256.
    """
    spark = batch.sparkSession
    rows = batch.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(digests(rows))
    new = materialize(grouped(marked))
    earlier = [p for p in snapshots(spark, folder) if batch_id is None or int(p.rsplit("/", 1)[1]) < batch_id]
    matched = None
    for path in earlier:
        kept, filters = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/filters")
        buckets = filters.select("buckets").first()
        if buckets is None:
            continue
        found = match_snapshot(new, _texts(rows), kept.select("digest", "keep_id"), kept.select("digest", "text"), filters.drop("buckets"), buckets[0])
        matched = found if matched is None else matched.unionByName(found)
    if matched is None:
        joined = new.withColumn("snapshot_id", F.lit(None).cast("long")).withColumn("hit", F.lit(None).cast("boolean"))
    else:
        joined = new.join(matched.groupBy("digest").agg(F.min("snapshot_id").alias("snapshot_id"), F.lit(True).alias("hit")), "digest", "left")
    joined = materialize(joined)
    added = joined.where("hit is null").select("digest", "keep_id")
    number = batch_id if batch_id is not None else int(earlier[-1].rsplit("/", 1)[1]) + 1 if earlier else 0
    texts = _texts(rows).groupBy("digest").agg(F.first("text").alias("text"))
    added.join(texts, "digest").write.mode("overwrite").parquet(f"{folder}/{number}/rows")
    buckets = max(1, -(-added.count() // bucket_keys))
    snapshot_filters(added, buckets).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/{number}/filters")
    known = F.coalesce("hit", F.lit(False))
    of = F.struct(
        F.when(known, F.col("snapshot_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        (F.col("group_size") + known.cast("int")).alias("group_size"), known.alias("of_snapshot"),
    )
    out = _named(marked, joined.select("digest", of.alias("g")))
    return out.select("doc_id", "keep_id", "group_size", (F.col("kept") & F.col("own")).alias("kept"), "text_sha256")
