"""Packing of documents into sequences of bounded length, by shortest-pack-first over the length histogram.

A document's tokens (with the end token) are cut into whole sequences and a tail.  Only the histogram of tail lengths, at most
``size - 1`` numbers, is planned: lengths are placed longest first, each into the pattern with the most room, and what changes are
counts of packing patterns, never documents.  Patterns that end up with a gap are then filled with cut tails of the emptiest ones; the
last sequence that is still short is cut at powers of two, which need no padding.  The plan (a few thousand rows at any number of
documents) joins back to the documents by the rank of a tail among those of its length; ranks are counted where the tails lie,
and only counts per partition and length are added up.

Defined results: a null or empty text is the end token alone; texts of any length are taken whole; rows without an id, repeated rows
and repeated ids are documents of their own; ties (tails of one length) take places in the order in which partitions hold
them; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, materialize

#: fragments of cut tails beyond this many are joined by a shuffle, fewer (some 60 bytes each) are broadcast
BROADCAST_ROWS = 500_000


class Encoder:
    """Token ids of a tokenizer file, as its library gives them without special tokens around a text.

    A plain byte-level BPE (ids in the order of merges, no normaliser) is run by its ranks, which is several times faster and gives
    the same ids; texts that hold the string of an added token, and all texts of other tokenizers, go to the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        if self._plain(spec):
            import public_tokenizers
            import tiktoken

            self.ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self._bytes(spec["model"]["vocab"]), special_tokens={})

    @staticmethod
    def _plain(spec: dict) -> bool:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or any(model.get(k) for k in odd) or spec.get("normalizer") or spec.get("truncation"):
            return False
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        return [model["vocab"].get(m) for m in made] == list(range(256, 256 + len(made)))

    @staticmethod
    def _bytes(vocab: dict[str, int]) -> dict[bytes, int]:
        """Byte strings of a byte-level vocabulary, whose letters stand for bytes: visible ones for themselves, the rest from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in shown}
        letters.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
        return {bytes(letters[c] for c in word): i for word, i in vocab.items()}

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        import numpy as np

        if self.ranks is None or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@dataclass(frozen=True)
class Piece:
    """``copies`` tails of one length in each sequence of a pattern, or a fragment of one.

    Sequence i of the pattern holds the tails ranked ``rank + i * stride + skip`` and on; each gives the tokens [start, start + take).
    """

    length: int
    rank: int
    stride: int
    skip: int
    copies: int
    start: int
    take: int


@dataclass
class Pattern:
    """``count`` sequences that hold the same lengths."""

    count: int
    used: int
    pieces: list[Piece]

    def split(self, count: int) -> Pattern:
        """Take the first ``count`` sequences off this pattern."""
        head = Pattern(count, self.used, list(self.pieces))
        self.pieces = [replace(p, rank=p.rank + count * p.stride) for p in self.pieces]
        self.count -= count
        return head


def shortest_pack_first(histogram: Sequence[int], size: int) -> list[Pattern]:
    """Patterns for ``histogram[n]`` tails of each length n below ``size``, longest first, each into the emptiest pattern that is open.

    Where nothing has room, as few new sequences are opened as the length allows.
    """
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # rooms that are in use, ascending

    def put(p: Pattern) -> None:
        room = size - p.used
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(p)

    for length in range(len(histogram) - 1, 0, -1):
        n, rank = int(histogram[length]), 0
        while n:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                p = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop()
                if n < p.count:
                    rest, p = p, p.split(n)
                    put(rest)
                copies = min((size - p.used) // length, n // p.count)
            else:
                p = Pattern(-(-n // (size // length)), 0, [])
                copies = min(size // length, n // p.count)
            p.pieces.append(Piece(length, rank, copies, 0, copies, 0, length))
            p.used += copies * length
            rank += copies * p.count
            n -= copies * p.count
            put(p)
    return [p for room in rooms for p in by_room[room]]


def _give(donor: Pattern, taker: Pattern, gap: int, least: int) -> None:
    """Move up to ``gap`` tokens from the end of ``donor`` to ``taker`` (as many sequences of each), cutting the last fragment."""
    while gap >= least and donor.pieces:
        last = donor.pieces.pop()
        if last.take <= gap:
            k = min(last.copies, gap // last.take)
            taker.pieces.append(replace(last, skip=last.skip + last.copies - k, copies=k))
            if k < last.copies:
                donor.pieces.append(replace(last, copies=last.copies - k))
            moved = k * last.take
        else:
            moved = gap if last.take - gap >= least else last.take - least
            if moved < least:
                donor.pieces.append(last)
                return
            one = replace(last, skip=last.skip + last.copies - 1, copies=1)
            taker.pieces.append(replace(one, start=last.start + last.take - moved, take=moved))
            donor.pieces.append(replace(one, take=last.take - moved))
            if last.copies > 1:
                donor.pieces.insert(-1, replace(last, copies=last.copies - 1))
        donor.used -= moved
        taker.used += moved
        gap -= moved


def fill_gaps(patterns: list[Pattern], size: int, least: int) -> list[Pattern]:
    """Fill the gaps of fuller patterns with the tokens of the emptiest, cutting tails into fragments of ``least`` tokens or more."""
    full = lambda p: size - p.used < least or p.used & (p.used - 1) == 0
    done = [p for p in patterns if full(p)]
    queue = sorted((p for p in patterns if not full(p)), key=lambda p: p.used)
    while queue:
        if len(queue) == 1:
            donor = queue[0]
            if donor.count == 1:
                break
            takers = max(1, min(donor.count - 1, donor.count * donor.used // size))
            queue.append(donor.split(takers))
        donor, taker = queue[0], queue[-1]
        t = min(donor.count, taker.count)
        d = queue.pop(0) if donor.count == t else donor.split(t)
        k = queue.pop() if taker.count == t else taker.split(t)
        before = k.used
        _give(d, k, size - k.used, least)
        if d.used:
            queue.insert(0, d)
        if full(k) or k.used == before:
            done.append(k)
        else:
            bisect.insort(queue, k, key=lambda p: p.used)
    return done + queue


def cut_at_powers(pattern: Pattern, least_used: int) -> list[Pattern]:
    """A single short sequence as sequences whose lengths are powers of two."""
    out, whole = [], Pattern(1, pattern.used, list(pattern.pieces))
    while whole.used:
        part = Pattern(1, 0, [])
        _give(whole, part, 1 << (whole.used.bit_length() - 1), least_used)
        out.append(part)
    return out


PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "rank_from", "rank_to", "stride", "skip", "copies", "frag", "take", "first_sequence", "at")])


def plan_rows(histogram: Sequence[int], size: int, least: int = 8) -> tuple[list[tuple], int]:
    """(rows of the plan, number of sequences) for a histogram of tail lengths."""
    patterns = fill_gaps(shortest_pack_first(histogram, size), size, least)
    ends = [p for p in patterns if p.count == 1 and size - p.used >= least and p.used & (p.used - 1)]
    if ends:
        short = min(ends, key=lambda p: p.used)
        patterns = [p for p in patterns if p is not short] + cut_at_powers(short, 1)
    rows, sequence = [], 0
    for p in patterns:
        at = 0
        for x in p.pieces:
            rows.append((x.length, x.rank, x.rank + p.count * x.stride, x.stride, x.skip, x.copies, x.start, x.take, sequence, at))
            at += x.copies * x.take
        sequence += p.count
    return rows, sequence


def tokenized(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per document: its size, its tail with the tail's rank in the partition, and checksums of its whole sequences.  Written."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    long, longs, blob = T.LongType(), T.ArrayType(T.LongType(), False), T.BinaryType()
    fields = [("part", T.IntegerType()), ("row", long), ("doc_tokens", long), ("n_full", long), ("full_before", long), ("tail", long), ("rank", long), ("tail_crc", long)]
    fields += [("full_crcs", longs), ("tail_ids", blob)] + ([("full_ids", T.ArrayType(blob, False))] if with_ids else [])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(n, t) for n, t in fields]])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks, row, before = Encoder(tokenizer), [0] * size, 0, 0
        for batch in batches:
            out: dict[str, list] = {n: [] for n, _ in fields if n != "part"}
            for text in batch.column(1).to_pylist():
                ids = (encoder.packed(text) if text else b"") + end
                n = len(ids) // 4
                whole, tail = divmod(n, size)
                cuts = [ids[4 * size * k : 4 * size * (k + 1)] for k in range(whole)]
                last = ids[4 * size * whole :]
                values = (row, n, whole, before, tail, ranks[tail], zlib.crc32(last), [zlib.crc32(c) for c in cuts], last)
                for name, value in zip(out, values):
                    out[name].append(value)
                if with_ids:
                    out["full_ids"].append(cuts)
                row, before = row + 1, before + whole
                ranks[tail] += 1
            kinds = {"full_crcs": pa.list_(pa.field("element", pa.int64(), False)), "tail_ids": pa.binary(), "full_ids": pa.list_(pa.field("element", pa.binary(), False))}
            columns = [batch.column(0), batch.column(2), *[pa.array(out[n], kinds.get(n, pa.int64())) for n in out]]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    with batches_of(docs.sparkSession, 256):
        return materialize(rows.mapInArrow(run, schema))


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    size: int = 1024,
    end_id: int = 0,
    least: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if wanted, ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers.  Cut tails have fragments of at least ``least`` tokens (but for the last
    sequence), so up to ``least - 1`` tokens of a sequence may be padding; ``tokenizer`` must be readable on every executor.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer, size, end_id, id_col, text_col, with_ids)
    # counts per partition and length; ranks go on from partition to partition
    counts = rows.groupBy("tail", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("tail", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("base"))
    histogram = [0] * size
    for r in counts.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect():  # below ``size`` rows
        histogram[r.tail] = r.n
    plan, sequences = plan_rows(histogram, size, least)
    planned = F.broadcast(spark.createDataFrame(plan, PLAN))
    ranked = rows.where("tail > 0").select("id", "part", "row", "doc_tokens", "tail", "rank", "tail_crc").join(base, ["tail", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    rank = F.col("rank") - F.col("rank_from")
    place = F.pmod(rank, "stride") - F.col("skip")
    here = (F.col("tail") == F.col("length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    met = ranked.join(planned, here & (place >= 0) & (place < F.col("copies")))
    met = met.select(
        "id", "part", "row", (F.col("doc_tokens") - F.col("tail") + F.col("frag")).alias("start"), F.col("take").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - rank_from) div stride")).alias("sequence_id"), (F.col("at") + place * F.col("take")).alias("offset"),
        "frag", (F.col("take") < F.col("tail")).alias("cut"),
    )
    met = materialize(met)
    out = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    slice_of = F.expr("substring(tail_ids, int(4 * frag + 1), int(4 * length))")
    bytes_of = rows.select("part", "row", "tail_ids")
    wanted = met if with_ids else met.where("cut")
    small = wanted.count() <= BROADCAST_ROWS and not with_ids
    found = bytes_of.join(F.broadcast(wanted) if small else wanted, ["part", "row"])
    found = found.withColumn("ids", slice_of).withColumn("ids_crc32", F.crc32("ids"))
    tails = found if with_ids else found.drop("ids").unionByName(met.where("not cut").withColumn("tail_ids", F.lit(None).cast("binary")))
    # whole sequences come after the planned ones, in the order in which partitions hold them; one count per partition
    full_counts = rows.groupBy("part").agg(F.sum("n_full").alias("n")).collect()
    bases, at = [], sequences
    for r in sorted(full_counts, key=lambda r: r.part):
        bases.append((r.part, at))
        at += r.n
    full_base = F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))
    full = rows.where("n_full > 0").join(full_base, "part")
    each = F.arrays_zip(F.col("full_crcs").alias("crc"), F.col("full_ids").alias("ids")) if with_ids else F.arrays_zip(F.col("full_crcs").alias("crc"))
    full = full.select("id", "doc_tokens", "base", "full_before", F.posexplode(each).alias("k", "piece")).select(
        "id", (F.col("k").cast("long") * size).alias("start"), F.lit(size).cast("long").alias("length"), F.col("piece.crc").alias("ids_crc32"), "doc_tokens",
        (F.col("base") + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *([F.col("piece.ids").alias("ids")] if with_ids else []),
    )
    out += ["ids"] if with_ids else []
    return tails.select(*out).unionByName(full.select(*out))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences of pieces with ``ids``: ``sequence_id``, ``length``, ``ids`` and the lengths of the pieces, for block-diagonal masks.

    A sequence has at most ``size`` pieces, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), joined.alias("ids"), F.transform("p", lambda x: x["length"]).alias("pieces"))


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """One row: ``sequences``, ``tokens`` and ``padded``, the tokens that fill sequences up (none at a power of two)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.when(exact, 0).otherwise(size - F.col("used"))).alias("padded"))
