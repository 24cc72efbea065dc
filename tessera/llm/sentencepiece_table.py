"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a whitespace marker after another character, merges
never cross the start of a marked word, so a text's ids are the ids of its marked words
("chunks": a run of markers and what follows up to the next marker) one after another.
Every task keeps a table of the distinct chunks it has met, segments each of them once
with the library, and joins ids and decoded text back by position.  The table belongs
to the task and has two halves: when the younger has ``max_chunks / 2`` entries it takes the place of the older, whose chunks are forgotten
but for those met since (results do not change).  Chunks of more than ``max_chunk_chars`` characters (text without spaces) are segmented where they stand and never enter it, so its memory is
bounded, nothing is shuffled or broadcast, and a lost task is simply redone.

Defined results: null text counts as empty; empty text has no ids and decodes to "";
markers written in the text itself (U+2581) are markers, as in the library; texts of any
length are taken whole; each row is handled by itself, so ties, repeated rows and rows without an id keep
their rows; the result has the id and its own columns only, and other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]*")


def model_proto(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def chunkable(processor) -> bool:
    """True where no piece crosses the start of a marked word."""
    return not any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


class ChunkTable:
    """Distinct chunk -> (ids as text, number of ids, decoded text)."""

    def __init__(self, model_path: str, max_chunks: int = 150_000, max_chunk_chars: int = 256):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if not chunkable(self.processor):
            raise ValueError("pieces of this model cross whitespace markers; its texts cannot be cut into chunks")
        self.max_chunks, self.max_chunk_chars = max_chunks, max_chunk_chars
        self.table: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.names = [str(i) for i in range(self.processor.get_piece_size())]
        # A letter before the chunk takes the place of the marker that the library puts before
        # a text; it may not merge with a marker, so its own ids can be cut off again.
        self.head = self.processor.encode("a")

    def _segment(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        n, head, names = len(self.head), self.head, self.names
        encoded = self.processor.encode(["a" + c for c in chunks], num_threads=1)
        assert all([ids[:n] == head for ids in encoded])
        decoded = self.processor.decode(encoded, num_threads=1)  # one call, which costs less than half of one a chunk
        return [(",".join([names[i] for i in ids[n:]]), len(ids) - n, back[1:]) for ids, back in zip(encoded, decoded)]

    def _first(self, chunk: str) -> tuple[str, int, str]:
        """A text's first chunk as it stands, where it takes the library's own marker."""
        ids = self.processor.encode(chunk)
        return ",".join(map(str, ids)), len(ids), self.processor.decode(ids)

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, number of ids, decoded text) of one whole text."""
        if not text:
            return "", 0, ""
        marked = self._chunks(text)
        first = self._first(marked[0])
        rest = marked[1:]
        if not rest:
            return first
        known = self._known(dict.fromkeys(rest))
        ids, counts, decoded = zip(*[known[c] for c in rest])
        return ",".join([first[0], *ids]), first[1] + sum(counts), "".join([first[2], *decoded])

    def _known(self, chunks: dict[str, None]) -> dict[str, tuple[str, int, str]]:
        """A table that has all of a text's distinct chunks."""
        missing = [c for c in chunks if c not in self.table]
        if not missing:
            return self.table
        long = [c for c in missing if len(c) > self.max_chunk_chars]
        missing = [c for c in missing if len(c) <= self.max_chunk_chars]
        if self.table and len(self.table) + len(missing) > self.max_chunks // 2:
            self.older, self.table = self.table, {}
            missing = [c for c in chunks if len(c) <= self.max_chunk_chars]
        older = self.older
        new = [c for c in missing if c not in older]
        self.table.update([(c, older[c]) for c in missing if c in older])
        if new:
            self.table.update(zip(new, self._segment(new)))
        return self.table | dict(zip(long, self._segment(long))) if long else self.table

    @staticmethod
    def _chunks(text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        if MARK + MARK not in marked:
            first, *rest = marked.split(MARK)
            if first or not rest:
                return [first, *[MARK + r for r in rest]]
            # a marker first: the library adds its own before it, so both belong together
            return [MARK + rest[0], *[MARK + r for r in rest[1:]]]
        return [c for c in _CHUNK.findall(marked) if c]


def encode_documents(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    max_chunks: int = 150_000,
) -> DataFrame:
    """Return id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``ids`` and ``decoded``.

    ``model_path`` must be readable on every executor (it comes with the installed package).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [
        T.StructField(id_col, rows.schema["id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path, max_chunks)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n, ids_sha, dec_sha, ids, decoded = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    joined, count, back = table.encode(text)
                    n.append(count)
                    ids_sha.append(sha(joined))
                    dec_sha.append(sha(back))
                    if with_ids:
                        ids.append([int(x) for x in joined.split(",")] if joined else [])
                        decoded.append(back)
                columns: Sequence[pa.Array] = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
                if with_ids:
                    columns = [*columns, pa.array(ids, pa.list_(pa.field("element", pa.int32(), False))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(run, schema)
