"""Suffix-array dedup: remove bytes that a document shares, 50 at a time, with an earlier one.

A byte goes if a ``MATCH``-byte string that covers it also starts in a document with a smaller id.

1. Equal texts: all but the first are covered whole and leave the rest of the work.
2. Windows of ``MATCH`` bytes are named by their minimiser, the least hash among their ``GRAM``-byte
   grams; equal windows have equal minimisers.  A run of windows with one minimiser is a piece of at
   most ``RUN`` windows, so pieces of one minimiser are all that has to meet.
3. Minimisers in two documents or more are found bucket by bucket from compact sorted lists, one per
   task and bucket, in which each (minimiser, piece) stands once: hot passages are combined first.
4. Where all pieces of a shared minimiser are the same bytes, the smallest id decides.  Otherwise the distinct
   pieces stand once each with their smallest id; windows whose hash stands alone are no one else's, and the runs of
   the others are laid out together and their suffixes sorted by Lyndon groups (``lyndon_sort``); neighbouring suffixes that agree on ``MATCH`` bytes are one class, and the
   smallest id of a class decides for its windows.
5. A minimiser with more than ``hot_pieces`` distinct pieces (a short line between ever other words) is cut first: the
   windows of its distinct pieces are counted by hash, those of one document alone fall away, and runs of windows with one
   smallest and one largest document are pieces of their own, grouped by minimiser and these two ids.  What is left of
   a shared line is the same bytes everywhere, so a group holds no more than one document's pieces.
6. Windows decided against a document are merged to intervals, and the rest of its bytes is kept.

The names of shared minimisers go to the tasks by broadcast up to ``max_bytes``.  Beyond it documents are dealt into
flushes of about ``flush_bytes``, every list carries its flush, and the task of a bucket answers each list with the kinds of
its entries; answers and documents of a flush meet, so a task never holds more names than its own documents have.

Pieces are told apart by hashes beside the minimiser; what suffixes share is compared byte by byte.

Defined results: null text is empty; texts shorter than ``MATCH`` bytes keep all; of equal texts the smallest id keeps its bytes; rows
that share an id never remove each other's bytes; a row without an id neither removes nor loses any; texts of any
length are taken whole; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, materialize
from .lyndon_sort import sort_strings

MATCH = 50
GRAM = 24
RUN = 240
_U = np.uint64
_KEY_BITS = _U(40)


# --- windows, minimisers, pieces --------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every ``size``-byte gram, built from grams of powers of two."""
    level = data.astype(_U) + _U(1)
    factor, width, out, have = np.array([0x9E3779B97F4A7C15 ^ (seed << 20) | 1], _U), 1, None, 0
    while True:
        if size & width:
            n = len(data) - have - width + 1
            out = level if out is None else out[:n] * factor + level[have : have + n]
            have += width
            if have == size:
                break
        n = len(level) - width
        level = (level[:n] * factor + level[width : width + n]) if n > 0 else level[:0]
        factor, width = factor * factor, width * 2
    out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9 + 2 * seed)
    return out ^ (out >> _U(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - have : width - have + n]) if have < width else out


def pieces(data: np.ndarray, lengths: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text number, start in data, number of windows) of texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return np.zeros(0, _U), none, none, none
    least = sliding_min(gram_hashes(data, GRAM, seed), MATCH - GRAM + 1)
    n, ends = len(least), np.cumsum(lengths)
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    for edge in (ends - lengths, ends - MATCH + 1):  # where texts start, and where windows begin to leave them
        cut[edge[(edge >= 0) & (edge < n)]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, n))
    if (size > RUN).any():
        parts = -(-size // RUN)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = np.repeat(start, parts) + within * RUN, np.minimum(RUN, np.repeat(size, parts) - within * RUN)
    text = np.searchsorted(ends, start, side="right")
    ok = start + MATCH <= ends[text]  # windows that lie in one text
    start, size, text = start[ok], size[ok], text[ok]
    return least[start], text, start, size


_POWERS: dict[int, np.ndarray] = {}


def piece_marks(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cheap hashes that tell the pieces of one minimiser apart, from running sums of byte times power."""
    n = len(data)
    if len(_POWERS.get(0, ())) < n + 1:
        base, inverse = np.array([0x9FB21C651E98DF25], _U), np.array([pow(0x9FB21C651E98DF25, -1, 1 << 64)], _U)
        for k, step in enumerate((base, inverse)):
            powers = np.full(n + 1, step[0], _U)
            powers[0] = 1
            _POWERS[k] = np.multiply.accumulate(powers)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _POWERS[0][:n], out=sums[1:])
    end = start + size + MATCH - 1
    out = (sums[end] - sums[start]) * _POWERS[1][start] + size.astype(_U)
    out = (out ^ (out >> _U(31))) * _U(0xFF51AFD7ED558CCD)
    return out ^ (out >> _U(33))


def piece_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    xx = xxhash.xxh64_intdigest
    return np.fromiter((xx(data[s : s + n + MATCH - 1]) for s, n in zip(start.tolist(), size.tolist())), _U, len(start))


def _texts(batches, bound: int = 1 << 20):
    """(ids, row keys, texts end to end, lengths) of groups of rows with about ``bound`` bytes."""
    ids, keys, texts, held = [], [], [], 0
    for pdf in batches:
        for i, k, t in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
            t = t.encode()
            if len(t) < MATCH:
                continue
            ids.append(i)
            keys.append(k)
            texts.append(t)
            held += len(t)
            if held >= bound:
                yield np.array(ids, np.int64), np.array(keys, np.int64), b"".join(texts), np.array([len(t) for t in texts])
                ids, keys, texts, held = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(keys, np.int64), b"".join(texts), np.array([len(t) for t in texts])


# --- which minimisers are shared -----------------------------------------------------------------


def _grouped(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order by key, then by the other columns; most keys stand alone, and only the rest is sorted again."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.flatnonzero(np.append(same, False) | np.append(False, same))
    rows = order[again]
    order[again] = rows[np.lexsort((*[t[rows] for t in reversed(then)], key[rows]))]
    return order


def _named(least: np.ndarray, buckets: int) -> np.ndarray:
    """Minimiser as bucket and 40 more bits: what the compact lists can carry.

    Minimisers are minima, so small values are more usual; one multiplication spreads them over the buckets.
    """
    least = least * _U(0xD6E8FEB86659FD93)
    return ((((least >> _U(40)) * _U(buckets)) >> _U(24)) << _KEY_BITS) | (least & _U((1 << 40) - 1))


def _pack(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _entries(store: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, piece) in order, and whether several documents have it, from (key, piece, document) arrays."""
    key, piece, doc = (np.concatenate(x) for x in zip(*store))
    order = _grouped(key, piece, doc)
    key, piece, doc = key[order], piece[order], doc[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(first[1:], len(key)) - 1
    return key[first], piece[first], doc[first] != doc[last]


def _pieces_of(batches, buckets: int):
    """(key, piece, document) of all pieces, for every group of texts."""
    for ids, _, data, lengths in _texts(batches):
        arr = np.frombuffer(data, np.uint8)
        least, text, start, size = pieces(arr, lengths)
        yield _named(least, buckets), piece_marks(arr, start, size), ids[text]


def _list_rows(store) -> pd.DataFrame:
    key, piece, many = _entries(store)
    bucket = (key >> _KEY_BITS).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = [
        (int(bucket[a]), _pack(key[a:b], 5), _pack(piece[a:b], 6), np.packbits(many[a:b]).tobytes())
        for a, b in zip(cut, np.append(cut[1:], len(key)))
    ]
    return pd.DataFrame(rows, columns=["bucket", "least", "piece", "many"])


def piece_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, least, piece, many): per task flush and bucket the distinct pairs, 5 + 6 bytes each,
    and a bit for pairs that several documents of the flush hold."""

    def run(batches):
        store, held = [], 0
        for some in _pieces_of(batches, buckets):
            store.append(some)
            held += len(some[0])
            if held > 400_000:
                yield _list_rows(store)
                store, held = [], 0
        if held:
            yield _list_rows(store)

    return docs.mapInPandas(run, "bucket int, least binary, piece binary, many binary")


def _kinds(pdf: pd.DataFrame, hot_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a bucket's lists one after another; its distinct keys; their kinds, -1 where only one document has them."""
    listed = np.concatenate([_unpack(x, 5) for x in pdf["least"]])
    piece = np.concatenate([_unpack(x, 6) for x in pdf["piece"]])
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x) // 5).astype(bool) for m, x in zip(pdf["many"], pdf["least"])])
    order = _grouped(listed, piece)
    key, piece, many = listed[order], piece[order], many[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    rows = np.diff(np.append(cut, len(key)))
    distinct = np.add.reduceat(np.append(True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])).astype(np.int64), cut)
    shared = (rows > 1) | np.logical_or.reduceat(many, cut)
    return listed, key[cut], np.where(shared, np.where(distinct == 1, 0, np.where(distinct <= hot_pieces, 1, 2)), -1)


def shared_minimisers(lists: DataFrame, hot_pieces: int) -> DataFrame:
    """(bucket, kind, keys): minimisers in two documents or more; kind 0 one piece, 1 several, 2 very many."""

    def run(pdf):
        bucket = int(pdf["bucket"].iloc[0])
        _, key, kind = _kinds(pdf, hot_pieces)
        full = (_U(bucket) << _KEY_BITS) | key
        out = [(bucket, k, full[kind == k].tobytes()) for k in (0, 1, 2)]
        return pd.DataFrame([r for r in out if r[2]], columns=["bucket", "kind", "keys"])

    return lists.groupBy("bucket").applyInPandas(run, "bucket int, kind int, keys binary")


def flush_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """As ``piece_lists``, one list per bucket and ``flush`` (a column of ``docs``)."""
    names = ["flush", "bucket", "least", "piece", "many"]

    def run(pdf):
        store = list(_pieces_of([pdf], buckets))
        if not sum(len(k) for k, _, _ in store):
            return pd.DataFrame({n: [] for n in names})
        return _list_rows(store).assign(flush=pdf["flush"].iloc[0])[names]

    return docs.groupBy("flush").applyInPandas(run, "flush long, bucket int, least binary, piece binary, many binary")


def answers(lists: DataFrame, hot_pieces: int) -> DataFrame:
    """(flush, bucket, kinds): for every list that has shared minimisers the kind of each entry, a byte each."""

    def run(pdf):
        listed, key, kind = _kinds(pdf, hot_pieces)
        each = kind[np.searchsorted(key, listed)].astype(np.int8)
        ends = np.cumsum([len(x) // 5 for x in pdf["least"]])
        out = [(f, b, part.tobytes()) for f, b, part in zip(pdf["flush"], pdf["bucket"], np.split(each, ends[:-1])) if (part >= 0).any()]
        return pd.DataFrame(out, columns=["flush", "bucket", "kinds"])

    return lists.groupBy("bucket").applyInPandas(run, "flush long, bucket int, kinds binary")


# --- occurrences of shared pieces -------------------------------------------------------------------

_FOUND = "least long, piece long, kind int, doc_id long, row long, start int, windows int, content binary"


def _rows_of(ids: np.ndarray, keys: np.ndarray, data: bytes, lengths: np.ndarray, buckets: int, kinds_of) -> pd.DataFrame:
    """Pieces of a group of texts whose minimiser is shared.  ``content`` comes once per group, where pieces differ."""
    arr = np.frombuffer(data, np.uint8)
    least, text, start, size = pieces(arr, lengths)
    name = _named(least, buckets)
    kind = kinds_of(name)
    on = kind >= 0
    name, text, start, size, kind = name[on], text[on], start[on], size[on], kind[on]
    several = kind > 0
    piece = np.zeros(len(name), _U)
    piece[several] = piece_hashes(data, start[several], size[several]) | _U(1)
    content = np.full(len(name), None, object)
    where = np.flatnonzero(several)
    where = where[_grouped(name[where], piece[where])]
    one = np.ones(len(where), bool)
    one[1:] = (name[where][1:] != name[where][:-1]) | (piece[where][1:] != piece[where][:-1])
    for w in where[one].tolist():
        content[w] = data[start[w] : start[w] + size[w] + MATCH - 1]
    base = np.cumsum(lengths) - lengths
    return pd.DataFrame(
        {
            "least": name.view(np.int64), "piece": piece.view(np.int64), "kind": kind.astype(np.int32), "doc_id": ids[text], "row": keys[text],
            "start": (start - base[text]).astype(np.int32), "windows": size.astype(np.int32), "content": content,
        }
    )


def _lookup(known: np.ndarray, kind: np.ndarray):
    """Function from minimiser names to kinds, -1 where they are not among the sorted ``known``."""

    def of(name):
        if not len(known):
            return np.full(len(name), -1)
        order = np.argsort(name)  # sorted needles walk the table instead of jumping through it
        at = np.empty(len(name), np.int64)
        at[order] = np.minimum(np.searchsorted(known, name[order]), len(known) - 1)
        return np.where(known[at] == name, kind[at], -1)

    return of


def occurrences(docs: DataFrame, buckets: int, hot_pieces: int, total: int, max_bytes: int = 64 << 20, flush_bytes: int = 4 << 20) -> DataFrame:
    """Shared pieces of all documents.  Names of minimisers go to tasks by broadcast where their size is bounded, else by flush."""
    shared = materialize(shared_minimisers(piece_lists(docs, buckets), hot_pieces))
    if shared.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] > max_bytes:
        return _by_flush(docs, buckets, hot_pieces, max(1, -(-total // flush_bytes)))
    rows = shared.collect()
    keys = [np.frombuffer(r.keys, _U) for r in rows]
    kinds = np.repeat(np.array([r.kind for r in rows], np.int8), [len(k) for k in keys])
    keys = np.concatenate(keys) if keys else np.zeros(0, _U)
    order = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], kinds[order]))

    def run(batches):
        kinds_of = _lookup(*sent.value)
        for group in _texts(batches):
            yield _rows_of(*group, buckets, kinds_of)

    return docs.mapInPandas(run, _FOUND)


def _by_flush(docs: DataFrame, buckets: int, hot_pieces: int, flushes: int) -> DataFrame:
    docs = docs.withColumn("flush", F.pmod(F.xxhash64("doc_id", "row"), F.lit(flushes)))
    back = materialize(answers(flush_lists(docs, buckets), hot_pieces))

    def run(texts, answered):
        if len(texts) and len(answered):
            key = _entries(list(_pieces_of([texts], buckets)))[0]
            bucket = (key >> _KEY_BITS).astype(np.int64)
            known, kinds = [], []
            for b, kind in zip(answered["bucket"], answered["kinds"]):
                known.append(key[np.searchsorted(bucket, b, "left") : np.searchsorted(bucket, b, "right")])
                kinds.append(np.frombuffer(kind, np.int8))
            order = np.argsort(known := np.concatenate(known), kind="stable")
            kinds = np.concatenate(kinds)[order]
            kinds_of = _lookup(known[order], kinds)  # entries of one key have one kind
            parts = [_rows_of(*group, buckets, kinds_of) for group in _texts([texts])]
            return pd.concat(parts, ignore_index=True)
        return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})

    return docs.groupBy("flush").cogroup(back.groupBy("flush")).applyInPandas(run, _FOUND)


def _ranges_of(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


# --- which windows of a piece an earlier document has -------------------------------------------------


def decide(contents: list[bytes], ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id with the same window, for all windows of all pieces; windows of each piece) of pieces in order of their groups.

    Equal windows have equal hashes, so a window whose hash stands alone keeps its own id.  The runs of the others are laid out once each,
    with a separator below all bytes, and those of a group with several runs are sorted as one string.
    """
    blob, length = b"".join(contents), np.array([len(c) for c in contents])
    windows, first = length - MATCH + 1, np.cumsum(length) - length
    at = _ranges_of(first, windows)
    piece = np.repeat(np.arange(len(contents)), windows)
    owner = ids[piece]
    name = gram_hashes(np.frombuffer(blob, np.uint8), MATCH, 2)[at]
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    again = np.empty(len(at), bool)
    again[order] = np.append(same, False) | np.append(False, same)
    on = again[1:] & again[:-1] & (piece[1:] == piece[:-1])  # a run goes on
    start, end = np.flatnonzero(again & ~np.append(False, on)), np.flatnonzero(again & ~np.append(on, False)) + 1
    if not len(start):
        return owner, windows
    size, run_group, run_id = end - start, group[piece[start]], ids[piece[start]]
    known: dict[tuple[int, bytes], int] = {}
    run = np.array([known.setdefault((g, blob[s : s + n + MATCH - 1]), len(known)) for g, s, n in zip(run_group.tolist(), at[start].tolist(), size.tolist())])
    runs = [x for _, x in known]
    least = np.full(len(runs), np.iinfo(np.int64).max)
    np.minimum.at(least, run, run_id)
    of_group = np.array([g for g, _ in known])
    long = np.array([len(x) + 1 for x in runs])
    line = np.frombuffer(b"\0".join([*runs, b""]), np.uint8).astype(np.int64) + 1
    begin = np.cumsum(long) - long
    line[begin + long - 1] = 0
    doc_at = np.repeat(least, long)
    edge = np.flatnonzero(np.append(True, of_group[1:] != of_group[:-1]))
    several = np.repeat(np.diff(np.append(edge, len(runs))) > 1, np.diff(np.append(edge, len(runs))))
    if several.any():
        _least_of_equal(line, begin, long, several, of_group, doc_at)
    owner[_ranges_of(start, size)] = doc_at[_ranges_of(begin[run], size)]
    return owner, windows


def _least_of_equal(line: np.ndarray, begin: np.ndarray, long: np.ndarray, several: np.ndarray, of_group: np.ndarray, doc_at: np.ndarray) -> None:
    """Give equal windows of the runs marked ``several`` their smallest id: neighbours in the suffix order of a group that agree on ``MATCH`` bytes."""
    keep = np.repeat(several, long)
    place = np.flatnonzero(keep)
    part, sizes, of_group = line[keep], long[several], of_group[several]
    lengths = np.add.reduceat(sizes, np.flatnonzero(np.append(True, of_group[1:] != of_group[:-1])))
    order = sort_strings(part, lengths)
    valid = np.zeros(len(part), bool)
    valid[_ranges_of(np.cumsum(sizes) - sizes, sizes - MATCH)] = True
    order = order[valid[order]]  # suffixes that start a window
    group = np.repeat(np.arange(len(lengths)), lengths)
    view = np.lib.stride_tricks.sliding_window_view(part.astype(np.uint16), MATCH)
    new = np.ones(len(order), bool)
    for a in range(0, len(order) - 1, 1 << 16):
        b = min(len(order) - 1, a + (1 << 16))
        x, y = order[a:b], order[a + 1 : b + 1]
        new[a + 1 : b + 1] = (group[x] != group[y]) | (view[x] != view[y]).any(axis=1)
    cut = np.flatnonzero(new)
    at = place[order]
    doc_at[at] = np.repeat(np.minimum.reduceat(doc_at[at], cut), np.diff(np.append(cut, len(order))))


_DECIDED = "least long, piece long, offset array<int>, count array<int>, owner array<long>"


def decided_pieces(distinct: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Windows of distinct pieces (least, piece, content, doc_id) and the smallest id that has each."""
    rows = distinct.select("least", "piece", "content", "doc_id").repartition("least").sortWithinPartitions("least", "piece")

    def run(batches):
        import pyarrow as pa

        def solve(least, piece, doc, content):
            owner, windows = decide(content, doc, least)
            first = np.cumsum(windows) - windows
            new = np.append(True, owner[1:] != owner[:-1])
            new[first] = True
            cut = np.flatnonzero(new)
            offset = cut - np.repeat(first, np.add.reduceat(new.astype(np.int64), first))
            ends = pa.array(np.append(np.searchsorted(cut, first), len(cut)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (offset.astype(np.int32), np.diff(np.append(cut, len(owner))).astype(np.int32), owner[cut])]
            return pa.RecordBatch.from_arrays([pa.array(least), pa.array(piece), *listed], ["least", "piece", "offset", "count", "owner"])

        held, waiting = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.column("content").nbytes
            if held >= block:
                table = pa.Table.from_batches(waiting)
                last = int(np.searchsorted(table["least"].to_numpy(), table["least"][-1].as_py()))  # the last group may go on
                if last:
                    yield solve(*_columns(table.slice(0, last)))
                waiting = table.slice(last).to_batches()
                held = sum(b.column("content").nbytes for b in waiting) if last else 0
        if waiting:
            yield solve(*_columns(pa.Table.from_batches(waiting)))

    return rows.mapInArrow(run, _DECIDED)


def _columns(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    return (*(table[c].to_numpy() for c in ("least", "piece", "doc_id")), table["content"].to_pylist())


def decide_hot(sums: DataFrame) -> DataFrame:
    """As ``decided_pieces``, for distinct pieces (least, piece, content, owner, last) of hot minimisers."""

    def windows_of(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            size = np.array([len(c) for c in pdf["content"]]) - MATCH + 1
            data = np.frombuffer(b"".join(bytes(c) for c in pdf["content"]), np.uint8)
            first = np.cumsum(size + MATCH - 1) - (size + MATCH - 1)
            at = _ranges_of(first, size)
            yield pd.DataFrame(
                {
                    "w": gram_hashes(data, MATCH, 2)[at].view(np.int64), "off": (at - np.repeat(first, size)).astype(np.int32),
                    **{c: np.repeat(pdf[c].to_numpy(), size) for c in ("least", "piece", "owner", "last")},
                }
            )

    windows = materialize(sums.select("least", "piece", "content", "owner", "last").mapInPandas(windows_of, "w long, off int, least long, piece long, owner long, last long"))
    both = windows.groupBy("w").agg(F.min("owner").alias("a"), F.max("last").alias("b")).where("a < b")
    # at most RUN windows a piece
    marked = windows.join(_small(both, 40), "w").groupBy("least", "piece").agg(F.collect_list(F.struct("off", "a", "b")).alias("seen"))

    def runs_of(batches):
        for pdf in batches:
            out = []
            for least, piece, owner, content, seen in zip(pdf["least"], pdf["piece"], pdf["owner"], pdf["content"], pdf["seen"]):
                seen = sorted((r["off"], r["a"], r["b"]) for r in seen)
                begin = 0
                for k in range(1, len(seen) + 1):
                    if k == len(seen) or seen[k] != (seen[k - 1][0] + 1, *seen[begin][1:]):
                        off, a, b = seen[begin]
                        part = bytes(content[off : off + k - begin + MATCH - 1])
                        group = xxhash.xxh64_intdigest(f"{least},{a},{b}") - (1 << 63)
                        out.append((least, piece, off, group, xxhash.xxh64_intdigest(part) - (1 << 63), owner, part))
                        begin = k
            yield pd.DataFrame(out, columns=["least", "piece", "off", "group", "part", "owner", "content"])

    runs = marked.join(sums.select("least", "piece", "owner", "content"), ["least", "piece"]).mapInPandas(
        runs_of, "least long, piece long, off int, group long, part long, owner long, content binary"
    )
    runs = materialize(runs)
    distinct = runs.groupBy(F.col("group").alias("least"), F.col("part").alias("piece")).agg(F.min("owner").alias("doc_id"), F.first("content").alias("content"))
    found = decided_pieces(distinct).select(F.col("least").alias("group"), F.col("piece").alias("part"), F.arrays_zip("offset", "count", "owner").alias("z"))
    back = runs.select("least", "piece", "off", "group", "part").join(found, ["group", "part"])
    moved = F.transform("z", lambda r: F.struct((r["offset"] + F.col("off")).alias("offset"), r["count"].alias("count"), r["owner"].alias("owner")))
    z = back.groupBy("least", "piece").agg(F.flatten(F.collect_list(moved)).alias("z"))
    return z.select("least", "piece", "z.offset", "z.count", "z.owner")


HOT_PIECES = 1000  # pieces whose verdicts are broadcast at most


def removals(found: DataFrame) -> DataFrame:
    """(doc_id, row, cuts): maximal intervals [start, end) of each document that an earlier one has, as int32 pairs."""
    sums = found.groupBy("least", "piece").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.first("content", ignorenulls=True).alias("content"), F.max("windows").alias("windows"),
        F.max("kind").alias("kind"), F.count(F.lit(1)).alias("asked"),
    )
    sums = materialize(sums)
    plain = sums.where("kind = 0 and owner < last").select(
        "least", "piece", F.array(F.lit(0)).alias("offset"), F.array("windows").alias("count"), F.array("owner").alias("owner")
    )
    verdict = plain.unionByName(decided_pieces(sums.where("kind = 1").select("least", "piece", "content", F.col("owner").alias("doc_id"))))
    if sums.where("kind = 2").limit(1).count():
        verdict = verdict.unionByName(materialize(decide_hot(sums.where("kind = 2"))))
    # pieces of a passage that very many documents have are few: their verdicts go to where the occurrences lie
    total = sums.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    often = F.broadcast(sums.where(F.col("asked") >= max(2, -(-total // HOT_PIECES))).select("least", "piece", "asked"))
    verdict = materialize(verdict.join(often, ["least", "piece"], "left").withColumn("asked", F.coalesce("asked", F.lit(0).cast("long"))))
    hits = look_up(found.select("least", "piece", "doc_id", "row", "start"), verdict, ["least", "piece"], total, "asked", HOT_PIECES).where("offset is not null")
    # windows that an earlier document has, as intervals of bytes
    cuts = F.filter(F.arrays_zip("offset", "count", "owner"), lambda r: r["owner"] < F.col("doc_id"))
    spans = F.transform(cuts, lambda r: F.struct((F.col("start") + r["offset"]).alias("a"), (F.col("start") + r["offset"] + r["count"] + (MATCH - 1)).alias("b")))
    rows = hits.select("doc_id", "row", spans.alias("cuts")).where(F.size("cuts") > 0)
    # at most a document's length; a and b as one number, so that a list is flat
    rows = rows.select("doc_id", "row", F.transform("cuts", lambda c: F.shiftleft(c["a"].cast("long"), 32) + c["b"]).alias("cuts"))
    rows = rows.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(cuts=[merge(np.asarray(c, np.int64)).tobytes() for c in pdf["cuts"]])

    return rows.mapInPandas(run, "doc_id long, row long, cuts binary")


def merge(cuts: np.ndarray) -> np.ndarray:
    """Maximal intervals (a, b), one after another, from numbers a << 32 | b."""
    cuts = np.sort(cuts)
    start, end = cuts >> 32, np.maximum.accumulate(cuts & 0xFFFFFFFF)
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return np.stack([start[first], end[np.append(first[1:], len(cuts)) - 1]], axis=1).astype(np.int32)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot_pieces: int = 300, bucket_bytes: int = 8 << 20, max_bytes: int = 64 << 20, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if wanted."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("row"), F.octet_length("text").cast("long").alias("n"))
    marked = materialize(marked)
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(min(1 << 22, max(16, -(-total // bucket_bytes))))
    ids, rows = marked.where("doc_id is not null").agg(F.countDistinct("doc_id"), F.count("doc_id")).first()
    # a row's key beside its id: nothing where ids are unique, else its text
    docs = docs.withColumn("row", F.xxhash64("text") if ids < rows else F.lit(0).cast("long"))
    if ids == rows:
        marked = marked.withColumn("row", F.lit(0).cast("long"))
    groups = marked.where(f"n >= {MATCH} and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # rows of a hot text stay where they are: its digest comes to them
    groups = _small(materialize(groups.where("first < last").select("sha", "first")), 100)
    copies = marked.join(groups, "sha").where("doc_id > first").select("doc_id", "row").distinct()
    copies = materialize(copies)
    rest = docs.where("doc_id is not null").join(_small(copies, 48), ["doc_id", "row"], "left_anti")
    found = materialize(occurrences(rest, buckets, hot_pieces, total, max_bytes))
    return _finish(docs, materialize(removals(found)), copies, with_text)


def _small(table: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    n = max_bytes // row_bytes
    return F.broadcast(table) if table.limit(n + 1).count() <= n else table


def _finish(docs: DataFrame, cuts: DataFrame, copies: DataFrame, with_text: bool) -> DataFrame:
    size = cuts.agg(F.coalesce(F.sum(F.octet_length("cuts") + 64), F.lit(0))).first()[0]
    cuts = F.broadcast(cuts) if size <= 32 << 20 else cuts
    rows = docs.join(cuts, ["doc_id", "row"], "left").join(_small(copies.withColumn("copy", F.lit(True)), 48), ["doc_id", "row"], "left")
    # ids go round pandas as text: it would make floats of longs beside a missing one
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches):
        for pdf in batches:
            out = []
            for doc, text, spans, copy in zip(pdf["doc_id"], pdf["text"], pdf["cuts"], pdf["copy"]):
                data = text.encode()
                if copy is True or copy == True:  # noqa: E712  pandas may hand over a numpy bool
                    merged = [(0, len(data))]
                else:
                    merged = np.frombuffer(spans, np.int32).reshape(-1, 2).tolist() if spans is not None else []
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)[: 6 if with_text else 5])
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    done = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "cuts", "copy").mapInPandas(run, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
