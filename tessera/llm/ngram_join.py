"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words by ASCII white
space; fewer words: the whole sequence as one).  Two documents link when their sets' Jaccard
similarity is 0.8 or more.  No link between different texts is lost:

1. Equal sets are one row from here on.
2. A first pass ties obvious groups together: rows that agree on pairs of min-hashes meet in small
   salted buckets, where each is compared with a few leaders.  Only true links come out, one per
   row, however large a group of near copies is.
3. The exact pass looks for links between the components so found.  Shingles are ordered by rising
   frequency (from a fixed-size counting sketch over all documents; any common order is correct).  With n
   shingles, a link needs ``need = ceil(0.8 n)`` common ones, so two linked sets share at least l
   among the first ``n - need + l`` of each.  Every document picks its l from 1 to ``max_match``: the
   prefix grows while the estimated cost of its postings and of the candidates that could
   still match l times falls.  A pair is a candidate when it shares k = min(l, l') shingles among the
   first ``n - common + k`` of either, where ``common`` is what a link of these two sizes must share; the pair is made where this
   holds for one shingle, so that what many documents share further back makes none.
   Shingles whose documents all lie in one component produce nothing; before pairs are made, rounds
   tie components together over one hub per shingle, linear in the postings, as long as a round ties one in ``TIED`` of the
   pairs that it tries (a hub that links to few of its shingle's components says that the others will not link either).
4. Candidates are verified on their whole sets: the set of the end with more pairs is built once for each 120 of them, so
   a hub's pairs are many small pieces of work; links of both passes give the components.

Defined results: null or white-space text has an empty set, links with nothing and is its own
component; equal texts, ties and repeated rows link; texts of any length are taken whole; where ids repeat or are missing every row
is a document of its own, and its component's name is the smallest id in it, null where none has an id; other columns, whatever their
names, are not read; an empty table gives an empty result.  Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, materialize
from .components import components

WORDS = 5
NUM, DEN = 80, 100  # link when DEN * intersection >= NUM * union
TIED = 20
SKETCH = 1 << 19
CHUNK = 1 << 14
_U = np.uint64
#: Odd multipliers for the places of a shingle, unrelated to each other (else permuted words could collide).
_PLACE = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(WORDS)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle(text: str | None) -> np.ndarray:
    """Whole text -> sorted array of distinct 64-bit shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += h[i : n + i] * _PLACE[i]
    out = mix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """DEN * |a & b| >= NUM * |a | b| for sorted distinct arrays."""
    if not len(a) or not len(b) or DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # two sorted runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def need(n: int) -> int:
    """Fewest common shingles of a set of n with any set it links to."""
    return -(-NUM * n // DEN)


# --- pass 1: sizes, digests, min-hash keys, frequency sketch ---------------------------------

_SEEDS = [_U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0), _U(0x082EFA98EC4E6C89)]
_PROFILE = "doc_id long, n long, d1 long, d2 long, k1 long, k2 long, part int, chunk int, counts binary"


def profile(docs: DataFrame) -> DataFrame:
    """Rows of documents (chunk null) and, once per task, of its part of the sketch (doc_id null)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        counts, pending, held = np.zeros(SKETCH, np.int64), [], 0
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle(text)
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, 0, 0))
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                low = [int(mix(s ^ seed).min()) for seed in _SEEDS]
                keys = np.frombuffer(xxhash.xxh3_64_digest(f"a{low[0]},{low[1]}") + xxhash.xxh3_64_digest(f"b{low[2]},{low[3]}"), np.int64)
                rows.append((doc_id, len(s), int(digest[0]), int(digest[1]), int(keys[0]), int(keys[1])))
                pending.append((s >> _U(45)).astype(np.int64))
                held += len(s)
                if held > 500_000:
                    counts += np.bincount(np.concatenate(pending), minlength=SKETCH)
                    pending, held = [], 0
            out = pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "k1", "k2"])
            yield out.assign(part=pd.array([None] * len(out), "Int32"), chunk=pd.array([None] * len(out), "Int32"), counts=None)
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=SKETCH)
        for c in range(SKETCH // CHUNK):
            some = counts[c * CHUNK : (c + 1) * CHUNK]
            if some.any():
                none = pd.array([None], "Int64")
                yield pd.DataFrame(
                    {"doc_id": none, "n": none, "d1": none, "d2": none, "k1": none, "k2": none, "part": [part], "chunk": [c], "counts": [some.astype(np.uint32).tobytes()]}
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, _PROFILE)


def frequency_classes(parts: DataFrame) -> np.ndarray:
    """One byte per sketch cell: the rising class of its count.  Parts are added in a tree of fan-in 64."""

    def add(pdf):
        total = np.zeros(CHUNK, np.uint64)
        for counts in pdf["counts"]:
            total += np.frombuffer(counts, np.uint32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // 64], "chunk": [pdf["chunk"].iloc[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    rows = parts.where("chunk is not null").select("part", "chunk", "counts")
    most = rows.agg(F.max("part")).first()[0] or 0
    while True:
        rows = rows.groupBy((F.col("part") / 64).cast("int"), "chunk").applyInPandas(add, "part int, chunk int, counts binary")
        most //= 64
        if not most:
            break
        rows = materialize(rows)
    out = np.zeros(SKETCH)
    for r in rows.collect():  # SKETCH counters in all, whatever the input
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.uint32)
    return np.minimum(255, np.round(8 * np.log2(1.0 + out))).astype(np.uint8)


# --- pass 2: leaders -------------------------------------------------------------------------


def _joinable(table: DataFrame, row_bytes: int = 40, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a table where its size (counted, ``row_bytes`` a row) is bounded; else a shuffle join."""
    return F.broadcast(table) if table.limit(max_bytes // row_bytes + 1).count() <= max_bytes // row_bytes else table


def leader_links(docs: DataFrame, reps: DataFrame, bucket_rows: int = 500, leaders: int = 32) -> DataFrame:
    """True links (u, v) among ``reps`` (rep, n, k1, k2) whose min-hash keys agree.

    Rows of a key are dealt into buckets of about ``bucket_rows``; the smallest row of each bucket is dealt again with its like, level by
    level, until a key has one bucket, so buckets of a hot key come together without meeting in one task.
    """
    keys = reps.where("n > 0").select("rep", F.explode(F.array("k1", "k2")).alias("k"))
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows, level, now = None, 0, keys.join(shared, "k")
    while True:
        salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / bucket_rows)) + F.lit(level << 32)
        now = materialize(now.withColumn("salt", salt))
        rows = now.select("k", "salt", "rep") if rows is None else rows.unionByName(now.select("k", "salt", "rep"))
        hot = now.where(F.col("c") > bucket_rows)
        if hot.limit(1).count() == 0:
            break
        heads = materialize(hot.groupBy("k", "salt").agg(F.min("rep").alias("rep")).drop("salt"))
        now, level = heads.join(heads.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "k"), level + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    wanted = rows.groupBy("rep").agg(F.collect_set(F.struct("k", "salt")).alias("at"))  # two for each level
    met = texts.join(_joinable(wanted, 240), "rep").select("rep", "text", F.explode("at").alias("at")).select("rep", "text", "at.k", "at.salt")
    met = met.repartition("k", "salt").sortWithinPartitions("k", "salt", "rep")

    def run(batches):
        here, heads, root = None, [], []
        for pdf in batches:
            out = []
            for k, salt, rep, text in zip(pdf["k"], pdf["salt"], pdf["rep"], pdf["text"]):
                if (k, salt) != here:
                    here, heads, root = (k, salt), [], []
                s, tied = shingle(text), set()
                for i, (head, t) in enumerate(heads):
                    # leaders that are tied to each other already count once
                    if root[i] not in tied and (head == rep or similar(s, t)):
                        tied.add(root[i])
                        if head != rep:
                            out.append((rep, head))
                if not tied and len(heads) < leaders:
                    root.append(len(heads))
                    heads.append((rep, s))
                elif len(tied) > 1:
                    first = min(tied)
                    root = [first if r in tied else r for r in root]
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return met.mapInPandas(run, "u long, v long")


# --- pass 3: adaptive prefixes ---------------------------------------------------------------


def choose_match(order_cost: np.ndarray, n: int, max_match: int) -> int:
    """l with the least estimated cost, from the expected postings of the ordered shingles."""
    first = n - need(n) + 1
    top = min(max_match, need(n))
    postings = np.cumsum(order_cost[: first + top - 1])[first - 1 :]
    match = np.arange(1, len(postings) + 1)
    # scanning a posting counts 1, a candidate (at most postings / l can match l times) a part of its set
    return int(np.argmin(postings + postings / match * (4 + n / 16) + 4 * match)) + 1


def prefixes(docs: DataFrame, members: DataFrame, classes: np.ndarray, max_match: int) -> DataFrame:
    """(token, rep, comp, n, l, at): the prefix of every representative, ``at`` counting its tokens from 0.

    ``members`` has (doc_id, rep, comp) of the documents that are not a representative alone in its component.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # SKETCH bytes

    def run(batches):
        cls = sent.value
        load = np.exp2(np.arange(256) / 8.0) - 1.0
        floor = np.median(load[cls])  # what chance puts into a cell
        for pdf in batches:
            tokens, reps, comps, sizes, matches, places = [], [], [], [], [], []
            for rep, comp, text in zip(pdf["doc_id"], pdf["comp"], pdf["text"]):
                s = shingle(text)
                n = len(s)
                if not n:
                    continue
                c = cls[(s >> _U(45)).astype(np.int64)]
                order = np.argsort(c, kind="stable")  # s is sorted, so ties go by hash
                cost = np.maximum(load[c[order]] - floor, 0.0) + 0.01
                match = choose_match(cost, n, max_match)
                take = s[order[: n - need(n) + match]]
                tokens.append(take.view(np.int64))
                for column, value in ((reps, rep), (comps, comp), (sizes, n), (matches, match)):
                    column.append(np.full(len(take), value, np.int64))
                places.append(np.arange(len(take)))
            if tokens:
                columns = (("token", tokens), ("rep", reps), ("comp", comps), ("n", sizes), ("l", matches), ("at", places))
                yield pd.DataFrame({k: np.concatenate(v) for k, v in columns}).astype({"n": "int32", "l": "int32", "at": "int32"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(_joinable(members), "doc_id", "left").where("rep is null or rep = doc_id")
    rows = rows.select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), "text")
    return rows.mapInPandas(run, "token long, rep long, comp long, n int, l int, at int")


def across(rows: DataFrame) -> DataFrame:
    """Rows of shingles whose documents lie in more than one component; most shingles do not, and their rows stay where they are."""
    wide = materialize(rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token"))
    return rows.join(_joinable(wide, 32), "token", "left_semi")


def hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b, ca, cb): of every shingle one document of each component with one common hub; linear in the rows."""
    key = F.xxhash64(F.lit(turn), "rep")
    one = rows.groupBy("token", "comp").agg(F.min(F.struct(key.alias("h"), "rep", "n")).alias("r"))
    hub = one.groupBy("token").agg(F.min(F.struct("r.h", "r.rep", "r.n", "comp")).alias("hub"))
    met = one.join(hub, "token").where(f"comp <> hub.comp and {DEN} * least(r.n, hub.n) >= {NUM} * greatest(r.n, hub.n)")
    return met.select(
        F.least("r.rep", "hub.rep").alias("a"), F.greatest("r.rep", "hub.rep").alias("b"), F.col("comp").alias("ca"), F.col("hub.comp").alias("cb")
    ).dropDuplicates(["a", "b"])


def meetings(rows: DataFrame, carried: int = 64) -> DataFrame:
    """(a, b) of different components that share enough of the shingles that ``prefixes`` gave them, most pairs once.

    The first shingle that a link of two sets has in common lies among the first ``n - common + 1`` of either, where ``common`` is
    what a link of these sizes must share; a pair is made there only, whatever else its ends share.  Against a set that is not
    smaller this is a ninth of the shingles, against a smaller one a fifth.  A row carries its document's first ``carried`` shared shingles:
    a pair is left out where an earlier one of both is common, and, where both ends carry all of theirs, if fewer than it needs are common.
    Keys are 32 bits of the shingles on either side; a document of which two shingles have one key carries no list, and of common
    keys one has no other before it on both sides, so a collision can add a candidate and never hides one.
    """
    flat = rows.select("rep", "comp", "n", "l", "at", F.hash("token").alias("key"))
    lists = flat.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("p"))
    lists = lists.select("rep", (F.size("p") <= carried).alias("all"), F.slice("p", 1, carried).alias("p"))
    lists = lists.select("rep", "all", F.col("p.key").alias("keys"), F.col("p.at").alias("ats")).where(F.size(F.array_distinct("keys")) == F.size("keys"))
    flat = flat.where(f"at <= n - cast(ceil({NUM} * cast(n as bigint) / {DEN}) as int)").join(lists, "rep", "left").withColumn("i", F.expr("size(filter(ats, x -> x < at))"))
    a, b = (flat.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "n", "l", "at", "all", "keys", "ats", "i")]) for s in "ab")
    a = a.where(f"at_a <= n_a - cast(ceil({2 * NUM} * cast(n_a as bigint) / {NUM + DEN}) as int)")  # b has as many shingles or more
    # for two given sizes the prefixes are shorter: what a link of these sizes has in common is known
    common, want = f"cast(ceil({NUM} * cast(n_a + n_b as bigint) / {NUM + DEN}) as int)", "least(l_a, l_b)"
    inside = {s: f"n_{s} - {common} + {want}" for s in "ab"}
    first = "not arrays_overlap(slice(keys_a, 1, i_a), slice(keys_b, 1, i_b))"
    shared = ", ".join(f"slice(keys_{s}, 1, size(filter(ats_{s}, x -> x < {inside[s]})))" for s in "ab")
    pairs = a.join(b, "key").where(
        f"(n_a < n_b or n_a = n_b and rep_a < rep_b) and comp_a <> comp_b and {DEN} * n_a >= {NUM} * n_b"
        f" and at_a <= n_a - {common} and at_b <= n_b - {common}"
        f" and (keys_a is null or keys_b is null or ({first} and (not all_a or not all_b or size(array_intersect({shared})) >= {want})))"
    )
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def candidates(rows: DataFrame, carried: int = 64) -> DataFrame:
    """The pairs of ``meetings``, once each."""
    return meetings(rows, carried).distinct()


def tie_hubs(docs: DataFrame, rows: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with the components that hub pairs tie together, and the links found."""
    found = []
    for turn in range(rounds):
        pairs = materialize(hub_pairs(rows, turn))
        links = materialize(verify(docs, pairs.select("a", "b")))
        tied = pairs.join(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), ["a", "b"])
        ties = tied.count()
        if not ties:
            break
        found.append(links)
        comps = components(tied, "ca", "cb").select(F.col("node").alias("comp"), F.col("component").alias("_c"))
        rows = materialize(across(rows.join(_joinable(comps), "comp", "left").withColumn("comp", F.coalesce("_c", "comp")).drop("_c")))
        if ties * TIED < pairs.count():
            break
    return rows, found


def verify(docs: DataFrame, pairs: DataFrame, pairs_a_time: int = 120) -> DataFrame:
    """Links (u, v) among candidate pairs (a, b), on whole sets.

    The end of a pair that has more pairs is its hub.  A hub's pairs are dealt into parts of about ``pairs_a_time``; a part gets
    the hub's text once and the other ends' texts after it.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    degree = materialize(ends.groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    of = lambda side: _joinable(degree.select(F.col("id").alias(side), F.col("d").alias(f"d{side}")), 32)
    hub = F.col("da") >= F.col("db")
    dealt = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(
        F.when(hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("other"),
        F.ceil(F.greatest("da", "db") / pairs_a_time).alias("parts"),
    )
    dealt = materialize(dealt.select("hub", "other", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(_joinable(degree.select("id")), "id", "left_semi")
    # texts stay where they are until a part takes them
    heads = _joinable(dealt.select("hub", "part").distinct(), 32).join(texts, F.col("hub") == F.col("id")).select("hub", "part", F.lit(None).cast("long").alias("other"), "text")
    tails = _joinable(dealt, 40).join(texts, F.col("other") == F.col("id")).select("hub", "part", "other", "text")
    met = heads.unionByName(tails).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("other").asc_nulls_first())

    def run(batches):
        kept = None
        for pdf in batches:
            out = []
            for hub, other, text in zip(pdf["hub"], pdf["other"], pdf["text"]):
                if pd.isna(other):
                    kept = shingle(text)
                elif similar(kept, shingle(text)):
                    out.append((hub, int(other)))
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return met.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_match: int = 16, hub_rounds: int = 8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, distinct = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if distinct == n:
        return _components_of(docs, max_match, hub_rounds)
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()))  # numbers stay as they are written
    found = _components_of(rows.select(F.col("row").alias("doc_id"), "text"), max_match, hub_rounds).withColumnRenamed("doc_id", "row")
    found = materialize(rows.select("row", F.col("doc_id").alias("id")).join(found, "row"))
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    return found.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _components_of(docs: DataFrame, max_match: int, hub_rounds: int) -> DataFrame:
    """``near_duplicates`` where every document has an id of its own."""
    with batches_of(docs.sparkSession, 2000):
        profiled = materialize(profile(docs))
    rows = profiled.where("chunk is null").select("doc_id", "n", "d1", "d2", "k1", "k2")
    equal = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.count(F.lit(1)).alias("copies"))
    equal = materialize(equal)
    classes = frequency_classes(profiled)
    first = materialize(leader_links(docs, equal))
    comp = materialize(components(first))
    # documents whose place is not their own: copies, and members of components
    copies = rows.where("n > 0").join(equal.where("copies > 1").select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select("doc_id", "rep")
    copies = materialize(copies)
    placed = copies.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("comp"))
    alone = comp.join(copies.select(F.col("doc_id").alias("node")), "node", "left_anti").select(F.col("node").alias("doc_id"), F.col("node").alias("rep"), F.col("component").alias("comp"))
    places = materialize(placed.unionByName(alone).distinct())
    with batches_of(docs.sparkSession, 2000):
        postings = materialize(prefixes(docs, places, classes, max_match))
    rows_across, tied = tie_hubs(docs, materialize(across(postings)), hub_rounds)
    discard(postings)
    links = first.unionByName(verify(docs, materialize(candidates(rows_across))))
    for more in tied:
        links = links.unionByName(more)
    links = materialize(links.distinct())
    final = components(links).withColumnRenamed("node", "rep")
    of = rows.join(copies.distinct(), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(final, "rep", "left")
    return of.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
