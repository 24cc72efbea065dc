"""Prefix trie of conversations, as chains of nodes that one conversation owns.

A node is a distinct sequence of first d turns; the smallest conversation that starts with it owns it.  What a conversation owns is everything
from its first owned depth on: past the point where it parts from all smaller ones it never meets them again.  So one number for each
conversation, found by binary search, gives the whole tree: every round probes the middle depth of all open conversations in one join against the
minima of prefix digests (only prefixes that several conversations share have a row there).  The owned depths of a conversation form a chain that hangs from
the owner of the depth before; sums over subtrees go up over chains, twice as far in every round, and then along each chain.

Prefix digests are running sums (exclusive or) of 128 bits made from a turn's SHA-256 and its depth, so they need no order of evaluation: a
conversation that holds most turns is numbered range by range and summed block by block.  Keys that many rows look up (a first turn that most
conversations share) are told by exact counts and broadcast, at most ``common.HEAVY`` of them; all others are joined by key.  Digests guard against
chance, not against texts made to collide.

Defined results: rows without a conversation id belong to no conversation and are left out; null roles and texts are empty; rows of one turn number, and
those without one, which come first, stand in the order of the SHA-256 of role and text, repeated rows are turns of their own; a conversation without
turns is a member of the root; other columns, whatever their names, are not read; an empty table has no tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered_within

from .common import discard, look_up, materialize

BLOCK = 4096  # depths that are summed in one group
IDS_A_CHUNK = 8192


def running(rows: DataFrame, group: str, at: str, names: dict[str, str], *, downwards: bool = False) -> DataFrame:
    """``rows`` with every column of ``names`` ("sum" or "xor") added up along ``at`` inside ``group``, block by block.

    ``at`` counts from 0 or 1 without gaps; ``downwards`` adds up from the end.
    """
    total = {n: (F.sum if kind == "sum" else F.bit_xor) for n, kind in names.items()}
    plus = {n: ((lambda a, b: a + b) if kind == "sum" else (lambda a, b: a.bitwiseXOR(b))) for n, kind in names.items()}
    rows = rows.withColumn("_block", F.expr(f"{at} div {BLOCK}"))
    step = (lambda c: F.col(c).desc()) if downwards else F.col
    so_far = Window.partitionBy(group, "_block").orderBy(step(at)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: total[n](n).over(so_far) for n in names})
    blocks = rows.groupBy(group, "_block").agg(*[total[n](n).alias(n) for n in names])
    earlier = Window.partitionBy(group).orderBy(step("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # most groups have one block and need nothing from another
    base = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), *[total[n](n).over(earlier).alias(f"_{n}") for n in names]).where(F.col(f"_{next(iter(names))}").isNotNull())
    joined = local.join(base, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
    for n in names:
        joined = joined.withColumn(n, F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(plus[n](F.col(n), F.col(f"_{n}"))))
    return joined.drop("_block", "_g", "_b", *[f"_{n}" for n in names])


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, bytes) of every turn: its place, 128 bits of the SHA-256 of role and text, the UTF-8 size of its text.  Texts are not shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    turns = rows.where("conv_id is not null").select("conv_id", "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    turns = turns.select("conv_id", "turn", half(1).alias("a"), half(17).alias("b"), "bytes")
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    return materialize(numbered_within(turns, "conv_id", [F.col("turn").asc_nulls_first(), unsigned("a"), unsigned("b")]).drop("turn"))


def sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def shared_openings(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that neighbours share openings: (turns with ``depth`` and ``n``, conversations with ``n``).

    Conversation c takes the first h turns of conversation c - c % ``every`` in place of its own first h, where h = crc32(c) % (``most`` + 1).
    """
    own = sizes(turns).select("conv_id", F.col("n").alias("n0"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    own = materialize(own.withColumn("from", F.col("conv_id") - F.col("conv_id") % every))
    first = own.select(F.col("conv_id").alias("from"), F.col("n0").alias("n_from"))
    taken = F.least("h", F.coalesce("n_from", F.lit(0).cast("long")))
    convs = own.join(first, "from", "left").select("conv_id", "from", "h", "n0", taken.alias("taken"), (taken + F.greatest(F.col("n0") - F.col("h"), F.lit(0))).alias("n"))
    convs = materialize(convs)
    discard(own)
    n_rows = turns.count()
    kept = look_up(turns, convs.select("conv_id", "h", "taken", "n", "n0"), ["conv_id"], n_rows, "n0").where("place > h")
    kept = kept.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "n", "a", "b", "bytes")
    opening = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "from")
    given = convs.select("conv_id", "from", "h", "n").join(opening, "from").where("place <= h")
    return kept.unionByName(given.select("conv_id", F.col("place").alias("depth"), "n", "a", "b", "bytes")), convs.select("conv_id", "n")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their own turns: (turns with ``depth`` and ``n``, conversations with ``n``)."""
    convs = materialize(sizes(turns))
    met = look_up(turns, convs.withColumn("n0", F.col("n")), ["conv_id"], turns.count(), "n0")
    return met.select("conv_id", F.col("place").alias("depth"), "n", "a", "b", "bytes"), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n, x, y, bytes): the digest x, y of the first ``depth`` turns."""
    mixed = turns.select("conv_id", "depth", "n", F.xxhash64("a", "b", "depth").alias("x"), F.xxhash64("depth", "b", "a").alias("y"), "bytes")
    return materialize(running(mixed, "conv_id", "depth", {"x": "xor", "y": "xor"}))


KEY = ["depth", "x", "y"]


def first_owned(paths: DataFrame, shared: DataFrame, convs: DataFrame, total: int, deepest: int) -> DataFrame:
    """(conv_id, n, f) of every conversation: the first depth it owns, n + 1 where it owns none, by binary search over depths 1 to n + 1."""
    state = materialize(convs.select("conv_id", "n", F.lit(1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi")))
    for _ in range(deepest.bit_length()):
        probe = state.where("lo < hi").withColumn("depth", F.expr("(lo + hi) div 2"))
        met = probe.join(paths.select("conv_id", *KEY), ["conv_id", "depth"])
        met = look_up(met, shared.select(*KEY, "owner", "members"), KEY, total, "members")
        owns = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        moved = met.select("conv_id", "n", F.when(owns, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        before, state = state, materialize(state.where("lo >= hi").unionByName(moved))
        discard(before)
    return state.select("conv_id", "n", F.col("lo").alias("f"))


def tree_sums(chains: DataFrame, names: Sequence[str]) -> DataFrame:
    """(conv_id, names...): the sums of a chain and all that hangs from it.

    Every round a chain adds what is 2^k chains below it, and its pointer goes twice as far up; chains whose pointer has left the
    tree drop out, so there are as many rounds as the depth of the tree of chains has binary digits.
    """
    sums = chains.select("conv_id", *names)
    links = materialize(chains.where("parent is not null").select("conv_id", "parent"))
    while n := links.count():
        met = links.join(sums, "conv_id").groupBy("parent").agg(F.count(F.lit(1)).alias("below"), *[F.sum(c).alias(f"_{c}") for c in names])
        met = materialize(met.withColumnRenamed("parent", "conv_id"))
        added = sums.join(met.drop("below"), "conv_id", "left").select("conv_id", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("long"))).alias(c) for c in names])
        sums = materialize(added)
        # the next pointer of a link is that of the chain it points to, asked for by all that are below it
        up = links.select(F.col("conv_id").alias("parent"), F.col("parent").alias("next")).join(met.select(F.col("conv_id").alias("parent"), "below"), "parent")
        before, links = links, materialize(look_up(links, up, ["parent"], n, "below").where("next is not null").select("conv_id", F.col("next").alias("parent")))
        discard(before)
        discard(met)
    return sums


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the members that end at a node, given (conv_id, depth, member).

    Ids are put together in ranges first, so that a group of any size comes to its one digest as a stream of few long texts.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            last, ids = None, []
            for owner, depth, member in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if ids and ((owner, depth) != last or len(ids) >= IDS_A_CHUNK):
                    for column, value in zip(out, (*last, ids[0], ",".join(map(str, ids)))):
                        column.append(value)
                    ids = []
                last = (owner, depth)
                ids.append(member)
            if ids:
                for column, value in zip(out, (*last, ids[0], ",".join(map(str, ids)))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], names=["conv_id", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for owner, depth, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
                if (owner, depth) == last:
                    state.update(b"," + text.encode())
                    continue
                if last is not None:
                    for column, value in zip(out, (*last, state.hexdigest())):
                        column.append(value)
                last, state = (owner, depth), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "depth", "ends_sha256"])

    order = ["conv_id", "depth", "member"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "conv_id long, depth long, first long, ids string")
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie (see ``NODES``) of conversations given as (conv_id, depth, n, a, b, bytes) and (conv_id, n).

    ``conv_id`` is the smallest member; ``saved_tokens`` adds up over a subtree what the other members of each node need not repeat.
    """
    spark, long = turns.sparkSession, lambda n: F.lit(n).cast("long")
    about = convs.agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("all"), F.sum("n").alias("turns"), F.max("n").alias("deepest")).first()
    if not about["all"]:
        return spark.createDataFrame([], NODES)
    top, total, deepest = about.top, max(1, about.turns), about.deepest
    paths = prefixes(turns)
    shared = paths.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(shared)
    owned = first_owned(paths, shared, convs, total, deepest)

    # chains: what hangs where.  A prefix before the first owned depth has a smaller owner, so it is among the shared ones
    before = owned.where((F.col("f") > 1) & (F.col("f") <= F.col("n"))).withColumn("depth", F.col("f") - 1).join(paths.select("conv_id", *KEY), ["conv_id", "depth"])
    before = look_up(before, shared, KEY, total, "members").select("conv_id", F.col("owner").alias("parent"))
    chains = owned.where((F.col("f") <= F.col("n")) | (F.col("conv_id") == top)).join(before, "conv_id", "left")
    is_top = F.col("conv_id") == F.lit(top)
    chains = materialize(chains.select(
        "conv_id", "n", F.when(is_top, long(0)).otherwise(F.col("f")).alias("f"), F.when(~is_top, F.coalesce("parent", F.lit(top))).alias("parent")
    ))
    hung = chains.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))

    # nodes: every owned depth of a path, and the root
    found = look_up(paths, chains.select("conv_id", "f", "parent", F.col("n").alias("path")), ["conv_id"], total, "path").where("depth >= f")
    found = found.join(shared.select(*KEY, "members"), KEY, "left").withColumn("members", F.coalesce("members", long(1)))
    found = found.select("conv_id", "depth", "n", F.when(F.col("depth") == F.col("f"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("members").alias("n_convs"), ((F.col("members") - 1) * F.col("bytes")).alias("saved"))
    # the top chain goes on to the root: its node at depth 1 is a child of (top, 0), so its parent is itself
    root = chains.where("parent is null").select("conv_id", long(0).alias("depth"), "n", F.lit(None).cast("long").alias("parent_conv_id"), long(about["all"]).alias("n_convs"), long(0).alias("saved"))
    nodes = found.unionByName(root).join(hung, ["conv_id", "depth"], "left").withColumn("hanging", F.coalesce("hanging", long(0)))
    nodes = nodes.withColumn("n_children", F.col("hanging") + (F.col("depth") < F.col("n")).cast("long"))
    nodes = materialize(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).drop("hanging", "n"))

    # sums over subtrees: up over chains, then along each chain from its end
    own = nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = tree_sums(chains.join(own, "conv_id"), ["leaves", "saved"])
    below = chains.where("parent is not null").join(sums, "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("f") - 1).alias("depth"))
    below = below.agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left")
    for c in ("leaves", "saved"):
        nodes = nodes.withColumn(c, F.col(c) + F.coalesce(f"_{c}", long(0)))
    nodes = running(nodes.drop("_leaves", "_saved"), "conv_id", "depth", {"leaves": "sum", "saved": "sum"}, downwards=True)

    # members that end at a node
    last = look_up(paths.where("depth = n").select("conv_id", *KEY), shared, KEY, total, "members")
    last = materialize(last.select(F.col("owner").alias("at"), "depth", F.col("conv_id").alias("member")))
    alone = last.where("at is null").select(F.col("member").alias("conv_id"), "depth", _sha(F.col("member")).alias("ends_sha256"))
    empty = convs.where("n = 0").select(F.lit(top).cast("long").alias("conv_id"), long(0).alias("depth"), F.col("conv_id").alias("member"))
    several = last.where("at is not null").select(F.col("at").alias("conv_id"), "depth", "member").unionByName(empty)
    digests = alone.unionByName(end_digests(several))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
