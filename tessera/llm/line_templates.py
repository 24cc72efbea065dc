"""Line dedup by log templates.

Lines go through a tree of fixed depth: first the number of tokens, then the leading ``DEPTH`` tokens, where
a token with a digit counts as the wildcard ``<*>``.  In a leaf, a line's template keeps the line's most usual tokens: each is ranked by how many
documents' lines of the leaf have it at its place, at least ``similarity`` of all tokens stay, tokens of equal rank together, and the
rest, the variable fields, become wildcards.  Lines that keep the same tokens share a template.  The rule looks at counts only, so it does not depend on
any order, on partitions or on the size of a leaf, and no leaf is ever held together.

A template whose lines stand in ``min_docs`` documents or more is recurring, and its lines are dropped from all
documents.  Lines of ``long_tokens`` tokens or more do not agree by chance: their template recurs from two documents on, and
below ``min_docs`` the document with the smallest id keeps them.

Lines are counted per document and combined before anything meets in a leaf, so a very common line
is one row there.  Tokens are counted and looked up as rows, those of usual tokens through a broadcast of bounded size.

A line is named by two 64-bit hashes, of its leaf and of itself.

Defined results: null text counts as empty and has no lines; blank lines stay; lines are parted by LF, tokens by white
space; a document counts once per template however often it repeats the line; texts and lines of any length are taken whole; rows that
share an id are one document (their rows count one by one where tokens are ranked), rows without an id are one
document that never is the smallest; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, materialize

WILD = "<*>"
DEPTH = 3
NOBODY = -(1 << 63)  # no document keeps the line
_DIGIT = re.compile("[0-9]").search


def key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def leaf(parts: list[str], depth: int) -> int:
    return key(f"{len(parts)}|{' '.join(parts[:depth])}")


def lines_of(text: str | None, min_tokens: int) -> Iterator[tuple[int, list[str]]]:
    """(number, tokens) of the lines that take part, variable fields generalised."""
    if not text:
        return
    digits = _DIGIT(text)
    for i, line in enumerate(text.split("\n")):
        parts = line.split()
        if len(parts) >= min_tokens:
            if digits and _DIGIT(line):
                parts = [WILD if _DIGIT(p) else p for p in parts]
            yield i, parts


def _occurrences(docs: DataFrame, min_tokens: int, long_tokens: int) -> DataFrame:
    """Distinct (doc_id, line, leaf, long) of every document."""

    def run(batches):
        for batch in batches:
            ids, lines, leaves, long = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {" ".join(parts): parts for _, parts in lines_of(text, min_tokens)}
                ids += [doc] * len(seen)
                lines += map(key, seen)
                leaves += [leaf(parts, DEPTH) for parts in seen.values()]
                long += [len(parts) >= long_tokens for parts in seen.values()]
            columns = [pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(leaves, pa.int64()), pa.array(long, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "leaf", "long"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line long, leaf long, long boolean")


class Names:
    """A set of (leaf, line) pairs with a number each, as sorted arrays: 24 bytes a pair."""

    def __init__(self, leaves: np.ndarray, lines: np.ndarray, values: np.ndarray):
        order = np.lexsort((leaves, lines))
        self.leaves, self.lines, self.values = leaves[order], lines[order], values[order]

    def find(self, leaves: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Place of each pair, -1 where it is not in the set."""
        if not len(self.lines):
            return np.full(len(lines), -1)
        low, high = np.searchsorted(self.lines, lines, "left"), np.searchsorted(self.lines, lines, "right")
        found = np.full(len(lines), -1)
        for step in range(int((high - low).max(initial=0))):  # one step, unless two lines share a hash
            at = np.minimum(low + step, len(self.lines) - 1)
            found = np.where((low + step < high) & (self.leaves[at] == leaves), at, found)
        return found


def _sent(table: DataFrame, columns: list[str], max_bytes: int):
    """Columns of a table as arrays in a broadcast where 24 bytes a row stay within the bound, else None."""
    most = max(-1, max_bytes // 24)
    if table.limit(most + 1).count() > most:
        return None
    rows = table.select(*columns).toArrow()
    return [rows.column(c).to_numpy() for c in columns]


def _texts_in(docs: DataFrame, leaves: DataFrame, min_tokens: int, max_bytes: int) -> DataFrame:
    """Distinct (leaf, line, masked) of the lines in ``leaves``: by a broadcast of bounded size, else by a join."""
    few = _sent(leaves, ["leaf"], max_bytes)
    wanted = docs.sparkSession.sparkContext.broadcast(None if few is None else np.sort(few[0]))

    def run(batches):
        known = wanted.value
        for pdf in batches:
            found = {}
            for text in pdf["text"]:
                for _, parts in lines_of(text, min_tokens):
                    line = " ".join(parts)
                    if line not in found:
                        found[line] = leaf(parts, DEPTH)
            at, lines = np.array(list(found.values()), np.int64), np.array(list(found), object)
            if known is not None:
                on = known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at if len(known) else np.zeros(len(at), bool)
                at, lines = at[on], lines[on]
            yield pd.DataFrame({"leaf": at, "line": np.array([key(m) for m in lines], np.int64), "masked": lines})

    rows = docs.mapInPandas(run, "leaf long, line long, masked string")
    if few is None:
        rows = rows.join(leaves.select("leaf"), "leaf", "left_semi")
    return rows.groupBy("leaf", "line").agg(F.first("masked").alias("masked"))


def _kept_tokens(rows: DataFrame, similarity: float) -> DataFrame:
    """(leaf, line, head) of (leaf, line, docs, masked): ``head`` names the tokens that a line keeps in its template."""
    tokens = rows.select("leaf", "line", "docs", F.posexplode(F.split("masked", " ")).alias("at", "token")).where(F.col("at") >= DEPTH)
    tokens = materialize(tokens.select("leaf", "line", "docs", "at", F.xxhash64("at", "token").alias("token")))
    usual = materialize(tokens.groupBy("leaf", "token").agg(F.sum("docs").alias("with"), F.count(F.lit(1)).alias("asked")))
    met = look_up(tokens, usual, ["leaf", "token"], tokens.count(), "asked")
    # a line's own tokens, the most usual first
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("with")).alias("rank"), "at", "token")))
    ranked = met.groupBy("leaf", "line").agg(ranked.alias("ranked"))
    need = F.ceil(F.round((F.size("ranked") + DEPTH) * F.lit(similarity), 6)).cast("int") - DEPTH
    last = F.when(need > 0, F.try_element_at("ranked", F.greatest(need, F.lit(1)))["rank"])
    kept = F.transform(F.filter("ranked", lambda r: F.coalesce(r["rank"] <= F.col("last"), F.lit(False))), lambda r: r["token"])
    return ranked.withColumn("last", last).select("leaf", "line", F.xxhash64(F.lit("template"), kept).alias("head"))


def templates(
    docs: DataFrame, *, similarity: float = 0.6, min_tokens: int = 1, long_tokens: int = 20, max_bytes: int = 32 << 20
) -> tuple[DataFrame, DataFrame]:
    """(occurrences (doc_id, line, leaf, long), template of lines (leaf, line, head) of leaves with several lines)."""
    found = materialize(_occurrences(docs, min_tokens, long_tokens))
    lines = materialize(found.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs")))
    sizes = materialize(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    texts = _texts_in(docs, sizes.select("leaf"), min_tokens, max_bytes)
    return found, materialize(_kept_tokens(lines.join(texts, ["leaf", "line"]), similarity))


def recurring(found: DataFrame, named: DataFrame, min_docs: int) -> DataFrame:
    """Lines of recurring templates: (leaf, line, keeper); ``keeper`` is the document that keeps a long one, null for none."""
    own = found.join(named, ["leaf", "line"], "left").withColumn("head", F.coalesce("head", "line"))
    # a document counts once per template; without merged lines it already stands once
    per = own.groupBy("leaf", "head", "doc_id").agg(F.first("long").alias("long")).groupBy("leaf", "head")
    per = per.agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.first("long").alias("long"))
    wide = per.where((F.col("docs") >= min_docs) | (F.col("long") & (F.col("docs") > 1)))
    wide = wide.select("leaf", "head", F.when(F.col("docs") < min_docs, F.col("first")).alias("keeper"))
    lines = found.select("leaf", "line").distinct().join(named, ["leaf", "line"], "left").withColumn("head", F.coalesce("head", "line"))
    return lines.join(wide, ["leaf", "head"]).select("leaf", "line", "keeper")


def drop_recurring(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, similarity: float = 0.6, min_tokens: int = 1,
    long_tokens: int = 20, max_bytes: int = 32 << 20, with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, and the kept text if wanted."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found, named = templates(docs, similarity=similarity, min_tokens=min_tokens, long_tokens=long_tokens, max_bytes=max_bytes)
    gone = materialize(recurring(found, named, min_docs))
    few = _sent(gone.withColumn("keeper", F.coalesce("keeper", F.lit(NOBODY))), ["leaf", "line", "keeper"], max_bytes)
    # ids go round pandas as text: it would make floats of longs beside a missing one
    schema = "doc_id string, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(None if few is None else Names(*few))
    if few is not None:
        rows = docs.withColumn("gone", F.lit(None).cast("array<struct<leaf:long,line:long>>"))
    else:
        mine = F.col("keeper").isNull() | ~F.col("keeper").eqNullSafe(F.col("doc_id"))
        per = found.join(gone, ["leaf", "line"]).where(mine).groupBy("doc_id").agg(F.collect_set(F.struct("leaf", "line")).alias("gone")).withColumnRenamed("doc_id", "_d")
        rows = docs.join(per, docs["doc_id"].eqNullSafe(per["_d"]), "left").drop("_d")

    def run(batches):
        import hashlib

        common = sent.value
        for pdf in batches:
            out = []
            for doc, text, own in zip(pdf["doc_id"], pdf["text"], pdf["gone"]):
                at, parts = [], []
                if common is not None or own is not None:
                    for i, tokens in lines_of(text, min_tokens):
                        at.append(i)
                        parts.append(tokens)
                bad: set[int] = set()
                if at:
                    leaves = np.array([leaf(p, DEPTH) for p in parts], np.int64)
                    keys = np.array([key(" ".join(p)) for p in parts], np.int64)
                    if common is not None:
                        place = common.find(leaves, keys)
                        drop = place >= 0
                        if doc is not None:
                            drop[drop] = common.values[place[drop]] != int(doc)
                    else:
                        mine = {(r["leaf"], r["line"]) for r in own}
                        drop = np.array([pair in mine for pair in zip(leaves.tolist(), keys.tolist())])
                    bad = set(np.array(at)[drop].tolist())
                lines = text.split("\n") if text else []
                kept = "\n".join([line for i, line in enumerate(lines) if i not in bad]) if bad else text
                out.append((doc, len(lines), len(bad), hashlib.sha256(kept.encode()).hexdigest(), kept)[: len(names)])
            yield pd.DataFrame(out, columns=names)

    done = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
