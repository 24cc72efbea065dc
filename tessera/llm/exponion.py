"""Centroid clustering by exponion search, exact on integer vectors.

Every vector carries its centroid, an upper bound u of the distance to it and a lower bound l of the distance to any other.  A vector
with u below l, or below half the distance s from its centroid to the next one, stays without a look.  The others make u exact
and, where that does not settle it, scan only the centroids in a ball of radius 2u + s around their own: centroids are listed by distance from
each other, so the ball is the head of a list.  The radius is inclusive and bounds are rounded outwards, so ties are seen
and go to the smaller number.  Squared distances are exact 64-bit integers.  What the driver holds is the centroids (k times the
dimension); sums per centroid are partial per task, so a centroid that most vectors share is no hot group.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out, and so are those with a component
beyond 2^20, whose squared distances would not fit a long; repeated vectors and repeated or missing ids are rows of their own (a missing id
hashes as the empty string, equal hashes are ordered by vector); with fewer vectors than centroids every vector starts one; a
centroid without vectors stays where it is; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

LIMIT = 1 << 20
_SLACK = 1e-12  # far above the rounding of a square root and a few sums


def _up(x):
    return x * (1 + _SLACK)


def _down(x):
    return np.where(x > 0, x * (1 - _SLACK), x * (1 + _SLACK))


class Search:
    """Centroids, the distances between them, and how far each has moved since the bounds were made."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None = None):
        self.c = np.asarray(centroids, dtype=np.int64)
        k = len(self.c)
        between = np.sqrt(np.array([((self.c - c) ** 2).sum(axis=1) for c in self.c], dtype=np.float64))
        np.fill_diagonal(between, -1.0)  # its own centroid heads every list
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.maximum(np.take_along_axis(between, self.order, axis=1), 0.0)
        self.next = self.between[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if moved is None else moved
        self.moved = moved
        self.others = np.array([max([m for j, m in enumerate(moved) if j != i], default=0.0) for i in range(k)])
        self.distances = 0  # how many have been computed

    def _squared(self, x: np.ndarray, j) -> np.ndarray:
        self.distances += len(x)
        return ((x - self.c[j]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray, exact: bool = False):
        """(centroid, upper bound, lower bound, squared distance) of every vector; the distance is 0 where it was not computed, unless ``exact``."""
        a = a.copy()
        u, l = _up(u + self.moved[a]), _down(l - self.others[a])
        squared = np.zeros(len(x), dtype=np.int64)
        settled = np.maximum(l, _down(self.next[a] / 2))
        look = np.flatnonzero(np.ones(len(x), bool) if exact else ~(u < settled))
        squared[look] = self._squared(x[look], a[look])
        u[look] = _up(np.sqrt(squared[look].astype(np.float64)))
        look = look[~(u[look] < settled[look])]
        for own in np.unique(a[look]):
            rows = look[a[look] == own]
            ball = _up(2 * u[rows] + self.next[own])
            reach = np.searchsorted(_down(self.between[own]), ball, side="right")
            best, at, second = squared[rows].copy(), np.full(len(rows), own), np.full(len(rows), np.iinfo(np.int64).max)
            for place in range(1, int(reach.max(initial=0))):
                inside = np.flatnonzero(reach > place)
                j = self.order[own, place]
                d = self._squared(x[rows[inside]], j)
                nearer = (d < best[inside]) | ((d == best[inside]) & (j < at[inside]))
                second[inside] = np.minimum(second[inside], np.where(nearer, best[inside], d))
                best[inside] = np.where(nearer, d, best[inside])
                at[inside] = np.where(nearer, j, at[inside])
            a[rows], squared[rows] = at, best
            u[rows] = _up(np.sqrt(best.astype(np.float64)))
            l[rows] = np.where(second == np.iinfo(np.int64).max, np.inf if len(self.c) == 1 else _down(ball - u[rows]), _down(np.sqrt(second.astype(np.float64))))
        return a, u, l, squared


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component, null for a vector that is left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > LIMIT))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.when((F.size(vector) == dims) & ~bad, whole)


def _assigned(state: DataFrame, search: Search, dims: int, exact: bool) -> DataFrame:
    schema = T.StructType([T.StructField("id", state.schema["id"].dataType), T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()),
                           T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("squared", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            a, u, l, d = search.assign(x, *[batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)], exact=exact)
            columns = [batch.column(0), v, pa.array(a.astype(np.int32)), pa.array(u), pa.array(l), pa.array(d)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return state.select("id", "v", "cluster", "upper", "lower").mapInArrow(run, schema)


def _moved(state: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The floor of the mean of every centroid's vectors; k rows reach the driver."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)])
    out = list(centroids)
    for r in sums.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return out


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1"
) -> DataFrame:
    """id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` and ``centroid`` of every kept vector.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``salt:id``; each of ``rounds`` assigns all vectors and moves the centroids to
    the componentwise floor of their mean; then vectors are assigned once more.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col), dims, scale).alias("v")).where("v is not null")
    state = materialize(rows.withColumns({"cluster": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}))
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.v) for r in state.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    moved = None
    for turn in range(rounds + 1 if centroids else 0):
        search = Search(np.array(centroids), moved)
        before, state = state, materialize(_assigned(state, search, dims, exact=turn == rounds))
        discard(before)
        if turn < rounds:
            after = _moved(state, centroids, dims)
            moved = _up(np.sqrt(((np.array(after) - np.array(centroids)) ** 2).sum(axis=1).astype(np.float64)))
            centroids = after
    inertia = {}
    if centroids:
        sums = state.groupBy("cluster").agg(F.sum(F.col("squared").cast("decimal(38,0)")).alias("s"))
        inertia = {r.cluster: int(r.s) for r in sums.collect()}  # k rows
    fits = lambda n: min(n, (1 << 63) - 1)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = spark.createDataFrame(
        [(j, fits(s), fits(sum(inertia.values())), sha(centroids[j]), [int(x) for x in centroids[j]]) for j, s in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<int>",
    )
    distance = F.col("squared") if centroids else F.lit(0).cast("long")
    out = state.select(F.col("id").alias(id_col), "cluster", distance.alias("distance"))
    return out.join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
