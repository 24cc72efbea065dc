import hashlib
import math

import numpy as np

from tessera.llm import exponion
from tessera.llm.queries import op12_exponion


def brute(rows, k=16, rounds=3, dims=64):
    """Lloyd's rounds in plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(x)) for x in v]))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for turn in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, a) in zip(kept, near) if a == j]
                if own:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    total = sum(d for d, _ in near) if kept else 0
    out = []
    for (i, _), (d, j) in zip(kept, near):
        out.append((i, j, d, sum(e for e, b in near if b == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()], key=str)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert plain(op12_exponion(spark, d)) == brute(rows)


def test_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(4)
    grid = [[float(x) / 64 for x in rnd.integers(-2, 3, 4)] for _ in range(300)]  # few values: many ties and equal vectors
    rows = [(int(i) if i % 50 else None, v) for i, v in enumerate(grid)] + [(2**60 + 1, grid[0]), (2**60 + 1, grid[0])]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [0.1, -0.1, 1e-9, -1e-9])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as cluster", "4 as squared").repartition(7)
    got = exponion.cluster(df, dims=4)
    assert got.columns[-1] == "centroid"
    assert plain(got) == brute(rows + odd, dims=4)
    for some in (rows[:3], rows[:1]):  # fewer vectors than centroids
        few = spark.createDataFrame(some, "vec_id bigint, embedding array<double>")
        assert plain(exponion.cluster(few, dims=4)) == brute(some, dims=4)
    assert exponion.cluster(df.limit(0), dims=4).count() == 0
    assert exponion.cluster(df.where("vec_id = 905"), dims=4).count() == 0


def test_bounds_save_distances_and_lose_nothing():
    rnd = np.random.default_rng(7)
    middles = rnd.integers(-4000, 4000, (16, 64))
    x = np.repeat(middles, 200, axis=0) + rnd.integers(-150, 150, (3200, 64))
    c = x[rnd.choice(len(x), 16, replace=False)]
    a, u, l, moved, seen = np.zeros(len(x), int), np.full(len(x), np.inf), np.zeros(len(x)), None, []
    for turn in range(5):
        search = exponion.Search(c, moved)
        a, u, l, d = search.assign(x, a, u, l, exact=turn == 4)
        full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (a == full.argmin(axis=1)).all()
        exact = np.sqrt(full.astype(float))
        rows = np.arange(len(x))
        assert (u >= exact[rows, a]).all()
        exact[rows, a] = np.inf
        assert (l <= exact.min(axis=1)).all()
        after = np.array([x[a == j].sum(axis=0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(16)])
        moved = np.sqrt(((after - c) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12)
        c = after
        seen.append(search.distances)
    assert (d == full.min(axis=1)).all()
    assert sum(seen[1:]) < 16 * len(x)  # four full searches compute four times as many
