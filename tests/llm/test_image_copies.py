import struct
import zlib

import numpy as np

from pyspark.sql import functions as F

from tessera.llm import image_copies as ic
from tessera.llm.queries import op1_image_copies

SCHEMA = "id bigint, image binary"


def png(pixels):
    """8-bit grey PNG whose lines take the five filters in turn."""
    h, w = pixels.shape
    lines, above = [], np.zeros(w, int)
    for y in range(h):
        row, kind = pixels[y].astype(int), y % 5
        left = np.append(0, row[:-1])
        corner = np.append(0, above[:-1])
        near = left + above - corner
        choice = np.stack([abs(near - left), abs(near - above), abs(near - corner)])
        paeth = np.stack([left, above, corner])[choice.argmin(0), np.arange(w)]
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def pictures(n, seed=1):
    rnd = np.random.default_rng(seed)
    return [ic.picture(rnd.normal(size=64)) for _ in range(n)]


def test_decoding():
    img = pictures(1)[0]
    assert (ic.decode(ic.encode_pgm(img)) == img.astype(np.uint8)).all()
    assert (ic.decode(png(img.astype(np.uint8))) == img.astype(np.uint8)).all()
    ppm = b"P6 # note\n2 1\n255\n" + bytes([0, 30, 60, 90, 90, 90])
    assert ic.decode(ppm).tolist() == [[30, 90]]
    for broken in (None, b"", b"P5", b"P5\n9 9\n255\nxx", b"GIF89a", png(img)[:60], b"P5\nx y\n255\n"):
        assert ic.decode(broken) is None


def test_finds_cropped_dimmed_turned_and_scaled_copies(spark):
    base = pictures(40)
    changed = {
        0: ic.edited(base[10]), 1: base[11][20:, 8:80], 2: np.rot90(base[12]).copy(), 3: 255 - 0.7 * (255 - base[13]),
        4: ic._resize(base[14], 0.75), 5: base[15] + np.random.default_rng(0).normal(0, 4, base[15].shape), 6: base[16][::-1, ::-1].copy(),
    }
    rows = [(i, ic.encode_pgm(changed.get(i, img))) for i, img in enumerate(base)]
    rows += [(50, rows[30][1]), (51, rows[30][1]), (52, None), (53, b"junk"), (54, ic.encode_pgm(np.zeros((60, 60)))), (55, ic.encode_pgm(np.zeros((9, 9)))), (None, rows[31][1]), (33, rows[33][1])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as q", "2 as r", "'s' as sha", "3 as k")
    out = ic.find_copies(df, (df.id < 10) | (df.id > 40)).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    hits = sum(i + 10 in got[i].copies for i in changed)
    assert hits >= 6
    wrong = sum(len(set(got[i].copies) - {i + 10}) for i in range(10))
    assert wrong == 0
    assert got[51].image_class == 30 and got[51].copies == [] and got[20].copies is None
    assert got[52].n_corners == got[53].n_corners == got[54].n_corners == got[55].n_corners == 0
    assert ic.find_copies(df.limit(0), df.id < 10).count() == 0


def consensus(a, b, max_distance=10, shift=8.0):
    """Inliers of two described images when all descriptor pairs are compared, without tables."""
    if not len(a[0]) or not len(b[0]):
        return 0
    bits = [np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1).astype(int) for w in (a[0], b[0])]
    i, j = np.nonzero((bits[0][:, None] != bits[1][None]).sum(2) <= max_distance)
    p, q = a[1][i], b[1][j]
    turn, scale = q[:, 3] - p[:, 3], 2.0 ** (q[:, 2] - p[:, 2])
    dx = q[:, 0] - scale * (np.cos(turn) * p[:, 0] - np.sin(turn) * p[:, 1])
    dy = q[:, 1] - scale * (np.sin(turn) * p[:, 0] + np.cos(turn) * p[:, 1])
    both = lambda v, w: (np.floor(v / w) * 2, np.floor(v / w + 0.5) * 2 - 1)
    best = 0
    for t in both(turn % (2 * np.pi), np.pi / 6):
        for s in both(q[:, 2] - p[:, 2], 0.8):
            for x in both(dx, 2 * shift):
                for y in both(dy, 2 * shift):
                    cell = {}
                    for k, key in enumerate(zip(t % 24, s, x, y)):
                        cell.setdefault(key, []).append(k)
                    best = max([best, *(min(len({i[k] for k in ks}), len({j[k] for k in ks})) for ks in cell.values())])
    return best


def test_recall_against_all_descriptor_pairs(spark):
    """The tables find at least nine tenths of the copies that comparing all descriptors finds."""
    base = pictures(40, seed=3)
    rows = [(i, ic.encode_pgm(ic.edited(base[i + 20]) if i < 20 else img)) for i, img in enumerate(base)]
    described = [ic.describe(ic.decode(b)) for _, b in rows]
    brute = {(q, r) for q in range(20) for r in range(40) if q != r and consensus(described[q], described[r]) >= 5}
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.id, c) for r in ic.find_copies(df, df.id < 20).collect() for c in r.copies or []}
    assert len(brute) >= 20
    assert len(found & brute) >= 0.9 * len(brute)


def test_query(spark):
    out = op1_image_copies(spark, "/root/testdata/sf0.01").collect()
    asked = [r for r in out if r.is_query]
    assert len(out) == 500 and len(asked) == 5
    right = sum(r.vec_id + 50 in r.copies for r in asked)
    assert right >= 0.9 * len(asked) and sum(len(r.copies) for r in asked) <= right + 1


def test_soft_pictures_and_hot_keys(spark):
    soft = pictures(20)
    assert max(np.abs(np.diff(p, axis=1)).mean() for p in soft) < 12  # like sky or skin: neighbours differ little
    base = pictures(12, seed=4)
    rows = [(i, ic.encode_pgm(ic.edited(base[i + 6]) if i < 6 else img)) for i, img in enumerate(base)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted((r.id, tuple(r.copies or ())) for r in ic.find_copies(df, df.id < 6).collect())
    salted = sorted((r.id, tuple(r.copies or ())) for r in ic.find_copies(df, df.id < 6, max_queries=0, hot_rows=1).collect())
    assert salted == plain and sum(i + 6 in c for i, c in plain if i < 6) >= 5


def test_small_crops_and_thumbnails_of_large_images(spark):
    rnd = np.random.default_rng(6)
    base = [np.block([[ic.picture(rnd.normal(size=64)) for _ in range(4)] for _ in range(4)]) for _ in range(8)]
    changed = [img[100:210, 60:170] if i < 4 else ic._resize(ic._box(img, 1), 1 / 3) for i, img in enumerate(base)]  # 8 % of the area; a third of the side
    rows = [(i, ic.encode_pgm(img)) for i, img in enumerate(changed)] + [(100 + i, ic.encode_pgm(img)) for i, img in enumerate(base)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.copies for r in ic.find_copies(df, df.id < 100).collect()}
    assert sum(100 + i in got[i] for i in range(4)) >= 3 and sum(100 + i in got[i] for i in range(4, 8)) >= 3
    assert sum(len(set(got[i]) - {100 + i}) for i in range(8)) == 0


def test_rows_without_id_and_repeated_ids(spark):
    base = pictures(8, seed=11)
    pgm = [ic.encode_pgm(p) for p in base]
    cut = [ic.encode_pgm(ic.edited(p)) for p in base]
    # an indexed image without id, a query without id, two images under one id, and one row twice
    rows = [(None, pgm[0]), (1, cut[0]), (None, cut[1]), (2, pgm[1]), (5, pgm[2]), (5, pgm[3]), (3, cut[3]), (6, pgm[4]), (6, pgm[4]), (4, cut[4])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as key", "8 as n", "'x' as sha", "9 as least")
    got = ic.find_copies(df, (df.id < 5) | df.id.isNull()).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.image_class, tuple(r.copies or ()), r.n_copies) for r in got if r.is_query}
    assert (1, 1, (), 1) in by  # found, but its class has no id
    assert (None, None, (2,), 1) in by and (3, 3, (5,), 1) in by and (4, 4, (6,), 1) in by
    assert sum(r.id == 5 and r.n_corners > 0 for r in got) == 2


def test_recall_at_any_scale_and_few_chance_matches(spark):
    base = pictures(30, seed=12)
    for scale in (0.9, 0.8, 0.7, 0.62):
        rows = [(i, ic.encode_pgm(ic._resize(base[i], scale) if i < 15 else base[i - 15])) for i in range(45)]
        df = spark.createDataFrame(rows, SCHEMA)
        found = {r.id: r.copies for r in ic.find_copies(df, df.id < 15).collect()}
        assert sum(i + 15 in found[i] for i in range(15)) >= 13, scale
        assert sum(len(set(found[i]) - {i + 15}) for i in range(15)) == 0
    words = [ic.describe(p)[0] for p in base]
    chance = sum(
        int(((a[:, None] == b[None]).any(2) & (np.bitwise_count(a[:, None] ^ b[None]).sum(2) <= 12)).sum()) for i, a in enumerate(words) for b in words[:i]
    )
    assert chance < 0.05 * 30 * 29 / 2


def shapes(seed, side=160):
    """Rectangles and ellipses with hard edges and some noise: nothing like the drawn soft pictures."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side]
    img = np.full((side, side), r.uniform(60, 200))
    for _ in range(30):
        cx, cy, w, h, v = r.uniform(0, side), r.uniform(0, side), r.uniform(6, 40), r.uniform(6, 40), r.uniform(0, 255)
        img[(np.abs(x - cx) < w) & (np.abs(y - cy) < h) if r.random() < 0.5 else ((x - cx) / w) ** 2 + ((y - cy) / h) ** 2 < 1] = v
    return np.clip(img + r.normal(0, 3, img.shape), 0, 255)


def test_recall_of_edits_on_hard_edged_pictures(spark):
    part = lambda p, f: p[int(len(p) * (1 - f) / 2) :, int(len(p) * (1 - f) / 3) :][: int(len(p) * f), : int(len(p) * f)]
    edits = [lambda p: p * 0.7 + 40, lambda p: part(p, 0.88), lambda p: part(p, 0.71), np.rot90, lambda p: ic._resize(p, 0.7), lambda p: ic._resize(part(p, 0.88), 0.8) * 0.8 + 20]
    rows = []
    for i in range(20):
        picture = shapes(i)
        rows.append((i, ic.encode_pgm(picture), False))
        rows += [(1000 * e + i, ic.encode_pgm(edit(picture)), True) for e, edit in enumerate(edits, 1)]
    df = spark.createDataFrame(rows, "id long, image binary, q boolean").repartition(4)
    found = {r.id: set(r.copies) for r in ic.find_copies(df, F.col("q")).where("is_query").collect()}
    for e in range(1, len(edits) + 1):
        assert sum(i in found[1000 * e + i] for i in range(20)) >= 18, e
    assert all(x % 1000 == q % 1000 for q, copies in found.items() for x in copies)
