"""Media columns: cropped or edited copies of images, by local descriptors.

* Corners: gradient-tensor response on a pyramid of scales down to 32 pixels a side, local maxima, the strongest of
  each tile of 96 pixels of each scale, so their number grows with the area.
* Each corner is turned by the direction of its patch's intensity centroid and described by 128 binary
  tests (is one point darker than another) at turned, smoothed positions: changes of brightness,
  contrast and in-plane rotation leave most bits alone.
* Hamming tables: a descriptor is cut into four 32-bit words, each a key of its own table; two descriptors that
  differ in three bits or fewer agree in a word for certain, and most at larger distances do too.
  Index rows meet query rows by (table, word) and count as matches within ``max_distance`` bits.
* Geometric consensus: each match votes for the turn, scale and shift that it implies, in overlapping cells;
  two images are copies when ``min_inliers`` corners of the query agree on a cell.

Byte-equal images are one class before anything is matched or described, so a large group of copies is one index entry.

Defined results: null, empty or undecodable bytes and flat images have no corners and match nothing, but null is a class, as is
every distinct byte string; binary PGM and PPM and 8-bit PNG without interlacing are decoded; images below 32 pixels a
side have no corners, larger ones are described whole; repeated rows are members of their class, and rows that share an id but not
their bytes belong to a class each; rows without an id are queries and index entries like all others, and a class without any
id has a null ``image_class`` and counts in ``n_copies`` without standing in ``copies``; among equally strong corners of a tile the
upper, then the left one comes first; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize

BITS = 128
PATCH = 11.4  # turned tests lie inside this radius, and inside the margin when rounded
MARGIN = 12
TURNS = 36  # a quarter turn is a whole number of steps
STEP = 0.84  # four levels halve a side; a copy of any size is within 9 % of a level
SMALLEST = 32  # pixels a side of the last level
TILE = 96  # pixels of a level; each tile keeps its own strongest corners


def _pattern() -> np.ndarray:
    """Pairs of points of the binary tests, turned by each of ``TURNS`` angles: (turn, test, point, xy)."""
    # the second point is near the first: far points of a soft picture only repeat which way its shade runs
    rnd = np.random.default_rng(20)
    first = rnd.normal(0, 6.5, (BITS * 12, 2))
    points = np.stack([first, first + rnd.normal(0, 4.0, first.shape)], 1)
    inside = (np.hypot(points[..., 0], points[..., 1]) <= PATCH).all(axis=1)
    points = points[inside & (np.abs(np.round(points[:, 0] - points[:, 1])).sum(axis=1) >= 2)][:BITS]
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
    return np.round(np.einsum("tab,ijb->tija", turn, points)).astype(np.int64)


_TESTS = _pattern()
_DISK = np.array([(x, y) for x in range(-7, 8) for y in range(-7, 8) if x * x + y * y <= 49])


# --- decoding -----------------------------------------------------------------------------


def _netpbm(data: bytes) -> np.ndarray | None:
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    if top > 255 or min(width, height) < 1:
        return None
    planes = 3 if data[:2] == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8, width * height * planes, at + 1).reshape(height, width, planes)
    return pixels.mean(axis=2)


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    width, height, planes = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * planes)
    out = np.zeros((height, width * planes), np.uint8)
    above = np.zeros(width * planes, np.int64)
    for y, (kind, *_) in enumerate(raw[:, :1].tolist()):
        line = raw[y, 1:].astype(np.int64)
        if kind in (1, 3, 4):
            for x in range(len(line)):
                left = line[x - planes] if x >= planes else 0
                up, corner = above[x], (above[x - planes] if x >= planes else 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    near = left + up - corner
                    guess = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        elif kind == 2:
            line = (line + above) & 255
        out[y] = line
        above = line
    shades = {1: 1, 2: 1, 3: 3, 4: 3}[planes]
    return out.reshape(height, width, planes)[:, :, :shades].mean(axis=2)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of an image, or None where the bytes are no image that is known here."""
    if not data:
        return None
    try:
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error, TypeError):
        return None  # broken bytes are a defined case
    return None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


# --- corners and descriptors -----------------------------------------------------------------


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)^2 neighbours; edges repeat."""
    n = 2 * r + 1
    s = np.pad(np.pad(a, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def _resize(a: np.ndarray, scale: float) -> np.ndarray:
    h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
    y, x = np.minimum(np.arange(h) / scale, a.shape[0] - 1.001), np.minimum(np.arange(w) / scale, a.shape[1] - 1.001)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x0 + 1] * fx
    low = a[y0 + 1][:, x0] * (1 - fx) + a[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def describe(pixels: np.ndarray | None, per_level: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """(bits as uint32 words [n, 4], geometry [n, 4] of x, y, log2 scale, turn in radians)."""
    words, places = [], []
    level = 0
    while pixels is not None and min(pixels.shape) * STEP**level >= SMALLEST:
        scale = STEP**level
        level += 1
        img = pixels if scale == 1 else _resize(pixels, scale)
        smooth = _box(img, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        power = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = power[1:-1, 1:-1]
        best = np.ones(peak.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    best &= peak >= power[1 + dy : power.shape[0] - 1 + dy, 1 + dx : power.shape[1] - 1 + dx]
        best &= peak > 1.0
        ys, xs = np.nonzero(best)
        ys, xs = ys + 1, xs + 1
        on = (xs >= MARGIN) & (ys >= MARGIN) & (xs < img.shape[1] - MARGIN) & (ys < img.shape[0] - MARGIN)
        ys, xs = ys[on], xs[on]
        if not len(ys):
            continue
        tile = ys // TILE * (img.shape[1] // TILE + 1) + xs // TILE
        top = np.lexsort((xs, ys, -power[ys, xs], tile))
        tile = tile[top]
        top = top[np.arange(len(top)) - np.searchsorted(tile, tile) < per_level]
        ys, xs = ys[top], xs[top]
        around = smooth[ys[:, None] + _DISK[:, 1], xs[:, None] + _DISK[:, 0]]
        angle = np.arctan2(around @ _DISK[:, 1], around @ _DISK[:, 0])
        tests = _TESTS[np.round(angle / (2 * np.pi / TURNS)).astype(int) % TURNS]
        soft = _box(smooth, 1)
        value = soft[ys[:, None, None] + tests[..., 1], xs[:, None, None] + tests[..., 0]]
        words.append(np.packbits(value[..., 0] < value[..., 1], axis=1).view("<u4"))
        places.append(np.stack([xs / scale, ys / scale, np.full(len(xs), -np.log2(scale)), angle], axis=1))
    if not words:
        return np.zeros((0, 4), np.uint32), np.zeros((0, 4))
    return np.concatenate(words), np.concatenate(places)


_CORNERS = "key long, n int, side int, words array<long>, geometry array<float>"


def corners(images: DataFrame, per_level: int = 14) -> DataFrame:
    """(key, n, side, words, geometry) of every image (key, image): four words and four numbers per corner, the longer side."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, data in zip(pdf["key"], pdf["image"]):
                pixels = decode(data)
                w, g = describe(pixels, per_level)
                out.append((i, len(w), 0 if pixels is None else max(pixels.shape), w.ravel().astype(np.int64).tolist(), g.ravel().astype(np.float32).tolist()))
            yield pd.DataFrame(out, columns=["key", "n", "side", "words", "geometry"])

    return images.select("key", "image").mapInPandas(run, _CORNERS)


def _tables(reps: DataFrame, name: str) -> DataFrame:
    """A row per corner and table: (table, word), the descriptor."""
    some = reps.where("n > 0")
    corner = some.select(F.col("key").alias(name), "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    word = lambda i: F.try_element_at("words", F.col("k") * 4 + i + 1)
    rows = corner.select(name, F.col("k").alias(f"{name}_k"), *[word(i).alias(f"{name}_w{i}") for i in range(4)])
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col(f"{name}_w{t}").alias("word")) for t in range(4)])
    return rows.select("*", F.explode(keys).alias("at")).select("*", "at.table", "at.word").drop("at")


def _cells(value: Column, width: Column | float) -> Column:
    """The two half-overlapping cells of a value."""
    return F.array(F.floor(value / width) * 2, F.floor(value / width + 0.5) * 2 - 1)


def _salted(q: DataFrame, r: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: index rows of a key with over ``hot_rows`` of them are dealt out, its query rows go to each part."""
    hot = r.groupBy("table", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = materialize(hot.select("table", "word", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    r = r.join(hot, ["table", "word"], "left").withColumn("salt", F.pmod(F.xxhash64("r", "r_k"), parts).cast("int")).drop("parts")
    q = q.join(hot, ["table", "word"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return q, r


def matches(
    queries: DataFrame, index: DataFrame, *, max_distance: int = 12, min_inliers: int = 5, shift: float = 8.0, hot_rows: int = 10_000, max_queries: int = 1_000
) -> DataFrame:
    """(q, r, inliers) of images, one row per class each, that geometric consensus holds for copies.

    Queries are broadcast up to ``max_queries`` images' worth of corners, 168,000 rows of about 176 bytes; more are joined by
    word, with hot words dealt out.
    """
    q, r = _tables(queries, "q"), _tables(index, "r")
    few = queries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= max_queries * 42  # corners, counted
    far = " + ".join(f"bit_count(q_w{i} ^ r_w{i})" for i in range(4))
    if few:
        hit = r.join(F.broadcast(q), ["table", "word"])
    else:
        q, r = _salted(q, r, hot_rows)
        hit = r.join(q, ["table", "word", "salt"])
    hit = hit.where(f"q <> r and {far} <= {int(max_distance)}")
    # until a pair of images has enough corners on either side it is carried as numbers of corners, eight bytes a match
    both = F.col("q_k").cast("long") * F.lit(1 << 32) + F.col("r_k")
    pairs = hit.groupBy("q", "r").agg(F.collect_set(both).alias("m"))
    of = lambda f: F.size(F.array_distinct(F.transform("m", f)))
    pairs = pairs.where((of(lambda m: F.shiftright(m, 32)) >= min_inliers) & (of(lambda m: m.bitwiseAND(F.lit((1 << 32) - 1))) >= min_inliers))
    place = lambda t, name: t.select(F.col("key").alias(name), F.col("geometry").alias(f"{name}_g"))
    sides = queries.select(F.col("key").alias("q"), "side")
    pairs = pairs.join(place(queries, "q"), "q").join(sides, "q").join(place(index, "r"), "r")
    at = lambda name, i: F.try_element_at(f"{name}_g", (F.col(f"{name}_k") * 4 + i + 1).cast("int")).cast("double").alias(f"{name}_{'xyst'[i]}")
    hit = pairs.select("q", "r", "side", "q_g", "r_g", F.explode("m").alias("m"))
    hit = hit.withColumn("q_k", F.shiftright("m", 32).cast("int")).withColumn("r_k", F.col("m").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    hit = hit.select("q", "r", "side", "q_k", "r_k", *[at(name, i) for name in "qr" for i in range(4)])
    turn, scale = F.col("r_t") - F.col("q_t"), F.pow(F.lit(2.0), F.col("r_s") - F.col("q_s"))
    dx = F.col("r_x") - scale * (F.cos(turn) * F.col("q_x") - F.sin(turn) * F.col("q_y"))
    dy = F.col("r_y") - scale * (F.sin(turn) * F.col("q_x") + F.cos(turn) * F.col("q_y"))
    # a turn of 0 and of 360 degrees are the same; cells cover the circle once
    around = F.pmod(turn, F.lit(2 * np.pi))
    votes = hit.select(
        "q", "r", "q_k", "r_k", "side", _cells(around, np.pi / 6).alias("a"), F.explode(_cells(F.col("r_s") - F.col("q_s"), 0.8)).alias("s"), dx.alias("dx"), dy.alias("dy")
    )
    # an error of turn or scale moves a corner in proportion to the query's size in the other image
    extent = F.col("side") * F.pow(F.lit(2.0), (F.col("s") / 2 + 0.5) * 0.8)
    width = 2 * shift * F.greatest(F.lit(1.0), extent / TILE)
    votes = votes.withColumn("x", _cells(F.col("dx"), width)).withColumn("y", _cells(F.col("dy"), width)).drop("dx", "dy", "side")
    votes = votes.withColumn("a", F.transform("a", lambda c: F.pmod(c, F.lit(24))))
    for name in "axy":
        votes = votes.withColumn(name, F.explode(name))
    # sets of at most an image's corners; a corner counts once on either side
    both = F.least(F.size(F.collect_set("q_k")), F.size(F.collect_set("r_k")))
    agreed = votes.groupBy("q", "r", "a", "s", "x", "y").agg(both.alias("inliers"))
    return agreed.groupBy("q", "r").agg(F.max("inliers").alias("inliers")).where(F.col("inliers") >= min_inliers)


def classed(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, is_query, key) and classes (key, image_class, rows) of (id, is_query, image): one class per byte string.

    A class is named by a 64-bit hash of its digest, under the first seed that gives every digest a name of its own.
    """
    flags = materialize(images.select("id", F.coalesce("is_query", F.lit(False)).alias("is_query"), digest(F.col("image")).alias("sha")))
    sums = materialize(flags.groupBy("sha").agg(F.min("id").alias("image_class"), F.count(F.lit(1)).alias("rows")))
    seed = next(k for k in range(64) if not sums.groupBy(name(F.col("sha"), k).alias("key")).count().where("count > 1").limit(1).count())
    return flags.select("id", "is_query", name(F.col("sha"), seed).alias("key")), sums.select(name(F.col("sha"), seed).alias("key"), "image_class", "rows", F.lit(seed).alias("seed"))


def digest(image: Column) -> Column:
    return F.coalesce(F.sha2(image, 256), F.lit("none"))


def name(sha: Column, seed: int | Column) -> Column:
    return F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, sha)


def find_copies(images: DataFrame, is_query: Column, *, id_col: str = "id", image_col: str = "image", max_classes: int = 500_000, **options) -> DataFrame:
    """One row per image: id, image_class (smallest id of its bytes), n_corners, is_query, copies, n_copies.

    ``copies`` lists, for query rows, the classes of all images that show the same picture; null for others.
    """
    marked = images.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"), is_query.alias("is_query"))
    rows, classes = classed(marked)
    classes = materialize(classes)
    seed = (classes.select("seed").first() or [0])[0]
    # of a repeated image one row is described; the rows that are described stay where they are
    repeated = classes.where("rows > 1").select("key", F.col("image_class").alias("least"), F.lit(True).alias("many"))
    if repeated.limit(max_classes + 1).count() <= max_classes:  # 17 bytes a row
        repeated = F.broadcast(repeated)
    todo = marked.select("id", "image", name(digest(F.col("image")), seed).alias("key")).join(repeated, "key", "left")
    with batches_of(images.sparkSession, 200):
        # rows that repeat an id with its bytes are described once more and dropped here
        reps = materialize(corners(todo.where("many is null or id <=> least")).dropDuplicates(["key"]))
    asked = rows.where("is_query").select("key").distinct()
    pairs = matches(reps.join(asked, "key", "left_semi"), reps, **options)
    named = pairs.join(classes.select(F.col("key").alias("r"), "image_class"), "r")
    lists = named.groupBy(F.col("q").alias("key")).agg(F.array_sort(F.collect_set("image_class")).alias("list"), F.countDistinct("r").alias("many"))
    out = rows.join(classes.select("key", "image_class"), "key").join(reps.select("key", F.col("n").alias("n_corners")), "key").join(lists, "key", "left")
    none = F.array().cast("array<long>")
    return out.select(
        "id", "image_class", "n_corners", "is_query", F.when(F.col("is_query"), F.coalesce("list", none)).alias("copies"),
        F.when(F.col("is_query"), F.coalesce("many", F.lit(0))).alias("n_copies"),
    )


# --- pictures for tables without media --------------------------------------------------------------


def picture(vector: np.ndarray, side: int = 96) -> np.ndarray:
    """A picture of soft textures that a vector determines."""
    rnd = np.random.default_rng(np.frombuffer(np.ascontiguousarray(vector, np.float32).tobytes(), np.uint32))
    img = np.full((side, side), 128.0)
    for cells, strength in ((6, 60.0), (12, 45.0), (24, 30.0)):
        img += strength * _resize(rnd.normal(size=(cells, cells)), side / cells)
    return np.clip(img, 0, 255)


def edited(pixels: np.ndarray) -> np.ndarray:
    """A cropped, dimmed copy."""
    h, w = pixels.shape
    return pixels[h // 12 : h - h // 16, w // 10 : w - w // 20] * 0.8 + 20


def draw(vectors: DataFrame, every: int = 100) -> DataFrame:
    """(id, image) for (id, of) where ``of`` is the vector to draw; rows divisible by ``every`` show an edited copy."""

    def run(batches):
        for pdf in batches:
            out = []
            for edit, vector in zip(pdf["edit"], pdf["of"]):
                if vector is None:
                    out.append(None)
                    continue
                img = picture(np.asarray(vector))
                out.append(encode_pgm(edited(img) if edit else img))
            yield pd.DataFrame({"id": pdf["id"], "image": out})

    edit = F.coalesce(F.col("id") % every == 0, F.lit(False))
    # ids go round pandas as text: it would make floats of longs beside a missing one
    drawn = vectors.select(F.col("id").cast("string").alias("id"), "of", edit.alias("edit")).mapInPandas(run, "id string, image binary")
    return drawn.withColumn("id", F.col("id").cast("long"))
