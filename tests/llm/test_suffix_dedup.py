import hashlib
import random

import numpy as np

from tessera.llm import lyndon_sort as ls
from tessera.llm import suffix_dedup as sd
from tessera.llm.queries import op4_suffix_dedup

SCHEMA = "doc_id bigint, text string"


def brute(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for a in range(len(data) - 49):
                s = data[a : a + 50]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for a in range(len(data) - 49):
                if first[data[a : a + 50]] < i:
                    gone[a : a + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def naive(s, at=0):
    return [at + i for i in sorted(range(len(s)), key=lambda i: list(s[i:]))]


def test_suffix_orders():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        lengths = rnd.integers(0, 50, 20)
        strings = [rnd.integers(0, int(rnd.integers(1, 5)), n) for n in lengths]
        at = np.cumsum(lengths) - lengths
        order = ls.sort_strings(np.concatenate(strings), lengths)
        for s, n, a in zip(strings, lengths, at):
            assert order[a : a + n].tolist() == naive(s.tolist(), int(a))
            assert ls.sort_one(s).tolist() == naive(s.tolist())
    long = np.concatenate([np.tile([1, 2], 1600), rnd.integers(0, 2, 200)])
    mixed = np.concatenate([[3, 1, 2], long])
    assert ls.sort_strings(mixed, np.array([3, len(long)])).tolist() == [1, 2, 0, *naive(long.tolist(), 3)]
    assert ls.sort_one(long).tolist() == naive(long.tolist())


def test_pieces_cover_every_window_once():
    rnd = random.Random(1)
    texts = ["ab" * 400, "".join(rnd.choice("abcde ") for _ in range(900)), "x" * 49, "x" * 50, "q" * 3000]
    data = "".join(texts).encode()
    lengths = np.array([len(t) for t in texts])
    least, text, start, size = sd.pieces(np.frombuffer(data, np.uint8), lengths)
    seen = sorted(int(s) + k for s, n in zip(start, size) for k in range(n))
    base = np.cumsum(lengths) - lengths
    assert seen == [int(b) + k for b, n in zip(base, lengths) for k in range(max(0, n - 49))]
    assert size.max() <= sd.RUN


def corpus():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):
        t = " ".join(word() for _ in range(rnd.randint(5, 60)))
        if i % 3 == 0:
            a = rnd.randrange(60)
            t = t[: rnd.randrange(len(t))] + passage[a : a + rnd.randint(48, 140)] + t[10:]
        if i % 10 == 0 and rows:
            t = rows[-3 % len(rows)][1]
        if i % 17 == 5:
            t = "ha " * rnd.randint(10, 300)
        if i % 23 == 7:
            t = t + "é" * rnd.randint(20, 90)
        rows.append((1000 - 7 * i, t))
    return rows + [(5000, None), (5001, ""), (5002, "short"), (5003, "x" * 50), (5004, "x" * 51), (5005, passage), (5006, passage)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as least", "'c' as copy", "3 as row")
    want = brute(rows)
    assert sum(r[2] for r in want) > 4000
    assert got(sd.remove_repeats(df)) == want
    assert got(sd.remove_repeats(df, hot_pieces=1)) == want  # everything is cut finer
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_flushes_instead_of_broadcast(spark):
    rows = corpus()
    want, df = brute(rows), spark.createDataFrame(rows, SCHEMA)
    assert got(sd.remove_repeats(df, max_bytes=-1)) == want
    assert got(sd.remove_repeats(df, max_bytes=-1, hot_pieces=1)) == want


def test_short_hot_line_in_many_contexts(spark, monkeypatch):
    """A 60-byte line between ever other words, with some contexts that two documents share."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    line = "The quick brown fox jumps over the lazy dog by the river bank"
    rows = [(i, " ".join([word(), word(), word(), line, word(), word(), word()])) for i in range(3000)]
    rows += [(4000 + i, "zz " + rows[7 * i][1][10:100] + " yy") for i in range(200)]
    want = brute(rows)
    groups = []
    plain = sd.decided_pieces

    def watched(distinct):
        groups.append(distinct.groupBy("least").count().agg({"count": "max"}).first()[0] or 0)
        return plain(distinct)

    monkeypatch.setattr(sd, "decided_pieces", watched)
    df = spark.createDataFrame(rows, SCHEMA)
    for max_bytes in (64 << 20, -1):
        groups.clear()
        assert got(sd.remove_repeats(df, hot_pieces=50, max_bytes=max_bytes)) == want
        assert len(groups) == 2 and max(groups) <= 50


def test_repeated_and_missing_ids(spark):
    rows = corpus()[:40]
    rows += [(rows[3][0], rows[8][1]), (rows[3][0], rows[3][1]), (None, rows[0][1]), (None, rows[0][1]), (2000, rows[0][1])]
    out = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), with_text=True)
    assert got(out) == brute(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out.collect())


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4_suffix_dedup(spark, d)) == brute(rows)


def test_sql_of_the_query(spark):
    import duckdb

    from tessera.llm.queries import SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    df = op4_suffix_dedup(spark, d)
    want = con.sql(f"select {', '.join(df.columns)} from ({SQL['op4_suffix_dedup']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_windows_that_stand_alone_are_not_sorted(monkeypatch):
    """Verdicts of groups of pieces against a table of all windows; what the suffix sort gets is the shared part."""
    rnd = random.Random(12)
    noise = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    contents, ids, group = [], [], []
    for g in range(40):
        line = noise(70)
        for k in range(rnd.randint(2, 12)):
            contents.append(noise(rnd.randint(50, 150)) + line[rnd.randint(0, 9) : 70 - rnd.randint(0, 9)] + noise(60) if k % 3 else noise(100) + b"ha " * 40 + line)
            ids.append(rnd.randrange(1000))
            group.append(g - 20)
    sizes, plain = [], sd.sort_strings
    monkeypatch.setattr(sd, "sort_strings", lambda symbols, lengths: sizes.append(len(symbols)) or plain(symbols, lengths))
    owner, windows = sd.decide(contents, np.array(ids), np.array(group))
    least = {}
    for c, i, g in zip(contents, ids, group):
        for a in range(len(c) - 49):
            least[g, c[a : a + 50]] = min(i, least.get((g, c[a : a + 50]), i))
    assert owner.tolist() == [least[g, c[a : a + 50]] for c, g in zip(contents, group) for a in range(len(c) - 49)]
    assert windows.tolist() == [len(c) - 49 for c in contents]
    assert sizes and sum(sizes) < 0.6 * sum(map(len, contents))
    alone = [noise(80), noise(50)]
    assert sd.decide(alone, np.array([3, 1]), np.array([0, 0]))[0].tolist() == [3] * 31 + [1]


def test_groups_that_lie_in_several_arrow_batches(spark):
    rows = corpus()
    want, df = brute(rows), spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    plain, sd.decided_pieces.__defaults__ = sd.decided_pieces.__defaults__, (500,)
    try:
        assert got(sd.remove_repeats(df)) == want
    finally:
        sd.decided_pieces.__defaults__ = plain
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
