import random

import numpy as np

from tessera.llm import ngram_join as nj
from tessera.llm.components import components
from tessera.llm.queries import op6_ngram_join

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, word = [], ""
    for c in (text or "").translate(table) + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posts = {}
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in posts.get(s, ()):
                common[j] = common.get(j, 0) + 1
            posts.setdefault(s, []).append(i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        words[at] = f"new{rnd.randrange(10**6)}"
    return words


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op6_ngram_join(spark, d)) == brute(rows)


def test_links_near_the_threshold(spark):
    rnd, rows = random.Random(11), []
    common = [f"c{i}" for i in range(120)]  # a passage that most documents share
    for base in range(12):
        words = [f"b{base}w{rnd.randrange(60)}" for _ in range(rnd.choice([6, 9, 40, 150]))]
        for _ in range(14):
            own = edited(words, rnd, rnd.choice([0, 0, 1, 1, 2, 3, 6]))
            rows.append((len(rows) * 7 % 1000, " ".join(own + common if base % 3 == 0 else own).upper() if base % 2 else "\n".join(own)))
    rows += [(2001, None), (2002, ""), (2003, " \t"), (2004, "one two"), (2005, "ONE  two"), (2006, "one two three"), (2007, "É a b c d"), (2008, "é a b c d")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as rep", "'x' as token", "3 as comp")
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 30
    for max_match in (1, 4):
        assert got(nj.near_duplicates(df, max_match=max_match)) == want
    assert nj.near_duplicates(df.limit(0)).count() == 0


def test_exact_pass_finds_all_links_without_leaders(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(words, rnd, i % 9))) for i in range(60)]
    monkeypatch.setattr(nj, "leader_links", lambda docs, reps: spark.createDataFrame([], "u long, v long"))
    assert got(nj.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_group_of_near_copies_does_not_make_all_pairs(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(words, rnd, 1))) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(nj.near_duplicates(df))
    assert {c for _, c in out.values()} == {0}
    reps = nj.profile(df).where("chunk is null").selectExpr("doc_id as rep", "n", "k1", "k2")
    assert nj.leader_links(df, reps, bucket_rows=100).count() < 4 * len(rows)


def test_family_that_does_not_link_makes_few_pairs(spark):
    """Documents with more shared shingles than a row carries meet where a link must have its first common one, and once."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(800)]
    rows = [(i, " ".join(edited(words, rnd, 22))) for i in range(60)]
    rows += [(60 + i, " ".join(edited(rows[i][1].split(), rnd, 2))) for i in range(8)]  # each links to one of the family
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, rep long, comp long")
    posts = nj.across(nj.prefixes(docs, none, nj.frequency_classes(nj.profile(docs)), 16)).persist()
    assert posts.groupBy("rep").count().where("count > 64").count() > 60
    sets = {i: nj.shingle(t) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and nj.similar(sets[a], sets[b])}
    found = [tuple(r) for r in nj.candidates(posts).collect()]
    assert len(links) >= 8 and links <= set(found) and len(found) < 2 * len(rows)
    assert nj.meetings(posts).count() < 2 * len(found)


def test_prefix_length_follows_cost():
    cheap, dear = np.full(100, 0.01), np.full(100, 500.0)
    assert nj.choose_match(cheap, 80, 4) == 1
    assert nj.choose_match(dear, 80, 4) == 4


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (7, 7), (22, 20)] + [(100 + i, 101 + i) for i in range(64)]
    got_ = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got_[9] == 3 and got_[22] == 20 and got_[164] == 100 and got_[5] == 3
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_and_missing_ids(spark):
    rnd = random.Random(3)
    words = [[f"t{k}w{rnd.randrange(900)}" for _ in range(60)] for k in range(4)]
    text = lambda k, e=0: " ".join(edited(words[k], rnd, e))
    rows = [(5, text(0)), (5, text(1)), (7, text(0, 1)), (3, text(1, 1)), (None, text(2)), (None, text(2, 1)), (9, text(3)), (None, text(3)), (2**62, text(2)), (9, text(3))]
    out = sorted(((r.doc_id, r.component_id) for r in nj.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(5, 5), (7, 5), (5, 3), (3, 3), (None, 2**62), (None, 2**62), (2**62, 2**62), (9, 9), (9, 9), (None, 9)]
    assert out == sorted(want, key=str)
    alone = nj.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "c d e f g h"), (None, "")], SCHEMA)).collect()
    assert [r.component_id for r in alone] == [None] * 3 and sorted(r.n_shingles for r in alone) == [0, 1, 2]


def test_key_collision_inside_a_document_loses_no_pair(spark):
    """Two shingles of one document under one 32-bit key do not hide a pair that needs both."""
    rows = spark.sql(
        "select rep, rep as comp, 10 as n, 2 as l, at, token from values (1L, 0, 11L), (1L, 1, 12L), (2L, 0, 11L), (2L, 1, 12L) as t(rep, at, token)"
    )
    plain = nj.F.hash
    try:
        nj.F.hash = lambda *_: nj.F.lit(7)  # every shingle has one key
        assert [tuple(r) for r in nj.candidates(rows).collect()] == [(1, 2)]
    finally:
        nj.F.hash = plain
    assert [tuple(r) for r in nj.candidates(rows).collect()] == [(1, 2)]


def test_hub_with_many_pairs_is_dealt_out(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words))] + [(i, " ".join(edited(words, rnd, 1 if i % 2 else 9))) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(1, 2), (3, 5)], "a long, b long")
    links = {(min(u, v), max(u, v)) for u, v in nj.verify(docs, pairs, pairs_a_time=7).collect()}
    sets = {i: nj.shingle(t) for i, t in rows}
    assert links == {(a, b) for a, b in pairs.collect() if nj.similar(sets[a], sets[b])} and len(links) > 25


def test_sql_of_the_query(spark):
    import duckdb

    from tessera.llm.queries import SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(f"select doc_id, n_shingles, component_id from ({SQL['op6_ngram_join']})").fetchall()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_ngram_join(spark, d).collect()) == sorted(want)
