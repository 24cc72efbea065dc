import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import host_reputation as hr
from tessera.llm.queries import URL_RULES

URLS = [
    ("HTTP://WWW.Example.COM/en/x?y=1#z", "www.example.com", "/en/x", "www.example.com/en/"),
    ("http://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/"),
    ("http://example.com/fr/", "example.com", "/fr/", "com/"),
    ("http://example.com", "example.com", "", None),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/"),
    ("https://a.net/es/1", "a.net", "/es/1", "net/es/"),
    ("https://a.net/de/1", "a.net", "/de/1", None),
    ("no scheme", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("x://h?q=://other/", "h", "", None),
    ("://É.Org/p\n2/q", "É.org", "/p\n2/q", None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id bigint, url string").selectExpr("*", "1 as host", "2 as n", "'s' as suffix")
    none = spark.createDataFrame([], "key bigint, bad int")
    got = {r.page_id: r for r in hr.filter_urls(pages, none, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    assert [got[i].verdict for i in (0, 1, 3, 4, 5)] == ["allow", "block", "allow", "allow", "block"]
    assert hr.filter_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_shrinkage(spark):
    hosts = {"bad.one.org": (40, 40), "new.one.org": (0, 0), "good.two.org": (40, 0), "new.two.org": (0, 0), "rare.two.org": (1, 1)}
    rows, k = [], 0
    for h, (n, bad) in hosts.items():
        for j in range(max(n, 1)):
            rows.append((k, f"http://{h}/{k}", (int(j < bad) if n else None)))
            k += 1
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    got = {r.host: r for r in hr.filter_urls(df, df.select(F.col("page_id").alias("key"), "bad"), (), max_bad=0.5).dropDuplicates(["host"]).collect()}
    assert got["bad.one.org"].verdict == "block" and got["good.two.org"].verdict == "allow"
    assert got["new.one.org"].post_mean > got["new.two.org"].post_mean
    assert got["good.two.org"].post_mean < got["rare.two.org"].post_mean < got["bad.one.org"].post_mean
    assert got["rare.two.org"].post_low < got["bad.one.org"].post_low


def test_domains(spark):
    hosts = ["a.b.example.co.uk", "example.com", "x.example.com", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", hr.domain_of(F.col("h")).alias("d"), hr.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.com": ("example.com", "com"),
        "x.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }


def test_suffix_list(spark):
    df = spark.createDataFrame([("a.b.city.kawasaki.jp",), ("x.github.io",), ("io",), ("a.co.uk",)], "h string")
    names = ("kawasaki.jp", "github.io")
    got = {r.h: (r.d, r.s) for r in df.select("h", hr.domain_of(F.col("h"), suffixes=names).alias("d"), hr.suffix_of(F.col("h"), suffixes=names).alias("s")).collect()}
    assert got == {"a.b.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"), "x.github.io": ("x.github.io", "github.io"), "io": ("io", "io"), "a.co.uk": ("a.co.uk", "co.uk")}


def posteriors(outcomes, hosts, z):
    """Plain beta-binomial shrinkage, level by level."""
    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))

    def sums(key):
        out = {}
        for h, bad in outcomes:
            n, b = out.get(key(h), (0, 0))
            out[key(h)] = (n + 1, b + bad)
        return out

    def prior(groups):
        total, bad, k = sum(n for n, _ in groups), sum(b for _, b in groups), len(groups)
        p = (bad + 1) / (total + 2)
        between = sum(n * (b / n - p) ** 2 for n, b in groups)
        room = total - sum(n * n for n, _ in groups) / max(total, 1) - (k - 1)
        rho = (between - p * (1 - p) * (k - 1)) / (p * (1 - p) * room) if room > 0 else 0
        rho = min(0.9, max(0.001, rho))
        return p, (1 - rho) / rho

    level = [sums(f) for f in (suffix, domain, lambda h: h)]
    (p, ks), (_, kd), (_, kh) = (prior(list(x.values())) for x in level)
    out = {}
    for h in hosts:
        (sn, sb), (dn, db), (n, b) = (x.get(f(h), (0, 0)) for x, f in zip(level, (suffix, domain, lambda h: h)))
        m = (sb + ks * p) / (sn + ks)
        m = (db + kd * m) / (dn + kd)
        m, total = (b + kh * m) / (n + kh), n + kh
        out[h] = (m, m - z * (m * (1 - m) / (total + 1)) ** 0.5)
    return out


def test_posteriors_against_a_plain_loop(spark):
    rnd = random.Random(2)
    hosts = [f"h{i}.d{i % 9}.{'xyz'[i % 3]}" for i in range(60)]
    rate = {h: rnd.random() ** 2 for h in hosts}
    outcomes = [(h, int(rnd.random() < rate[h])) for h in hosts[:45] for _ in range(rnd.randint(0, 12))] + [(hosts[0], 1)] * 400
    got = hr.host_posteriors(spark.createDataFrame(outcomes, "host string, bad int"), spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    want = posteriors(outcomes, hosts, 1.645)
    assert len(got) == len(hosts)
    for r in got:
        assert r.post_mean == pytest.approx(want[r.host][0], rel=1e-9) and r.post_low == pytest.approx(want[r.host][1], rel=1e-9, abs=1e-12)


def test_repeated_rows_long_urls_and_missing_ids(spark):
    long = "http://a.org/" + "p" * 100_000
    rows = [(1, long), (1, long), (None, "http://b.org/x"), (None, None), (2, "http://a.org/")]
    out = hr.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([(1, 1), (1, 1), (9, 0)], "key bigint, bad int"), ()).collect()
    assert len(out) == 5 and {r.n_labelled for r in out if r.host == "a.org"} == {4}
    assert sorted(len(r.path) for r in out) == [0, 1, 2, 100_001, 100_001]


def test_sql_of_the_query(spark):
    import duckdb

    from tessera.llm.queries import SQL, op10_host_reputation

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = op10_host_reputation(spark, d)
    want = con.sql(f"select {', '.join(df.columns)} from ({SQL['op10_host_reputation']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
