"""URL filter: explicit host/path rules, else an empirical-Bayes host reputation.

Labelled page outcomes are summed per host (before any shuffle of pages), and the share of
bad outcomes is shrunk level by level through beta-binomial priors: all -> public suffix ->
registered domain -> host.  Each level's prior strength is the method-of-moments estimate
of that level's own spread.  A page is blocked where the lower posterior bound of its host's
bad share (posterior mean less ``z`` posterior deviations) exceeds ``max_bad``.

Rules come first: a rule (host, path, verdict) fits its host and all subdomains if the url's
path starts with the rule's path; the longest fitting rule wins.

Suffixes come from a table of second-level labels (``com.xy``, ``co.xy``: a parameter) and, where a caller has a public suffix
list, from its names (``suffixes``): the longest that a host ends in.

Pages meet their host's posterior by a broadcast of at most ``MAX_HOSTS`` counted rows; beyond it by a join on the host that Spark's
skew handling can split, because the posteriors are a written table with one row a host.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and the
verdict of the overall prior; a host without labels takes its domain's prior; urls of any length are read whole; of equally long
rules the first by host, path and verdict wins; pages without an id are judged too; a page whose outcome is null or whose key is
unknown counts for nothing; repeated rows are judged, and their outcomes counted, each for itself; other columns, whatever their
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000
MAX_HOSTS = 200_000  # rows of a broadcast table of hosts, about 100 bytes each

#: Second-level labels that registries use as public suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _long_suffix(host: Column, labels: Sequence[str], suffixes: Sequence[str]) -> tuple[Column, str]:
    """(a known suffix of several labels or one of the list, else empty; its pattern)."""
    names = [re.escape(s) for s in sorted(suffixes, key=lambda s: (-len(s), s))]
    pattern = "|".join([*names, f"(?:{'|'.join(map(re.escape, labels))})\\.[a-z][a-z]"])
    return F.regexp_extract(host, rf"\.({pattern})$", 1), pattern


def suffix_of(host: Column, labels: Sequence[str] = SECOND_LEVEL, suffixes: Sequence[str] = ()) -> Column:
    """Public suffix: one of the list, or two labels where a registry's second-level label precedes a country code, or the last label."""
    long, _ = _long_suffix(host, labels, suffixes)
    return F.when(long != "", long).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, labels: Sequence[str] = SECOND_LEVEL, suffixes: Sequence[str] = ()) -> Column:
    """Registered domain: one label more than the suffix, or the host itself."""
    _, pattern = _long_suffix(host, labels, suffixes)
    long = F.regexp_extract(host, rf"([^.]*\.(?:{pattern}))$", 1)
    return F.when(long != "", long).otherwise(F.substring_index(host, ".", -2))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules go into one expression")
    rule, verdict = None, None
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength(groups: DataFrame) -> DataFrame:
    """One row: overall n, bad and share, and the prior strength that fits the spread of groups (n, bad)."""
    sums = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tot_n"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("tot_bad"),
        F.count(F.lit(1)).alias("g"),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("n2"),
        F.coalesce(F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")), F.lit(0.0)).alias("b2"),
    ).select("*", ((F.col("tot_bad") + 1.0) / (F.col("tot_n") + 2.0)).alias("p"))
    pq = F.col("p") * (1.0 - F.col("p"))
    spread = F.col("b2") - 2.0 * F.col("p") * F.col("tot_bad") + F.col("p") * F.col("p") * F.col("tot_n")
    room = F.col("tot_n") - F.col("n2") / F.greatest(F.col("tot_n"), F.lit(1)) - (F.col("g") - 1)
    rho = F.when(room > 0, (spread - pq * (F.col("g") - 1)) / (pq * room)).otherwise(0.0)
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.9), rho))
    return sums.select("tot_n", "tot_bad", "p", ((1.0 - rho) / rho).alias("kappa"))


def host_posteriors(
    outcomes: DataFrame, hosts: DataFrame, *, z: float = 1.645, labels: Sequence[str] = SECOND_LEVEL, suffixes: Sequence[str] = ()
) -> DataFrame:
    """Posterior of every host of ``hosts`` (column host) given ``outcomes`` (host, bad 0/1).

    Returns host, n, bad, post_mean, post_low.  Everything is keyed by host or coarser, so
    sizes follow the number of hosts, not of pages.
    """
    counts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counts = materialize(counts)
    levels = {"domain": domain_of(F.col("host"), labels, suffixes), "suffix": suffix_of(F.col("host"), labels, suffixes)}
    named = hosts.select("host").distinct().withColumns(levels)
    table = named.join(counts, "host", "left").fillna(0, ["n", "bad"])
    labelled = counts.withColumns(levels)
    per = {}
    for level in ("suffix", "domain"):
        per[level] = labelled.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per["host"] = counts
    # two numbers of each level come to the driver
    for level in ("suffix", "domain", "host"):
        fit = _strength(per[level]).first()
        table = table.withColumns({f"p_{level}": F.lit(fit.p), f"k_{level}": F.lit(fit.kappa)})
    for level in ("suffix", "domain"):
        table = table.join(per[level].select(level, F.col("n").alias(f"n_{level}"), F.col("bad").alias(f"b_{level}")), level, "left")
    table = table.fillna(0, ["n_suffix", "b_suffix", "n_domain", "b_domain"])
    shrink = lambda bad, n, k, m: (F.col(bad) + F.col(k) * m) / (F.col(n) + F.col(k))
    m_suffix = shrink("b_suffix", "n_suffix", "k_suffix", F.col("p_suffix"))
    m_domain = shrink("b_domain", "n_domain", "k_domain", F.col("m_suffix"))
    a = F.col("bad") + F.col("k_host") * F.col("m_domain")
    total = F.col("n") + F.col("k_host")
    mean = a / total
    return (
        table.withColumn("m_suffix", m_suffix)
        .withColumn("m_domain", m_domain)
        .select("host", "n", "bad", mean.alias("post_mean"), (mean - F.lit(float(z)) * F.sqrt(mean * (1.0 - mean) / (total + 1.0))).alias("post_low"))
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_key: Column | None = None,
    z: float = 1.645,
    max_bad: float = 0.3,
    labels: Sequence[str] = SECOND_LEVEL,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """Judge every page.  ``outcomes`` has (key, bad); ``outcome_key`` is the page's key into it.

    Returns page_id, host, path, rule, verdict, n_labelled, post_mean, post_low.
    """
    url = F.col(url_col)
    key = F.col(id_col) if outcome_key is None else outcome_key
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), key.alias("_key"))
    known = rows.select("host", "_key").join(outcomes.select(F.col("key").alias("_key"), "bad"), "_key").select("host", "bad")
    posts = materialize(host_posteriors(known, rows, z=z, labels=labels, suffixes=suffixes))
    if posts.limit(MAX_HOSTS + 1).count() <= MAX_HOSTS:  # a bounded table need not move the pages of a hot host
        posts = F.broadcast(posts)
    rule, ruled = match_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("post_low") > F.lit(float(max_bad)), "block").otherwise("allow")
    return rows.join(posts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"), F.col("n").alias("n_labelled"), "post_mean", "post_low"
    )
