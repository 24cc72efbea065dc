import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import common
from tessera.llm import conversation_trie as ct
from tessera.llm.queries import SQL, op13_conversation_trie


def ordered(rows):
    """conversation -> its turns (role, text), nulls made empty, in the operator's order."""
    sha = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(r, t), (r, t)))
    return {c: [x[-1] for x in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += kids[k] == 0
    sha = lambda c: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


def plain(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(op13_conversation_trie(spark, d)) == brute(rebuilt(ordered(rows)))


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as n", "2 as depth", "'x' as sha", "3 as place", "4 as owner")


def drawn(seed, n=40):
    """Few different turns, so that openings are shared, parted and shared by others again; odd rows among them."""
    rnd, rows = random.Random(seed), []
    for c in range(0, n):
        c = c if rnd.random() < 0.8 else c + 2**60
        for t in range(rnd.choice([1, 2, 3, 9, 12])):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["", "é", "aa", None, "long " * 50])))
    rows += [rows[0]] * 3 + [(None, 1, "user", "nobody's")]
    rows += [(100 + c, t, "user", f"t{t}") for c in range(12) for t in range(25)]  # copies
    rows += [(200, t, "user", f"t{t}" if t < 20 else f"u{t}") for t in range(60)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy, block, chunk", [(10_000, 4096, 8192), (3, 4, 2)])
def test_openings_and_chains(spark, monkeypatch, heavy, block, chunk):
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(ct, "BLOCK", block)
    monkeypatch.setattr(ct, "IDS_A_CHUNK", chunk)
    rows = drawn(heavy)
    turns = ct.numbered_turns(table(spark, rows).repartition(5))
    assert plain(ct.trie(*ct.as_they_are(turns))) == brute(ordered(rows))
    assert plain(ct.trie(*ct.shared_openings(turns))) == brute(rebuilt(ordered(rows)))


def test_nested_chains(spark):
    """Conversation k shares k turns with the one before: chains hang from chains as deep as there are conversations."""
    rows = [(k, t, "user", "same" if t < k else f"own {k}") for k in range(14) for t in range(k + 1)]
    rows += [(50 + k, t, "user", f"c{t}" if t < 9 - k else f"d{k}") for k in range(9) for t in range(10)]
    turns = ct.numbered_turns(table(spark, rows))
    assert plain(ct.trie(*ct.as_they_are(turns))) == brute(ordered(rows))


def test_one_conversation_holds_most_turns(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(9000)] + [(8, t, "user", f"turn {t}") for t in range(5)] + [(9, 0, "user", "x")]
    turns = ct.numbered_turns(table(spark, rows).repartition(6))
    nodes = {(r.conv_id, r.depth): r for r in ct.trie(*ct.as_they_are(turns)).collect()}
    assert len(nodes) == 9002 and nodes[7, 5].n_convs == 2 and nodes[7, 0].n_leaves == 2 and nodes[7, 9000].n_children == 0
    assert nodes[7, 0].saved_tokens == sum(len(f"turn {t}") for t in range(5))


def test_no_rows(spark):
    turns = ct.numbered_turns(table(spark, [(None, 1, "user", "x")]))
    assert ct.trie(*ct.shared_openings(turns)).count() == 0


def test_the_sql_on_odd_rows(spark, tmp_path):
    rows = drawn(5)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(SQL["op13_conversation_trie"]).fetchall()) == brute(rebuilt(ordered(rows)))
    assert os.path.exists(f"{tmp_path}/conversations.parquet")
