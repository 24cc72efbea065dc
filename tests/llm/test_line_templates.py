import hashlib
import math
import random

from tessera.llm import common
from tessera.llm import line_templates as lt
from tessera.llm.queries import op2_line_templates

SCHEMA = "doc_id bigint, text string"


def brute(rows, min_docs=10, similarity=0.6, min_tokens=1, depth=3, long_tokens=20):
    docs_of, rows_of, leaves, keeper = {}, {}, {}, {}
    masked = lambda line: " ".join("<*>" if any(c in "0123456789" for c in t) else t for t in line.split())
    for i, text in rows:
        for m in {masked(line) for line in (text or "").split("\n")}:
            if m and len(m.split(" ")) >= min_tokens:
                docs_of.setdefault(m, set()).add(i)
                rows_of[m] = rows_of.get(m, 0) + 1
    for m in docs_of:
        parts = m.split(" ")
        leaves.setdefault((len(parts), tuple(parts[:depth])), []).append(m)
    gone = set()
    for (n, _), lines in leaves.items():
        usual = {}
        for m in lines:
            for at in enumerate(m.split(" ")):
                usual[at] = usual.get(at, 0) + rows_of[m]
        clusters = {}
        for m in lines:
            ranks = sorted((usual[at] for at in list(enumerate(m.split(" ")))[depth:]), reverse=True)
            need = math.ceil(round(similarity * n, 6)) - depth
            kept = tuple(at for at in list(enumerate(m.split(" ")))[depth:] if need > 0 and usual[at] >= ranks[need - 1]) if len(lines) > 1 else m
            clusters.setdefault(kept, []).append(m)
        for members in clusters.values():
            docs = set().union(*[docs_of[m] for m in members])
            if len(docs) >= min_docs:
                gone |= set(members)
            elif len(docs) > 1 and len(members[0].split(" ")) >= long_tokens:
                gone |= set(members)
                keeper |= dict.fromkeys(members, min(d for d in docs if d is not None))
    out = []
    for i, text in rows:
        lines = text.split("\n") if text else []
        kept = [x for x in lines if masked(x) not in gone or (i is not None and keeper.get(masked(x)) == i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def corpus():
    rnd, rows = random.Random(3), []
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta".split())
    for i in range(150):
        lines = [" ".join(word() for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 5))]
        lines.append(f"Posted by {rnd.choice(['ann', 'bob', 'cy'])} on page {i} of the site")
        if i % 12 == 0:
            lines += ["All rights reserved worldwide", "  All   rights reserved worldwide"]
        if i % 40 == 0:
            lines += ["only few documents say this"] * 3
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, "a b"), (504, "x " * 30_000), (None, "Posted by ann on page 7 of the site"), (3, rows[3][1])]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as line", "2 as leaf", "'t' as gone")
    want = brute(rows)
    assert sum(r[2] for r in want) > 150
    assert got(lt.drop_recurring(df)) == want
    assert got(lt.drop_recurring(df, max_bytes=-64)) == want  # joins instead of broadcasts
    assert lt.drop_recurring(df.limit(0)).count() == 0
    kept = {r.doc_id: r.kept for r in lt.drop_recurring(df, with_text=True).collect()}
    assert "All rights reserved" not in (kept[0] or "") and "only few documents say this" in kept[40]


def test_long_lines_stay_with_the_first_document_only(spark):
    rnd = random.Random(9)
    long = [" ".join(f"w{rnd.choice('abcdefgh')}{rnd.choice('klmnop')}" for _ in range(30)) for _ in range(6)]
    rows = [(i, f"{long[i % 6]}\nown {chr(97 + i)} line") for i in range(14)] + [(40, " ".join(["tail"] * 60) + "\nx"), (None, long[1]), (50, "Les.")]
    rows += [(60 + i, "Les.\nAnd ornd.") for i in range(12)]
    out = got(lt.drop_recurring(spark.createDataFrame(rows, SCHEMA)))
    assert out == brute(rows)
    dropped = {r[0]: r[2] for r in out}
    assert [dropped[i] for i in range(14)] == [0] * 6 + [1] * 8  # below ten documents: all but the first
    assert dropped[None] == 1 and dropped[40] == 0 and dropped[50] == 1 and dropped[60] == 2


def test_a_hidden_template_in_a_hot_leaf(spark, monkeypatch):
    """Unlike lines of one leaf stay, and the lines of a template among them go, whatever the number of either."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    for n in (30, 1000, 5000):
        rows = [(i, " ".join(["seen", "by", "user", *[word() for _ in range(7)]])) for i in range(n)]
        rows += [(10_000 + i, f"seen by user {word()} at gate {'north south east west'.split()[i % 4]} of the yard") for i in range(20)]
        out = got(lt.drop_recurring(spark.createDataFrame(rows, SCHEMA)))
        assert out == brute(rows)
        assert {r[0] for r in out if r[2]} == {10_000 + i for i in range(20)}
    monkeypatch.setattr(common, "HEAVY", 3)  # few usual tokens by broadcast, the others by a join
    assert got(lt.drop_recurring(spark.createDataFrame(rows, SCHEMA))) == out


def test_large_ids_beside_a_missing_one(spark):
    rows = [(2**60 + i, f"All rights reserved by the owners of the place\nown {'abcdefghijkl'[i]} line") for i in range(12)] + [(None, "x y z")]
    out = got(lt.drop_recurring(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    assert out == brute(rows) and {r[0] for r in out if r[2] == 1} == {2**60 + i for i in range(12)}
    long = " ".join(f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(2**60 + i, long) for i in range(5)] + [(None, "x")]
    out = got(lt.drop_recurring(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    assert out == brute(rows) and [r[0] for r in out if r[2] == 0 and r[0]] == [2**60]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op2_line_templates(spark, d)) == brute(rows)


def test_leaves_keep_their_depth_at_every_size(spark):
    names = [f"{a}{b}{c}" for a in "abcdefghijklmn" for b in "abcdefghijklmn" for c in "abcdefghijkl"]
    rows = [(i, f"Posted by user {name} on the site") for i, name in enumerate(names)]
    assert len(rows) > 2000
    out = got(lt.drop_recurring(spark.createDataFrame(rows, SCHEMA)))
    assert all(n_dropped == 1 for _, _, n_dropped, _ in out)  # one template, however many names it has
