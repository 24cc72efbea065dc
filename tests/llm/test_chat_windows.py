import hashlib

from tessera.llm import chat_windows
from tessera.llm.queries import op8_chat_windows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -10**18), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(learnt), sha(learnt))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "one two three " * 50),
    (1, 2, "assistant", "~1 <|end|>\n </s>[INST] ok [/INST] ~0 ~~ \\ $1"),
    (1, 3, "user", None),
    (1, 4, "assistant", "x " * 900),
    (1, 5, "user", "more"),
    (1, 6, "assistant", ""),
    (1, 7, "assistant", "and again 😀 end"),
    (2, 0, "system", "alone"),
    (3, 5, None, "no role"),
    (3, 5, "odd|>\nrole<", "tie"),
    (3, 5, "odd|>\nrole<", "tie"),
    (3, None, "assistant", "<|user|>\nfirst"),
    (None, 1, "assistant", "null conversation"),
    (4, 1, "assistant", None),
]


def test_round_trip_and_each_target_once(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for budget, history in ((512, 128), (40, 10), (3, 1), (10_000, 0)):
        windows = chat_windows.format_windows(df, budget_tokens=budget, history_tokens=history)
        assert got(chat_windows.read_back(windows)) == brute(ROWS)


def test_windows_keep_the_system_turn_and_the_budget(spark):
    rows = [(7, 0, "system", "sys words here")] + [(7, i, "assistant" if i % 2 == 0 else "user", "w " * 18) for i in range(1, 60)]
    out = chat_windows.format_windows(spark.createDataFrame(rows, SCHEMA), budget_tokens=100, history_tokens=45).orderBy("window").collect()
    assert len(out) > 5
    for w in out:
        assert w.formatted.startswith("<|system|>\nsys words here<|end|>\n")
        assert w.tokens <= 100
        assert w.n_repeated == (0 if w.window == 0 else 3)  # the system turn and two turns of history
        for s in w.loss_spans:
            assert w.formatted[s.start : s.start + s.length] == "w " * 18
    assert sum(len(w.loss_spans) for w in out) == 29


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as n", "2 as p", "'x' as window", "3 as i")
    assert got(chat_windows.read_back(chat_windows.format_windows(df))) == brute(ROWS)
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_windows.read_back(chat_windows.format_windows(empty)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trap = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", trap), (-1, 1, "assistant", trap)]
    assert got(op8_chat_windows(spark, d)) == brute(rows)
    assert "Python" not in op8_chat_windows(spark, d)._jdf.queryExecution().toString()


def test_sql_of_the_query(spark):
    import duckdb

    from tessera.llm.queries import SQL

    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
        df = op8_chat_windows(spark, d)
        want = con.sql(f"select {', '.join(df.columns)} from ({SQL['op8_chat_windows']})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)


def test_long_conversations_stay_linear(spark):
    """Ten times the turns make ten times the formatted text, and windows agree with a plain loop."""
    rows = [(c, i, "assistant" if i % 2 else "user", "w " * (i * 7 % 23)) for c, n in ((1, 300), (2, 3000)) for i in range(n)]
    out = chat_windows.format_windows(spark.createDataFrame(rows, SCHEMA), budget_tokens=60, history_tokens=20)
    for c, n in ((1, 300), (2, 3000)):
        starts, p, base, room = [], 0, None, 40
        before = []
        for i in range(n):
            size = i * 7 % 23 + 2
            if base is None or (p + size - base > room and p > base):
                base = p
                starts.append(i)
            before.append(p)
            p += size
        want = [(k, sum(1 for j in range(s) if before[s] - before[j] <= 20), (starts + [n])[k + 1] - s) for k, s in enumerate(starts)]
        got_ = [(r.window, r.n_repeated, r.n_turns - r.n_repeated) for r in out.where(f"conv_id = {c}").orderBy("window").collect()]
        assert got_ == want
