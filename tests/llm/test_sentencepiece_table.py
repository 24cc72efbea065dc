import hashlib
import random

import public_tokenizers
import sentencepiece

from tessera.llm import sentencepiece_table as st
from tessera.llm.queries import op9_sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", "▁", "a", "the", "é", "\n", "\t", "\x00", "😀", "ﬁ", "<s>", "\u3000", "日本", "\x1f", "ing", "<0x0A>", "한국"]


def whole(sp, text):
    ids = sp.encode(text or "")
    return ",".join(map(str, ids)), len(ids), sp.decode(ids)


def test_table_equals_the_library():
    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(3)
    table = st.ChunkTable(MODEL, max_chunks=50)
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))
        assert table.encode(text) == whole(sp, text)
    long = "word " * 50_000 + "x" * 20_000
    assert table.encode(long) == whole(sp, long)


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, " a  b "), (3, " a  b "), (None, "日本 x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' as id", "1 as n_tokens")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = st.encode_documents(df, MODEL).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        assert by[i].ids == sp.encode(text or "") and by[i].decoded == sp.decode(sp.encode(text or ""))
    assert st.encode_documents(df.limit(0), MODEL).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = op9_sentencepiece(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, n, back = whole(sp, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, sha(ids), sha(back))


def test_long_chunks_stay_out_of_the_table():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = st.ChunkTable(MODEL, max_chunks=5, max_chunk_chars=8)
    for text in ("a " + "long" * 300 + " b " + "long" * 300, "one two three four five six seven eight nine " + "x" * 9, "日本" * 500 + " " + "日本" * 500):
        assert table.encode(text) == whole(sp, text)
        assert max(map(len, table.table), default=0) <= 8


def test_full_table_keeps_the_chunks_met_since():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table, segment, met = st.ChunkTable(MODEL, max_chunks=8), st.ChunkTable._segment, []
    table._segment = lambda chunks: met.extend(chunks) or segment(table, chunks)
    for i in range(40):
        text = f"x steady new{i}"
        assert table.encode(text) == whole(sp, text)
        assert len(table.table) + len(table.older) <= 8
    assert met.count("▁steady") == 1 and len(met) == 41
