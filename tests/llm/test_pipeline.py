import importlib.util

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    import public_tokenizers
    import sentencepiece
    from test_exact_dedup import brute as brute_equal
    from test_ngram_join import brute as brute_near

    from tessera.llm import entropy_mix, toxicity
    from tessera.llm.common import load, materialize
    from tessera.llm.queries import toxicity_model

    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    docs = load(spark, D, "documents")
    columns = docs.columns
    steps = [f for _, f in cp.STAGES]
    text = {r.doc_id: r.text for r in docs.collect()}

    clean = materialize(steps[0](spark, docs, D))
    assert clean.columns == columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity_model(docs, load(spark, D, "labels"))).collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5} and 0 < len(kept) < len(text)

    single = materialize(steps[1](spark, clean, D))
    assert single.columns == columns
    ids = {r.doc_id for r in single.collect()}
    assert ids == {i for i, _, _, k, _ in brute_equal([(i, text[i]) for i in kept]) if k}

    far = materialize(steps[2](spark, single, D))
    assert far.columns == columns
    ids2 = {r.doc_id for r in far.collect()}
    near = brute_near([(i, text[i]) for i in sorted(ids)])
    assert ids2 == {i for i, (_, c) in near.items() if c == i}

    mixed = materialize(steps[3](spark, far, D))
    assert mixed.columns == columns
    copies = {r.doc_id: r.copies for r in entropy_mix.mix(far).collect()}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {i: c for i, c in copies.items() if c}

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(cp.MODEL))
    out = steps[4](spark, mixed, D).collect()
    assert len(out) == sum(counted.values())
    assert all(r.ids == sp.encode(text[r.doc_id]) for r in out)


def test_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", None), (None, "x y", "en", "s"), (4, "a  b c", "de", "t"), (5, "w " * 9000, "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as n_chars", "2 as digest", "3 as copies", "4 as rep")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, D)
        if name == "exact dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "5", "None"]
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, D)
    assert empty.count() == 0


def test_repeated_and_missing_ids_lose_no_text(spark):
    import corpus_pipeline as cp

    long = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    near = lambda k: long[k] + " more"
    rows = [(1, "aaa bbb"), (9, "aaa  bbb"), (9, "zzz"), (10, "zzz"), (None, "qq"), (None, "qq"), (None, "aaa bbb")]
    schema = "doc_id bigint, text string"
    frame = lambda rows: spark.createDataFrame([(i, t, "s") for i, t in rows], schema + ", source string")
    out = sorted((tuple(r)[:2] for r in cp.drop_copies(spark, frame(rows), D).collect()), key=str)
    assert out == sorted([(1, "aaa bbb"), (9, "zzz"), (None, "qq")], key=str)
    rows = [(5, long[0]), (5, long[1]), (7, near(0)), (3, near(1)), (None, long[2]), (None, near(3)), (8, long[3]), (None, ""), (4, "a b"), (4, "c d")]
    out = sorted((tuple(r)[:2] for r in cp.drop_near_copies(spark, frame(rows), D).collect()), key=str)
    assert out == sorted([(5, long[0]), (3, near(1)), (None, long[2]), (8, long[3]), (None, ""), (4, "a b"), (4, "c d")], key=str)
    mixed = cp.mix_sources(spark, frame(rows), D)
    assert mixed.columns == ["doc_id", "text", "source"]
    sizes, reach = [len(t.split()) for _, t in rows], 1
    for n in sizes:
        reach |= reach << n | reach << 2 * n
    off = lambda k: abs(k - 1.5 * sum(sizes))
    assert off(sum(len(r.text.split()) for r in mixed.collect())) <= min(off(k) for k in range(reach.bit_length()) if reach >> k & 1) + 0.5
