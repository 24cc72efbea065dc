"""Ids beyond 2^53 beside a missing one, in one batch, through every operator and every stage of the pipeline."""

import importlib.util
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    chat_windows, conversation_trie, entropy_mix, exact_dedup, exponion, host_reputation, image_copies, line_templates, ngram_join, packing, sentencepiece_table,
    suffix_dedup, toxicity,
)

BIG = [2**60 + k for k in (1, 3, 5, 8, 13)]
IDS = [*BIG, None]


@pytest.fixture
def docs(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * 3 for _ in range(30)) for _ in IDS]
    texts[3] = texts[1]
    rows = [(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(zip(IDS, texts))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, k % 2) for k, i in enumerate(BIG)], "doc_id bigint, label int")


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=str)


WHOLE = sorted(IDS, key=str)


def test_operators_on_documents(spark, docs, labels):
    assert ids(line_templates.drop_recurring(docs)) == WHOLE
    assert ids(toxicity.score(docs, toxicity.fit(docs, labels))) == WHOLE
    kept = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == WHOLE and {r.doc_id for r in kept if r.n_removed == r.n_bytes} == {BIG[3]}
    groups = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert sorted(groups, key=str) == WHOLE and groups[BIG[3]].keep_id == BIG[1]
    near = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert sorted(near, key=str) == WHOLE and near[BIG[3]] == BIG[1]
    mixed = entropy_mix.mix(docs)
    assert ids(mixed) == WHOLE and mixed.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert ids(sentencepiece_table.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))) == WHOLE
    assert ids(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).where("start = 0")) == WHOLE


def test_other_operators(spark, docs):
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(*[F.lit(float(k)) for k in range(4)]).alias("embedding"))
    assert ids(exponion.cluster(vectors, dims=4), "vec_id") == WHOLE
    pictures = image_copies.draw(vectors.select(F.col("vec_id").alias("id"), "embedding").withColumnRenamed("embedding", "of"))
    assert ids(pictures, "id") == WHOLE
    assert ids(image_copies.find_copies(pictures, F.col("id") == BIG[0]), "id") == WHOLE
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    got = ids(chat_windows.read_back(chat_windows.format_windows(turns)), "conv_id")
    assert [i for i in got if i is not None] == [i for i in WHOLE if i is not None]
    nodes = conversation_trie.trie(*conversation_trie.as_they_are(conversation_trie.numbered_turns(turns)))
    assert {r.conv_id for r in nodes.where("depth = 1").collect()} == {*BIG} - {BIG[3]}  # a row without a conversation belongs to none
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b.com/x").alias("url"))
    none = spark.createDataFrame([], "key bigint, bad int")
    assert ids(host_reputation.filter_urls(pages, none, (), outcome_key=F.lit(None).cast("long")), "page_id") == WHOLE


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline as cp

    labels.select("doc_id", F.col("label").alias("toxic"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in cp.STAGES:
        at = stage(spark, at, str(tmp_path))
        got = {r.doc_id for r in at.select("doc_id").collect()}
        assert got and got <= set(IDS), name
