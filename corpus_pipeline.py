"""A corpus pipeline over the documents table, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's documents.  All but the last return the columns of documents, extra ones included, whatever their names.

In every stage a null text counts as empty, texts of any length are read whole, and an empty table gives an empty one; a repeated
row (same id, equal text) is one document after exact dedup.  What else a stage does with nulls and ties stands with its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import entropy_mix, exact_dedup, ngram_join, sentencepiece_table, toxicity
from tessera.llm.common import load, materialize
from tessera.llm.queries import toxicity_model

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic (score below 0.5).

    Rows without an id are scored like all others; empty texts have the score of the bias; without labels of both kinds the
    base rate decides for all; equal texts have equal scores, so copies stay or go together.
    """
    model = toxicity_model(docs, load(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(spark, model, F.col("text")) < 0.5)


ROW, SHA = "_tessera_row", "_tessera_sha"


def _by_id(docs: DataFrame) -> bool:
    """True where every document has an id of its own, so that ids can name rows."""
    n, distinct = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    return n == distinct


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number each; numbers stay as they are written."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select(F.col("doc_id").alias(ROW)), docs["doc_id"] == F.col(ROW), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id; white space counts as in the operator.

    Where ids repeat or are missing, texts decide: of a group the row with the smallest id stays, or one without an id where none
    has one, once; an id that stands for several texts keeps those that are its own.
    """
    groups = materialize(exact_dedup.exact_dedup(docs))
    if _by_id(groups):
        return _without(docs, groups.where("not kept"))
    named = docs.withColumn(SHA, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    stay = groups.where("kept").select(F.col("doc_id").alias(ROW), "text_sha256").distinct()
    kept = named.join(stay, named["doc_id"].eqNullSafe(stay[ROW]) & (named[SHA] == stay["text_sha256"]), "left_semi")
    return kept.dropDuplicates(["doc_id", SHA]).drop(SHA)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id.

    Documents without words link with nothing and stay; where ids repeat or are missing every row is a document, and a row
    without an id stays only where its group has none with one; ties of equal similarity do not matter, for groups are all
    that is reachable by links.
    """
    if _by_id(docs):
        return _without(docs, ngram_join.near_duplicates(docs).where("component_id <> doc_id"))
    rows = _numbered(docs)
    groups = ngram_join.near_duplicates(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", ROW))
    stay = rows.select(ROW, "doc_id").join(groups, ROW).groupBy("component_id").agg(first.alias("m")).select(f"m.{ROW}")
    return rows.join(stay, ROW, "left_semi").drop(ROW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, none to two.

    Documents without words are never taken; a null source is a source of its own; rows without an id, or with a
    repeated one, are documents of their own.
    """
    rows, name = (docs, "doc_id") if _by_id(docs) else (_numbered(docs), ROW)
    taken = entropy_mix.mix(rows, id_col=name).where("copies > 0").select(F.col("doc_id").alias("_tessera_id"), F.col("copies").alias("_tessera_copies"))
    met = rows.join(taken, rows[name] == F.col("_tessera_id"))
    return met.withColumn("_tessera_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_tessera_copies"))).select(*[rows[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every row of the mix, repeated rows and rows without an id included."""
    return sentencepiece_table.encode_documents(docs, public_tokenizers.path(MODEL)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]

#: A trained classifier, entropy-balanced rates and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
