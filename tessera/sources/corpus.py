"""Source selection: licence and provenance filters, excerpts, seeded order, the pool and its cache rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.schemas import EXCERPT, RAW_SOURCE


def scan(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """A raw corpus in the declared shape; columns that it lacks are null.  JSON is read with the declared schema."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "json":
        return reader.schema(RAW_SOURCE).option("mode", "FAILFAST").json(path)
    if streaming:
        return shaped(reader.schema(spark.read.format(fmt).load(path).schema).format(fmt).load(path))
    return shaped(reader.format(fmt).load(path))


def shaped(raw: DataFrame) -> DataFrame:
    """Declared columns only.  Ids become text; a struct ``metadata`` becomes JSON text."""
    have = {f.name: f.dataType for f in raw.schema.fields}

    def column(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if isinstance(have[field.name], (T.StructType, T.MapType)):
            return F.to_json(field.name).alias(field.name)
        if field.name in ("id", "paper_id") and isinstance(have[field.name], T.NumericType):
            # a zero id counts as missing
            return F.when(F.col(field.name) != 0, F.col(field.name).cast("string")).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return raw.select(*[column(f) for f in RAW_SOURCE.fields], *[c for c in raw.columns if c not in RAW_SOURCE.names])


def license_raw() -> Column:
    meta = F.col("metadata")
    return tx.first_filled(tx.json_field(meta, "oa_license"), tx.json_field(meta, "license"), F.col("license"))


def order_key(seed: int, identity: Column) -> Column:
    """A seeded total order that any engine can repeat: md5 of ``seed:identity``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string")))


def scanned(raw: DataFrame, seed: int, max_scanned: int, identity: str) -> DataFrame:
    """The first ``max_scanned`` rows of the seeded order, with ``order_key``.

    Ranks narrow keys only: the texts are not sorted, and where nothing is cut off they are not touched.
    """
    keyed = raw.withColumn("order_key", order_key(seed, F.col(identity)))
    if raw.select(identity).limit(max_scanned + 1).count() <= max_scanned:
        return keyed
    last = keyed.select("order_key", identity).orderBy("order_key", identity).limit(max_scanned)
    edge = last.agg(F.max(F.struct("order_key", identity))).first()[0]
    same = (F.col("order_key") == edge[0]) & (F.col(identity) <= F.lit(edge[1]))
    return keyed.where((F.col("order_key") < edge[0]) | same)


def excerpts(raw: DataFrame, *, dataset: str, split: str, min_chars: int, max_chars: int, fallback: Column | None = None) -> DataFrame:
    """Qualifying rows as excerpt records (with the columns that ``raw`` has besides, such as order_key)."""
    meta = F.col("metadata")
    licence = license_raw()
    normal = tx.normalize_license(licence)
    rows = raw.where(tx.license_allowed(normal) & tx.source_allowed(F.col("source")))
    body = tx.excerpt(tx.first_filled(F.col("text"), F.col("raw_fulltext")), min_chars=min_chars, max_chars=max_chars)
    paper = tx.first_filled(F.col("id"), F.col("paper_id"), *([fallback] if fallback is not None else []))
    extra = [c for c in raw.columns if c not in RAW_SOURCE.names]
    return (
        rows.select("*", body.alias("source_text")).where("source_text is not null")
        .select(
            paper.alias("paper_id"),
            F.substring(tx.normalize_ws(tx.first_filled(tx.json_field(meta, "title"), F.col("title"), paper)), 1, 300).alias("title"),
            "source_text", F.lit(dataset).alias("source_dataset"), F.lit(split).alias("source_split"),
            tx.first_filled(tx.json_field(meta, "oa_url"), tx.json_field(meta, "url")).alias("source_url"),
            licence.alias("source_license"), normal.alias("source_license_normalized"), F.sha2("source_text", 256).alias("source_sha256"), *extra,
        )
    )


def first_qualifying(rows: DataFrame, order: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """Per paper the first row that qualifies; an earlier row that failed does not block it.

    An aggregate with a map-side part, so a paper with very many rows does not meet in one task.
    """
    names = rows.columns
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    best = rows.groupBy("paper_id").agg(F.min_by(F.struct(*[c for c in names if c != "paper_id"]), key).alias("_r"))
    return best.select("paper_id", *[F.col(f"_r.{c}").alias(c) for c in names if c != "paper_id"]).select(*names)


def source_pool(
    raw: DataFrame, *, identity: str, dataset: str = "corpus", split: str = "train", max_papers: int = 2500, max_scanned: int = 200_000,
    min_chars: int = 1200, max_chars: int = 6000, seed: int = 17, exclude: DataFrame | None = None,
) -> DataFrame:
    """The source pool: seeded scan, filters, excerpt, first row per paper, exclusion, limit."""
    rows = scanned(raw, seed, max_scanned, identity)
    fallback = F.concat(F.lit("row-"), F.col("stream_idx").cast("string")) if "stream_idx" in raw.columns else None
    rows = excerpts(rows, dataset=dataset, split=split, min_chars=min_chars, max_chars=max_chars, fallback=fallback)
    if exclude is not None:
        rows = rows.join(exclude.select("paper_id").distinct(), "paper_id", "left_anti")
    return first_qualifying(rows, ("order_key", identity)).orderBy("order_key", identity).limit(max_papers)


def cache_usable(pool: DataFrame, excluded: DataFrame, *, limit: int, dataset: str, split: str) -> DataFrame:
    """One row: does a cached pool hold exactly ``limit`` rows of this dataset and split, none excluded?"""
    same = F.col("source_dataset").eqNullSafe(dataset) & F.col("source_split").eqNullSafe(split)
    facts = pool.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))
    hit = pool.join(excluded.select("paper_id").distinct(), "paper_id", "left_semi").agg(F.count(F.lit(1)).alias("excluded"))
    return facts.crossJoin(hit).select(
        "n", "same", "excluded", ((F.col("n") == limit) & (F.col("same") == F.col("n")) & (F.col("excluded") == 0)).alias("usable")
    )


def pool_columns() -> list[str]:
    return EXCERPT.names
