"""Queries over the source pool and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import journal
from tessera.plans.adapters import EXCLUDED, adapted, cte, excluded, spark_table
from tessera.plans.registry import query
from tessera.sources import corpus

ALLOWED = ", ".join(f"'{x}'" for x in tx.ALLOWED_LICENSES)
WS = r"regexp_replace({}, '\s+', ' ', 'g')"
SEED, POOL, MIN, MAX = 17, 50, 1200, 6000
META = "case when json_valid(metadata) and json_type(metadata) = 'OBJECT' then metadata end"
FIELD = "json_extract_string({meta}, '$.{key}')"
LICENSE = f"coalesce(nullif({FIELD.format(meta=META, key='oa_license')}, ''), nullif({FIELD.format(meta=META, key='license')}, ''), nullif(license, ''), '')"

#: paragraphs of a text with a running sum, and the excerpt they give
EXCERPT = f"""
paragraphs as (
  select doc_id, pos, trim({WS.format('p')}) as p
  from (select doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) as pos from raw_source)
),
kept as (
  select doc_id, pos, p, row_number() over w as rn, sum(length(p) + 2) over w as total
  from paragraphs where length(p) >= 80 window w as (partition by doc_id order by pos)
),
excerpt as (
  select doc_id, string_agg(p, chr(10) || chr(10) order by pos) as source_text from kept where rn = 1 or total <= {MAX} group by doc_id
)"""
QUALIFIED = f"""
{cte('raw_source')}, {EXCERPT},
licensed as (select *, {LICENSE} as source_license from raw_source),
qualified as (
  select coalesce(nullif(id, ''), nullif(paper_id, ''), '') as paper_id, source_text, source_license,
         regexp_replace(upper(source_license), '[^A-Z0-9]', '', 'g') as source_license_normalized, md5('{SEED}:' || cast(doc_id as varchar)) as order_key, doc_id,
         title, {FIELD.format(meta=META, key='title')} as mt, {FIELD.format(meta=META, key='oa_url')} as ou, {FIELD.format(meta=META, key='url')} as mu
  from licensed join excerpt using (doc_id)
  where regexp_replace(upper(source_license), '[^A-Z0-9]', '', 'g') in ({ALLOWED}) and (source = '' or lower(source) like '%s2orc%') and length(source_text) >= {MIN}
),
firsts as (select * from qualified qualify row_number() over (partition by paper_id order by order_key, doc_id) = 1)"""
POOL_SQL = f"""
{QUALIFIED},
pool as (
  select paper_id, substr(trim({WS.format("coalesce(nullif(mt, ''), nullif(title, ''), paper_id)")}), 1, 300) as title, source_text, 'corpus' as source_dataset, 'train' as source_split,
         coalesce(nullif(ou, ''), nullif(mu, ''), '') as source_url, source_license, source_license_normalized, sha256(source_text) as source_sha256, order_key, doc_id
  from firsts order by order_key, doc_id limit {POOL}
)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, "raw_source")


def pool(spark: SparkSession, sf_dir: str, n: int = POOL) -> DataFrame:
    return corpus.source_pool(raw(spark, sf_dir), identity="doc_id", max_papers=n, min_chars=MIN, max_chars=MAX, seed=SEED)


@query(f"with {POOL_SQL} select * exclude (order_key, doc_id) from pool")
def source_pool(spark, sf_dir):
    return pool(spark, sf_dir).select(*corpus.pool_columns())


@query(f"with {cte('raw_source')}, l as (select doc_id, regexp_replace(upper({LICENSE}), '[^A-Z0-9]', '', 'g') as license from raw_source) select * from l where license in ({ALLOWED})")
def license_filter(spark, sf_dir):
    rows = raw(spark, sf_dir).select("doc_id", tx.normalize_license(corpus.license_raw()).alias("license"))
    return rows.where(tx.license_allowed(F.col("license")))


@query(f"with {cte('raw_source')} select doc_id, source from raw_source where source = '' or lower(source) like '%s2orc%'")
def source_filter(spark, sf_dir):
    return raw(spark, sf_dir).where(tx.source_allowed(F.col("source"))).select("doc_id", "source")


@query(f"with {cte('raw_source')}, {EXCERPT} select doc_id, source_text from excerpt where length(source_text) >= {MIN}")
def source_excerpt(spark, sf_dir):
    body = tx.excerpt(F.col("text"), min_chars=MIN, max_chars=MAX)
    return raw(spark, sf_dir).select("doc_id", body.alias("source_text")).where("source_text is not null")


@query(f"select doc_id, md5('{SEED}:' || cast(doc_id as varchar)) as order_key from documents order by order_key, doc_id limit 200")
def seeded_shuffle(spark, sf_dir):
    return corpus.scanned(raw(spark, sf_dir), SEED, 200, "doc_id").select("doc_id", "order_key")


@query(f"with {QUALIFIED} select paper_id, doc_id, sha256(source_text) as source_sha256 from firsts")
def first_qualifying(spark, sf_dir):
    rows = corpus.scanned(raw(spark, sf_dir), SEED, 10**9, "doc_id")
    rows = corpus.excerpts(rows, dataset="corpus", split="train", min_chars=MIN, max_chars=MAX)
    return corpus.first_qualifying(rows, ("order_key", "doc_id")).select("paper_id", "doc_id", "source_sha256")


@query(
    f"with {POOL_SQL}, {EXCLUDED} select count(*) as n, count(*) filter (source_dataset = 'corpus' and source_split = 'train') as same,"
    f" count(*) filter (paper_id in (select paper_id from excluded)) as excluded,"
    f" count(*) = {POOL} and count(*) filter (source_dataset = 'corpus' and source_split = 'train') = count(*) and count(*) filter (paper_id in (select paper_id from excluded)) = 0 as usable from pool"
)
def pool_cache_usable(spark, sf_dir):
    return corpus.cache_usable(pool(spark, sf_dir), excluded(spark, sf_dir), limit=POOL, dataset="corpus", split="train")


@query(f"with {QUALIFIED}, {EXCLUDED} select paper_id, doc_id from firsts where paper_id not in (select paper_id from excluded)")
def exclude_papers(spark, sf_dir):
    return journal.exclude(first_qualifying(spark, sf_dir), excluded(spark, sf_dir)).select("paper_id", "doc_id")


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def normalize_ws(spark, sf_dir):
    return spark_table(spark, sf_dir, "documents").select("doc_id", tx.normalize_ws(F.col("text")).alias("text"))


@query(f"with {cte('raw_source')} select doc_id, regexp_replace(upper(license), '[^A-Z0-9]', '', 'g') as license from raw_source")
def license_norm(spark, sf_dir):
    return raw(spark, sf_dir).select("doc_id", tx.normalize_license(F.col("license")).alias("license"))


@query(f"with {cte('raw_source')} select doc_id, {FIELD.format(meta=META, key='oa_license')} as oa_license, {FIELD.format(meta=META, key='oa_url')} as oa_url from raw_source")
def metadata_json(spark, sf_dir):
    meta = F.col("metadata")
    return raw(spark, sf_dir).select("doc_id", tx.json_field(meta, "oa_license").alias("oa_license"), tx.json_field(meta, "oa_url").alias("oa_url"))


@query(f"with {cte('raw_source')} select doc_id, {LICENSE} as license, coalesce(nullif(source, ''), nullif(title, ''), '') as label from raw_source")
def falsy_coalesce(spark, sf_dir):
    return raw(spark, sf_dir).select("doc_id", corpus.license_raw().alias("license"), tx.first_filled(F.col("source"), F.col("title")).alias("label"))


@query(f"with {QUALIFIED} select source_license, count(*) as n from firsts group by 1 order by n desc, source_license limit 12")
def license_provenance(spark, sf_dir):
    from tessera.operators import audit

    rows = corpus.excerpts(corpus.scanned(raw(spark, sf_dir), SEED, 10**9, "doc_id"), dataset="corpus", split="train", min_chars=MIN, max_chars=MAX)
    return audit.license_provenance(corpus.first_qualifying(rows, ("order_key", "doc_id")))
