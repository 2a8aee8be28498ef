"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, licenses, mixing, phrase_index, secret_scan, sharding, simhash, substrings, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("worst_sentence")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"), n_shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


OP5_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as vec
           from embeddings where vec_id is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and c.r <> q.r),
o as (select *, row_number() over (partition by r order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from o where n <= 20
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _ids_sha256(column: str):
    return F.sha2(F.array_join(F.array_sort(column), ","), 256)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), proximity=phrase_index.NEAR)
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        _ids_sha256("items").alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near"),
        _ids_sha256("near_items").alias("near_sha256"),
    )


OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select row_number() over () as b, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as p
       from b, unnest(range(1, len(w) - least(len(w), 13) + 2)) as t(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as p from d, sizes, unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n),
m as (select distinct r, i, dw.n, item_id from dw join bw on dw.p = bw.p and dw.n = bw.n),
h as (select r, count(distinct k) as n_hit from (select distinct r, i, n from m) as q, unnest(range(i, i + n)) as t(k) group by r),
it as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from m group by r),
places as (select r, unnest(w) as t, generate_subscripts(w, 1) as p from d),
counts as (select t, count(*) as n from places group by t),
rare as (select b, item_id, t, row_number() over (partition by b order by coalesce(n, 0), t) as k
         from (select distinct b, item_id, unnest(w) as t from b where item_id is not null) left join counts using (t)),
need as (select b, count(*) as c from rare where k <= 3 group by b),
seen as (select r, b, item_id, count(distinct t) over (partition by r, b order by p range between current row and 12 following) as n from places join rare using (t) where k <= 3),
nr as (select r, count(distinct item_id) as n_near, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from seen join need using (b) where n = c group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(it.s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       cast(coalesce(n_near, 0) as bigint) as n_near, sha256(coalesce(nr.s, '')) as near_sha256
from d left join h using (r) left join it using (r) left join nr using (r)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(_table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_license_scans, op4_sharding, op5_exact_topk, op6_simhash, op7_decontamination, op8_mixing, op9_secret_scans, op10_html_extraction)}
ORACLE = {"op5_exact_topk": OP5_SQL, "op7_decontamination": OP7_SQL}
