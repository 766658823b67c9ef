"""Queries of the corpus operators over the whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, language_id, near_duplicates, nearest, packing, passages, substrings, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("n_spans", F.size("spans")).drop("spans")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), payload="crc32")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array, op2_toxicity, op3_nearest, op4_language_id, op5_compact_windows, op6_packing, op7_byte_bpe, op8_warc, op9_minhash, op10_winnowing)}

ORACLE: dict[str, str] = {
    "op3_nearest": """
with sound as (
    select distinct vec_id, embedding::double[] as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
    from sound q join sound c on len(q.v) = len(c.v) and (q.vec_id <> c.vec_id or q.v <> c.v)
    where q.vec_id % 20 = 0
), ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
""",
    "op9_minhash": """
with recursive split_up as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from split_up
), sizes as (select doc_id, count(*) as n from shingles group by 1),
met as (select x.doc_id as a, y.doc_id as b, count(*) as common from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * common >= 80 * (p.n + q.n - common)),
edges as (select a, b from links union select b, a from links),
reached(u, v) as (select a, a from edges union select r.u, e.b from reached r join edges e on r.v = e.a),
least as (select u, min(v) as component from reached group by 1)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept
from documents d left join sizes using (doc_id) left join least on u = d.doc_id
""",
    "op8_warc": """
with full_pages as (select page_id, encode(coalesce(html, '')) as payload, octet_length(encode(coalesce(html, ''))) as n from pages),
best as (select payload, max(page_id) as best from full_pages group by payload),
bits as (
    select page_id, n, payload, sha1(payload) as hex from full_pages
)
select p.page_id, cast(p.n as bigint) as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + cast((((strpos('0123456789abcdef', p.hex[1 + (5 * i) // 4]) - 1) * 256
            + (strpos('0123456789abcdef', coalesce(nullif(p.hex[2 + (5 * i) // 4], ''), '0')) - 1) * 16
            + (strpos('0123456789abcdef', coalesce(nullif(p.hex[3 + (5 * i) // 4], ''), '0')) - 1))
            >> (7 - (5 * i) % 4)) & 31 as integer), 1)), 'string_agg', '') as payload_digest,
    case when b.best = p.page_id then 'response' else 'revisit' end as record_type,
    case when b.best <> p.page_id then b.best end as refers_to
from bits p join best b using (payload)
""",
}
