"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, lm_score, mixing, quality, simhash, token_store, toxicity, warc_audit
from .common import materialize, scratch, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a copy of all pages' records in which every 97th page is damaged and every 89th missing."""
    pages = table(spark, sf_dir, "pages")
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    damaged = F.when(page % 97 == 5, F.concat(F.left(html, F.length(html) - 1), F.lit("~"))).otherwise(html)
    record = warc_audit.record_bytes(page, F.col("url"), html)
    copy = F.when(F.coalesce(page % 89 == 7, F.lit(False)), F.lit(None)).otherwise(warc_audit.digest(warc_audit.record_bytes(page, F.col("url"), damaged)))
    records = pages.select("page_id", F.octet_length(record).cast("long").alias("length"), warc_audit.digest(record).alias("digest"), copy.alias("copy"))
    placed = materialize(warc_audit.laid_out(records, [page.asc_nulls_last(), F.col("digest")]))
    original = placed.select("archive", "offset", "length", "digest")
    replica = placed.where("copy is not null").select("archive", "offset", "length", F.col("copy").alias("digest"))
    found = warc_audit.audit(original, replica).select("archive", "offset", "finding")
    joined = placed.join(found, ["archive", "offset"], "left")
    return joined.select("page_id", "archive", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("finding", F.lit("sound")).alias("finding"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path("byte_bpe_50k.json")
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = scratch(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, path or tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.read_checksums(spark, folder)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
"""


OP2_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(html, '') AS body,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
         || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html'
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head
  FROM pages
), d AS (
  SELECT page_id, head || body || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM r
), p AS (
  SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS record_sha256,
         CAST(coalesce(sum(strlen(record)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
  FROM d
)
SELECT page_id, position // 67108864 AS archive,
       position - min(position) OVER (PARTITION BY position // 67108864) AS offset, length, record_sha256,
       CASE WHEN page_id % 89 = 7 THEN 'missing' WHEN page_id % 97 = 5 THEN 'damaged' ELSE 'sound' END AS finding
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_warc_fixity, op3_simhash_near_dedup, op4_bpe_round_trip, op5_token_store, op6_license_scan, op7_mix_sources, op8_quality_rules, op9_toxicity, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": OP2_SQL, "op10_exact_dedup": OP10_SQL}
