"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, decontaminate, mixing, neighbours, pii, repeats, secrets, sharding, simhash, toxicity
from .common import pick, shared_dir, table

TEXT = ("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), *TEXT)
    return repeats.remove_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.write_archive(pages, path)
    return archive.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), *TEXT)
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(pick(table(spark, sf_dir, "documents"), *TEXT))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), *TEXT)
    found = decontaminate.overlaps(docs, pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.select("doc_id", "item_id", "doc_start", "n_tokens", "n_equal")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(e.select(e["vec_id"].alias("id"), e["embedding"].alias("vec")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), *TEXT)
    return toxicity.score(docs, toxicity.train(docs, pick(table(spark, sf_dir, "labels"), "doc_id", "toxic")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(pick(table(spark, sf_dir, "documents"), *TEXT))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source")
    return mixing.mix(docs).withColumnRenamed("mix_source", "source")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "n_chars")
    out = sharding.shard(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_warc, op3_simhash, op4_secrets, op5_decontaminate, op6_ann, op7_toxicity, op8_pii, op9_mixing, op10_sharding)}

_DIGITS = " || ".join(f"substr('{archive.BASE32}', (((('0x' || substr(h || '0', {5 * j // 4 + 1}, 2))::INTEGER >> {3 - 5 * j % 4}) & 31)) + 1, 1)" for j in range(32))

ORACLES = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
        SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
}
