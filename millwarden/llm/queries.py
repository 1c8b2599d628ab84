"""The operators over the driver tables, one query each, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwarden.llm import alignment, bitplanes, conversations, fingerprints, licences, neardup, packing, quality, sharding, templates, tokencount, toxicity, warc
from millwarden.session import cut_lineage, scratch_path

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_quality_rules", quality.oracle())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = cut_lineage(quality.measured(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "measures"))
    done = quality.rate(rated, quality.fit_rules(rated))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return done.select("doc_id", *(F.col(f"measures.{c}").alias(c) for c in columns), "base_failed", "kept")


@query("op2_packing")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query("op3_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query("op4_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@query("op5_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query("op6_warc", """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    # A response is measured by the payload that was read, a revisit by what its headers say of the payload it stands for.
    body = F.col("payload")
    return warc.read_warc(spark, folder).select(
        warc.page_key("record_id").alias("page_id"), F.coalesce(F.octet_length(body).cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha2(body, 256), "payload_digest").alias("payload_digest"), "record_type", warc.page_key("refers_to").alias("refers_to"))


@query("op7_token_planes")
def token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.read_ids(bitplanes.write_ids(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


@query("op8_sharding", sharding.oracle())
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


@query("op9_licences", licences.oracle())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir), licences.known_licences(spark))


@query("op10_decontamination", templates.oracle())
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaking_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op11_fingerprints", fingerprints.oracle())
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


@query("op12_conversations")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(damaged, present="present")


@query("op13_alignment")
def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
