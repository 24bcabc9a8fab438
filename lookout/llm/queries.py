"""One query per operator over its whole table: ``name(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.llm import (conversations, decontaminate, divergence, importance, langid, licenses, mixing, quality,
                         secrets, sharding, simhash, substrings, warc)
from lookout.llm.common import word_count
from lookout.llm.oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_read(spark, sf_dir, "documents")).drop("text", "text_hash")


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.collapse(_read(spark, sf_dir, "conversations"))
    return conversations.conversations(conversations.render(turns)).withColumnRenamed("conv", "conv_id")


def op3_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), word_count(F.col("text"))) \
        .select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents")).select(
        "doc_id", "at", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("value_digest"),
        F.round("score", 6).alias("score"), "is_secret")


def op5_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return sharding.shard(docs, sharding.document_dims(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"),
        F.lit(None).cast("int").alias("grown_shard"))


def op6_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(_read(spark, sf_dir, "pages"))
    return warc.read_records(spark, path, payload=False) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")) \
        .groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), "doc_id", "text") \
        .select("doc_id", "fingerprint", "component_id")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs, fold != 0)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score",
        F.array_join(F.transform(F.map_entries("languages"),
                                 lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.4f", e["value"]))), " ")
        .alias("languages"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), licenses.known_licenses(spark)).select(
        "doc_id", "digest", "license_id", F.array_join("notices", " ").alias("notices"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


QUERIES = {q.__name__: q for q in (
    op1_line_frequency_rules, op2_snapshot_collapse, op3_mix_to_weights, op4_secret_forest, op5_kd_tree_shards,
    op6_seekable_warc, op7_spaced_seed_overlaps, op8_simhash_components, op9_language_mixture, op10_license_digests,
    op11_source_divergence, op12_importance_resampling, op13_substring_dedup)}
