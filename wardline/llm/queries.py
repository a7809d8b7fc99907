"""Registered queries of this folder, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import chat, decontamination, infill, language, licenses, lines, merkle, minhash, mixing, phrases, quality, secrets
from wardline.llm.oracles import ORACLES  # noqa: F401 - read by __spark_entry__.py

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language.identify_languages(documents, language.learn_languages(documents))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality.judge_quality(documents, quality.rule_model(documents, table(spark, folder, "labels")))


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality.score_quality(documents, quality.classifier_model(documents, table(spark, folder, "labels")))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair_roles(table(spark, folder, "conversations"))


@query
def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))  # the digest's own rule; keep_one_of_each keeps one row
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return licenses.scan_licenses(documents, licenses.train(licenses.prose_sample(documents)))


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(table(spark, folder, "documents"))


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.judge_lines(table(spark, folder, "documents"))


@query
def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op11_phrase_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.edited_neighbours(table(spark, folder, "documents"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = documents.select(
        "doc_id", "lang", merkle.document_leaf(F.col("text")).alias("leaf"),
        F.when(tampered, merkle.document_leaf(F.translate("text", upper, lower))).alias("_claimed"),
    )
    found = merkle.manifest(leaves, "lang", ["doc_id"])
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("_claimed", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
