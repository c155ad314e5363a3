"""One query for each corpus operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import chat, decontam, html, licenses, mixing, neardup, quality, rules, sharding, toxicity

MIX_WEIGHTS = [5.0, 2.0, 1.0]
SHARD_WEIGHTS = [1.0] * 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(_table(spark, sf_dir, "conversations"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), SHARD_WEIGHTS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_perspectives, op2_mixing, op3_rendezvous_sharding, op4_quality_classifier, op5_decontamination,
        op6_quality_rules, op7_minhash_near_dedup, op8_html_extraction, op9_license_scan, op10_toxicity,
    )
}
#: The others hash by xxhash64, fit or parse, which DuckDB has no words for; tests hold them against brute force or held-out labels.
ORACLE: dict[str, str] = {"op1_chat_perspectives": chat.SQL, "op5_decontamination": decontam.SQL, "op6_quality_rules": rules.SQL, "op7_minhash_near_dedup": neardup.SQL, "op9_license_scan": licenses.sql()}
