"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Near duplicates are told apart row by row, so of repeated rows with words one stays, with or without doc_id. The next two stages know a
row by its doc_id and the digest of its text: no hash stands for a doc_id, and rows that share a doc_id but not a text are judged apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import common, decontam, mixing, neardup, queries, rules, sharding


#: Two documents of one group share so many per cent of their 5-word shingles, directly or by others.
NEAR_PERCENT = 80


def _key() -> Column:
    """doc_id and digest of the text as one string; null for both is its own key."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("string")), F.lit("null")))


def _held(docs: DataFrame) -> DataFrame:
    """(_key, _row): whole rows beside their keys, so that no column of ``docs`` can clash."""
    return docs.select(_key().alias("_key"), F.struct("*").alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what any quality rule rejects."""
    return rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group keep one row, that of the smallest doc_id; rows without doc_id come last. Of rows that share it the
    one with the least hash stays, and rows that are equal throughout are told apart by a number of their own."""
    rows = common.staged(docs.select(F.monotonically_increasing_id().alias("_n"), F.struct("*").alias("_row")), "pipeline-numbered")
    found = neardup.groups(rows.select(F.col("_n").alias("doc_id"), F.col("_row.text").alias("text")), NEAR_PERCENT)
    doc_id = F.col("_row.doc_id").cast("long")
    order = rows.select("_n", F.struct(doc_id.isNull().alias("unnamed"), doc_id.alias("doc_id"), F.xxhash64("_row").alias("hash"), "_n").alias("_order"))
    first = found.join(order, F.col("doc_id") == F.col("_n")).groupBy("component_id").agg(F.min("_order").alias("_order"))
    return rows.join(first.select("_order._n"), "_n", "left_semi").select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a passage of the benchmark: 13 consecutive words of an item, or a shorter item whole."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=_key())
    return _held(docs).join(found.where("n_hit > 0").select(F.col("doc_id").alias("_key")), "_key", "left_anti").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources asks for: not at all, once, or up to three times."""
    plan = mixing.mix(docs, queries.MIX_WEIGHTS, key=_key())
    plan = plan.groupBy(F.col("doc_id").alias("_key"), F.col("source").alias("_source")).agg(F.max("repeats").alias("_repeats")).where("_repeats > 0")
    rows = _held(docs).withColumn("_source", F.coalesce(F.col("_row.source").cast("string"), F.lit("")))
    return rows.join(plan, ["_key", "_source"]).select("_row", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into a shard and number the rows of each."""
    return sharding.assign(docs, queries.SHARD_WEIGHTS)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: The mix goes by xxhash64 and cuts ranges of it, which DuckDB lacks; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
