"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Each shard scores each key; the key goes to the shard with the best score. A new shard adds one score and changes no other, so only
the rows that it wins move. Slots number the rows of a shard without gaps: rows are dealt to sub-ranges by a second hash, counts of
the sub-ranges are summed up, and rows are numbered inside their sub-range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm import common

#: Rows that one task numbers at a time, about.
SLOT_ROWS = 20_000


def unit(*columns: Column) -> Column:
    """A hash of the columns as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard from 0 that ``key`` goes to, each getting a share in proportion to its weight.

    The score is -ln(u)/weight, u hashed from key and shard number, and the least wins; equal scores go to the lower number. A null
    key hashes like any other value, so all rows without a key share a shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if len(set(weights)) == 1:  # with equal weights the order of the hashes is the order of the scores
        scores = [F.struct((-F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 1)).alias("score"), F.lit(k).alias("shard")) for k in range(len(weights))]
    else:
        scores = [F.struct((-F.ln(unit(key, F.lit(k))) / F.lit(float(w))).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights)]
    return F.least(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def numbered(rows: DataFrame, by: str, order: list[Column], name: str, total: int) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... inside each value of ``by``, in an order that hashing ``order`` fixes. ``total``: the
    number of rows, which sets how many sub-ranges there are; nothing larger than a sub-range is sorted in one task."""
    parts = max(1, -(-total // SLOT_ROWS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    sums = sums.select(by, "_part", (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    return rows.withColumn("_row", inside).join(sums, [by, "_part"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``docs(doc_id, text)``.

    size is the UTF-8 length plus 8, text_crc32 the unsigned CRC-32 of the UTF-8 text; a null text counts as empty for both. doc_id
    and the shards alone decide where a row goes, so rows that share a doc_id stay together; a null doc_id is a key like any other.
    grown_shard is the shard under ``grown``, by default one more shard of the last weight. Other columns are ignored.
    """
    key = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    grown = grown or [*weights, weights[-1]]
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"),
    )
    rows = common.staged(rows, "sharding-rows")
    ties = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return numbered(rows, "shard", ties, "slot", rows.count()).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
