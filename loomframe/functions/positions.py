"""Dense positions without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where none is set, a local folder serves a local master
    (tests); on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidArgument("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomframe-")
        sc.setCheckpointDir(found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that it is made once and outlives any executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/loomframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order``, which should be unique.

    The rows are sorted by ranges, numbered inside each range, and shifted by the number of rows in the ranges before. The sorted rows
    are staged, so the numbers never change; the only table that is broadcast has one row for each range.
    """
    rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows, "positions")
    part = F.shiftrightunsigned("_at", 33)
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, pairs = 0, []
    for p in sorted(sizes):
        pairs.append((p, before))
        before += sizes[p]
    shift = df.sparkSession.createDataFrame(pairs, "_part long, _before long")
    out = rows.withColumn("_part", part).join(F.broadcast(shift), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def file_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Positions of rows in Parquet files, in the order of the files' names and the rows in them; no shuffle."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted((r.f, r.n) for r in rows.groupBy(F.col("_file").alias("f")).agg(F.count("*").alias("n")).collect())
    before, pairs = 0, []
    for f, n in sizes:
        pairs.append((f, before))
        before += n
    shift = df.sparkSession.createDataFrame(pairs, "_file string, _before long")
    return rows.join(F.broadcast(shift), "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def hash_index(df: DataFrame, order: Column, *ties: str, by: list[str] | None = None, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of a hexadecimal hash, inside each value of ``by`` if given.

    The first three digits of the hash deal the rows to 4096 ranges. Ranges are counted, the counts summed up, and rows numbered
    inside their range alone; so a class that holds most rows is still numbered by thousands of tasks.
    """
    by = by or []
    rows = df.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, 3))
    sums = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by, F.lit(0)).orderBy("_range")) - F.col("_n")
    sums = sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_r"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_order", *ties))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.withColumn("_row", inside).join(sums, same)
    return out.withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_order", "_range", "_row", "_r", "_before", *(f"_by_{c}" for c in by))


def scan_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Positions of a file scan: files by name, rows as they stand in the file. The scan is staged once; one row for each split
    comes to the driver."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    rows = staged(rows, "scan")
    cells = rows.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).collect()
    before, pairs = 0, []
    for c in sorted(cells, key=lambda c: (c["_file"], c["_start"])):
        pairs.append((c["_file"], c["_start"], before - c["_first"]))
        before += c.n
    shift = df.sparkSession.createDataFrame(pairs, "_file string, _start long, _shift long")
    return rows.join(F.broadcast(shift), ["_file", "_start"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_file", "_start", "_at", "_shift")
