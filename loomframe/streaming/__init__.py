"""Files that arrive: every stateless transform works on a streaming DataFrame as it does on a table.

Backpressure is maxFilesPerTrigger; a stream's place is Spark's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def lines(spark: SparkSession, folder: str, skip_empty: bool = True, max_files: int = 16) -> DataFrame:
    """(input) bytes of the lines of text files that arrive in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumn("value", F.regexp_replace("value", "\r$", ""))
    rows = rows.where(F.col("value") != "") if skip_empty else rows
    return rows.select(F.encode("value", "UTF-8").alias("input"))


def table(spark: SparkSession, folder: str, schema: str, max_files: int = 16) -> DataFrame:
    """Rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def windowed(df: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, end, keys, count) of tumbling windows of event time; rows later than ``late`` are left out."""
    out = df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("count"))
    return out.select("window.start", "window.end", *keys, "count")


def run_once(df: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply ``step`` to all files that are there, append the rows as Parquet, and stop; a restart goes on after the last file."""
    query = step(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
