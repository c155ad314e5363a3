"""Small files in any store that Spark knows, written and read by the driver, or by tasks through Arrow's file systems."""

from __future__ import annotations

from pathlib import Path

from pyarrow import fs
from pyspark import SparkContext
from pyspark.sql import SparkSession

from loomframe.errors import SourceError


def _opened(path: str) -> tuple:
    if SparkContext._active_spark_context is None:
        raise SourceError(f"{path}: no Spark session")
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, spark


def write(path: str, data: bytes) -> None:
    """One file, from the driver; a file of that name is replaced."""
    store, at, _ = _opened(path)
    out = store.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read(path: str) -> bytes:
    """The bytes of one small file, in the driver."""
    store, at, spark = _opened(path)
    if not store.exists(at):
        raise SourceError(f"{path}: no such file")
    found = store.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(found))
    finally:
        found.close()


def folders(path: str) -> list[str]:
    """The sorted names of the folders right below ``path``."""
    store, at, _ = _opened(path)
    return sorted(s.getPath().getName() for s in store.listStatus(at) if s.isDirectory())


def write_from_task(path: str, data: bytes) -> None:
    """One file, from a task: written under another name and moved, so that a repeated task does no harm. ``path`` is a URI that Arrow
    knows (file, s3, gs, hdfs) or a path on a file system that all executors share."""
    if "://" not in path and not path.startswith("file:"):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        held = Path(f"{path}.{hash(data) & 0xFFFFFFFF:08x}.part")
        held.write_bytes(data)
        held.replace(path)
        return
    store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    held = f"{name}.{hash(data) & 0xFFFFFFFF:08x}.part"
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(held) as out:
        out.write(data)
    store.move(held, name)
