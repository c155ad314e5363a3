"""Row sources with positions: CSV, JSON arrays, text lines, Parquet, SQLite, memory and Python functions.

Each returns rows with ``idx``; sources of numbers have ``input`` (an array) and ``label``, which is the position where none is named.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable, Iterator
from dataclasses import fields, is_dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

from loomframe.errors import InvalidArgument, SourceError
from loomframe.functions.positions import file_index, scan_index
from loomframe.operators import algebra

NA_VALUES = ("", "NA", "NaN", "null", "NULL")


def _number(text: Column) -> Column:
    """A cell as a double; null if it is none. Spaces around it are allowed."""
    return F.trim(text).try_cast("double")


def csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", label: str | None = None, label_index: int | None = None, comment: str | None = None, errors: str = "raise", na: str = "error", dtype: str = "float", multiline: bool | None = None) -> DataFrame:
    """(idx, input, label) of a CSV file whose cells are numbers; the label is a column by number, by name, or the last.

    Quotes as in RFC 4180, CRLF, a byte order mark, comment lines and blank lines are handled. A record with another number of cells
    or a cell that is no number is an error, or with ``errors="skip"`` is left out. ``na="null"`` reads missing marks as null.
    Files are split among tasks unless a quoted cell holds a line break: ``multiline`` says so, or one scan for lines with an odd
    number of quotes finds it out.
    """
    if errors not in ("raise", "skip") or na not in ("error", "null"):
        raise InvalidArgument("csv: errors is raise or skip, na is error or null")
    if multiline is None:
        multiline = bool(spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).count())
    reader = spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multiline).option("header", header).option("ignoreLeadingWhiteSpace", False).option("emptyValue", "").option("nullValue", "\x00")
    reader = reader.option("comment", comment) if comment else reader
    names = [c.lstrip("﻿") for c in reader.csv(path).columns]
    names = names if header else [f"col{k}" for k in range(len(names))]
    if len(names) < 2:
        raise SourceError(f"{path}: fewer than two columns")
    if label_index is not None and not 0 <= label_index < len(names) or label is not None and label not in names:
        raise InvalidArgument(f"{path}: no label column {label if label_index is None else label_index}")
    at = label_index if label_index is not None else names.index(label) if label is not None else len(names) - 1
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField("_bad", T.StringType())])
    rows = scan_index(reader.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path), "_at_file")
    lacking = lambda k: F.lit(na == "null") & F.trim(F.coalesce(F.col(f"c{k}"), F.lit(""))).isin(*NA_VALUES)  # noqa: E731  an empty cell is read as null
    cell = lambda k: F.when(lacking(k), F.lit(None)).otherwise(_number(F.col(f"c{k}")))
    broken = F.col("_bad").isNotNull()
    for k in range(len(names)):
        broken = broken | (~lacking(k) & _number(F.col(f"c{k}")).isNull())
    if errors == "skip":
        rows = rows.where(~broken)
    elif bad := rows.where(broken).orderBy("_at_file").limit(1).collect():
        cells = [bad[0][f"c{k}"] for k in range(len(names))]
        wrong = next((c for c in cells if c is None or not _is_number(c)), bad[0]["_bad"])
        raise SourceError(f"{path}: record {bad[0]['_at_file']}: {wrong!r} is not {dtype}")
    values = F.array(*(cell(k).cast(dtype) for k in range(len(names)) if k != at))
    out = rows.select(F.col("_at_file").alias("idx"), values.alias("input"), cell(at).cast(dtype).alias("label"))
    return algebra.filtered(out, F.lit(True), renumber=True) if errors == "skip" else out


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def jsonl_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(idx, input, label) of lines that are arrays of numbers, of one width of at least two; the last number is the label."""
    rows = scan_index(spark.read.text(path).where("length(trim(value)) > 0"))
    rows = rows.withColumn("a", F.from_json("value", "array<double>"))
    widths = rows.groupBy(F.coalesce(F.size("a"), F.lit(-1)).alias("n")).count().collect()
    if len(widths) > 1 or widths and widths[0].n < 2:
        raise SourceError(f"{path}: lines must be arrays of one width of at least two")
    return rows.select("idx", F.slice("a", F.lit(1), F.size("a") - 1).alias("input"), F.element_at("a", -1).alias("label"))


def text_lines(spark: SparkSession, path: str, skip_empty: bool = True, max_length: int | None = None) -> DataFrame:
    """(idx, input, label): the bytes of each line, cut after ``max_length`` bytes; the label is the position among kept lines."""
    rows = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    rows = rows.where(F.col("value") != "") if skip_empty else rows
    line = F.encode("value", "UTF-8")
    rows = scan_index(rows)
    return rows.select("idx", (F.substring(line, 1, max_length) if max_length is not None else line).alias("input"), F.col("idx").alias("label"))


def parquet(spark: SparkSession, path: str, columns: str | list[str] | None = None, label: str | None = None, metadata: tuple[str, ...] = (), extras: tuple[str, ...] = (), predicates: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """(idx, input, label, each metadata and extra column) of Parquet files. Predicates and columns are pushed into the scan.

    One input column stays as it is; several are joined to one array in their order. Times become their integers, null floats NaN,
    null texts empty; a null in any other number is an error where it is read. Positions count the rows that match the predicates.
    """
    rows = file_index(spark.read.parquet(path), "_row_of_file")
    kept = algebra.where_all(rows, predicates or [])
    kept = algebra.filtered(kept.withColumnRenamed("_row_of_file", "idx"), F.lit(True), renumber=True) if predicates else kept.withColumnRenamed("_row_of_file", "idx")
    kinds = dict(kept.dtypes)
    chosen = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns or [c for c in kept.columns if c != "idx"])
    if not all(chosen) or len(set(chosen)) < len(chosen):
        raise InvalidArgument(f"empty or repeated column in {chosen}")
    for c in [*chosen, *metadata, *extras, *([label] if label else [])]:
        if c not in kinds:
            raise InvalidArgument(f"no column {c!r}")
    texts = [c for c in chosen if kinds[c] in ("string", "binary")]
    inputs = [c for c in chosen if c != label and c not in metadata and c not in extras and c not in texts]
    if label and kinds[label] in ("string", "binary"):
        raise InvalidArgument(f"label {label!r} is text")
    if len({kinds[c] for c in inputs}) > 1:
        raise InvalidArgument(f"inputs of several types: {[(c, kinds[c]) for c in inputs]}")

    def value(c: str) -> Column:
        x, kind = F.col(c), kinds[c]
        if kind in ("float", "double"):
            return F.coalesce(x, F.lit(float("nan")).cast(kind))
        if kind == "string":
            return F.coalesce(x, F.lit(""))
        if kind.startswith("timestamp"):  # a time without zone counts as one in UTC
            x = F.unix_micros(x if kind == "timestamp" else F.convert_timezone(F.lit("UTC"), F.current_timezone(), x).cast("timestamp"))
        elif kind == "date":
            x = F.unix_date(x)
        elif kind.startswith(("decimal", "struct", "map")):
            raise SourceError(f"column {c!r} of type {kind} cannot be read")
        return F.coalesce(x, F.raise_error(F.lit(f"null in column {c}"))) if not kind.startswith("array") else x

    many = F.array(*map(value, inputs)) if len(inputs) > 1 or inputs and not kinds[inputs[0]].startswith("array") else value(inputs[0]) if inputs else F.array(F.lit(0.0))
    extra = [c for c in [*metadata, *extras, *texts] if c != label]
    return kept.select("idx", many.alias("input"), (value(label) if label else F.col("idx")).alias("label"), *(value(c).alias(c) for c in dict.fromkeys(extra)))


class _Sqlite(DataSource):
    """Rows of a query on one SQLite file as arrays of doubles, in one partition."""

    @classmethod
    def name(cls) -> str:
        return "loom_sqlite"

    def schema(self) -> str:
        return "idx long, v array<double>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = dict(self.options)

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(0)]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                def number(x: object) -> float:
                    if isinstance(x, str | bytes):  # the number that the text begins with, as SQLite converts it
                        head = x.decode("utf-8", "replace") if isinstance(x, bytes) else x
                        while head:
                            try:
                                return float(head)
                            except ValueError:
                                head = head[:-1]
                        return 0.0
                    return float(x or 0)

                with sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True) as db:
                    for k, row in enumerate(db.execute(options["query"])):
                        yield k, [number(x) for x in row]

        return Reader()


def sqlite(spark: SparkSession, path: str, query: str, label_index: int | None = None) -> DataFrame:
    """(idx, input, label) of a query; all columns become numbers, null and text without a number 0. The file must be where the
    executors can read it. At least two columns; an empty result is an error."""
    spark.dataSource.register(_Sqlite)
    rows = spark.read.format("loom_sqlite").option("path", path).option("query", query).load()
    first = rows.take(1)
    if not first or len(first[0].v) < 2:
        raise SourceError(f"{path}: the query gives no rows or fewer than two columns")
    n = len(first[0].v)
    at = n - 1 if label_index is None else label_index
    if not 0 <= at < n:
        raise InvalidArgument(f"{path}: no column {at}")
    return rows.select("idx", F.array(*(F.get("v", F.lit(k)).cast("float") for k in range(n) if k != at)).alias("input"), F.get("v", F.lit(at)).cast("float").alias("label"))


def jdbc(spark: SparkSession, url: str, query: str, fetch_size: int = 1000, **options: str) -> DataFrame:
    """Rows of a query on a database with a JDBC driver; what PostgreSQL and ODBC sources are read by."""
    return spark.read.format("jdbc").option("url", url).option("query", query).option("fetchsize", fetch_size).options(**options).load()


def sql_rows(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(input, label if any, each extra and metadata column) of query rows; ``columns`` are (name, role) with the roles input, label,
    extra, metadata and auto, which is metadata for text and input for numbers.

    Inputs that are all whole numbers become int64, else float64, and no input is [0.0]. Null floats become NaN, null texts empty;
    other nulls are errors.
    """
    kinds = dict(df.dtypes)
    roles: dict[str, list[str]] = {"input": [], "label": [], "extra": [], "metadata": []}
    for name, role in columns:
        if name not in kinds or role not in (*roles, "auto"):
            raise InvalidArgument(f"sql rows: no column {name!r} or unknown role {role!r}")
        roles[("metadata" if kinds[name] == "string" else "input") if role == "auto" else role].append(name)
    if len(roles["label"]) > 1 or any(kinds[c] == "string" for c in (*roles["input"], *roles["label"])):
        raise InvalidArgument("sql rows: one label, and no text as input or label")
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint", "boolean") for c in roles["input"])

    def value(c: str, kind: str | None = None) -> Column:
        if kinds[c] == "string":
            return F.coalesce(c, F.lit(""))
        if kinds[c] in ("float", "double"):
            return F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        return F.coalesce(F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c), F.raise_error(F.lit(f"null in column {c}")).cast("int")).cast(kind or "bigint")

    made = F.array(*(value(c, "bigint" if whole else "double") for c in roles["input"])) if roles["input"] else F.array(F.lit(0.0))
    return df.select(made.alias("input"), *(value(c).alias("label") for c in roles["label"]), *(value(c).alias(c) for c in (*roles["extra"], *roles["metadata"])))


def hdf5(spark: SparkSession, path: str) -> DataFrame:
    """Not available in any build."""
    raise SourceError("HDF5 is not supported")


def in_memory(spark: SparkSession, features: np.ndarray, labels: np.ndarray | None = None) -> DataFrame:
    """(idx, input, label) of arrays [N, F] or [N], and [N] or [N, 1]."""
    features = np.asarray(features)
    features = features[:, None] if features.ndim == 1 else features
    labels = np.arange(len(features)) if labels is None else np.asarray(labels).reshape(-1)
    if features.ndim != 2 or len(labels) != len(features):
        raise InvalidArgument("features must be [N, F] or [N] and labels [N]")
    table = pa.table({"idx": np.arange(len(features)), "input": pa.array(features.tolist(), pa.list_(pa.from_numpy_dtype(features.dtype))), "label": labels})
    return spark.createDataFrame(table)


def from_function(spark: SparkSession, n: int, f: Callable[[int], tuple], schema: str) -> DataFrame:
    """``f(idx)`` for each of n positions, run where the rows are; ``schema`` names what it returns."""

    names = T.StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(int(i), *f(int(i))) for i in frame["id"]]
            yield pd.DataFrame(rows, columns=["idx", *names], dtype=object)

    return spark.range(n).mapInPandas(run, f"idx long, {schema}")


def records(spark: SparkSession, rows: Iterable[object]) -> DataFrame:
    """Dataclass instances or dicts as rows with positions."""
    made = [{f.name: getattr(r, f.name) for f in fields(r)} if is_dataclass(r) else dict(r) for r in rows]
    if not made:
        raise InvalidArgument("no records")
    return spark.createDataFrame([{"idx": k} | r for k, r in enumerate(made)])


def generator(spark: SparkSession, factory: Callable[[], Iterable[tuple]], schema: str) -> DataFrame:
    """What a generator yields, with positions; the factory runs anew in the task that reads it."""

    names = T.StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            held, at = [], 0
            for row in factory():
                held.append((at, *row))
                at += 1
                if len(held) == 1000:
                    yield pd.DataFrame(held, columns=["idx", *names], dtype=object)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["idx", *names], dtype=object)

    return spark.range(0, 1, 1, 1).mapInPandas(run, f"idx long, {schema}")
