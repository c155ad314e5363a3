"""Collation: rows of a batch become one row. A batch is one group of one exchange; nothing is collected before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument
from loomframe.types import numel


def _ordered(x: str | Column, pos: str) -> Column:
    """Values of ``x`` in the order of positions."""
    value = F.col(x) if isinstance(x, str) else x
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("x")))), lambda s: s.x)


def stack(df: DataFrame, inputs: str, label: str | None = None, extras: tuple[str, ...] = (), pos: str = "pos") -> DataFrame:
    """(batch_id, size, inputs, labels, and each extra): inputs must have one length in a batch, extras may be ragged."""
    same = F.when(F.min(F.size(inputs)) == F.max(F.size(inputs)), _ordered(inputs, pos)).otherwise(F.raise_error(F.lit("stack: inputs of a batch differ in length")))
    columns = [F.count("*").alias("size"), same.alias("inputs")]
    if label:
        columns.append(_ordered(label, pos).alias("labels"))
    return df.groupBy("batch_id").agg(*columns, *(_ordered(e, pos).alias(e) for e in extras))


def pad(df: DataFrame, inputs: str, label: str | None = None, value: float = 0.0, pos: str = "pos") -> DataFrame:
    """(batch_id, size, inputs, mask, labels): rows padded to the longest of the batch, mask 1 for values and 0 for padding."""
    columns = [F.count("*").alias("size"), F.max(F.size(inputs)).alias("_n"), _ordered(F.transform(inputs, lambda x: x.cast("double")), pos).alias("_rows")]
    if label:
        columns.append(_ordered(label, pos).alias("labels"))
    out = df.groupBy("batch_id").agg(*columns)
    filled = F.transform("_rows", lambda r: F.concat(r, F.array_repeat(F.lit(float(value)), F.col("_n") - F.size(r))))
    mask = F.transform("_rows", lambda r: F.concat(F.array_repeat(F.lit(1), F.size(r)), F.array_repeat(F.lit(0), F.col("_n") - F.size(r))))
    return out.select("batch_id", "size", filled.alias("inputs"), mask.alias("mask"), *(["labels"] if label else []))


def ragged(df: DataFrame, inputs: str, label: str | None = None, pos: str = "pos") -> DataFrame:
    """(batch_id, size, inputs, labels): rows as they are."""
    columns = [F.count("*").alias("size"), _ordered(inputs, pos).alias("inputs")]
    return df.groupBy("batch_id").agg(*columns, *([_ordered(label, pos).alias("labels")] if label else []))


def stack_nd(df: DataFrame, inputs: str, shape: str, label: str | None = None, pos: str = "pos") -> DataFrame:
    """(batch_id, size, inputs, shape, labels): flat inputs with the shape of the batch, [size, *shape of each]; all shapes must agree."""
    same = F.when(F.min(shape) == F.max(shape), F.concat(F.array(F.count("*").cast("int")), F.min(F.col(shape).cast("array<int>")))).otherwise(F.raise_error(F.lit("stack: shapes of a batch differ")))
    columns = [F.count("*").alias("size"), F.flatten(_ordered(inputs, pos)).alias("inputs"), same.alias("shape")]
    return df.groupBy("batch_id").agg(*columns, *([_ordered(label, pos).alias("labels")] if label else []))


def pad_matrices(df: DataFrame, inputs: str, label: str | None = None, value: float = 0.0, pos: str = "pos") -> DataFrame:
    """As ``pad`` for inputs that are arrays of steps, each an array of one width of features; the mask counts steps."""
    width = F.transform(F.col(inputs), lambda r: F.size(r))
    columns = [F.count("*").alias("size"), F.max(F.size(inputs)).alias("_n"), F.max(F.array_max(width)).alias("_width"), F.min(F.array_min(width)).alias("_least"), _ordered(F.col(inputs).cast("array<array<double>>"), pos).alias("_rows")]
    if label:
        columns.append(_ordered(label, pos).alias("labels"))
    out = df.groupBy("batch_id").agg(*columns)
    blank = F.array_repeat(F.lit(float(value)), F.coalesce("_width", F.lit(0)))
    filled = F.transform("_rows", lambda r: F.concat(r, F.array_repeat(blank, F.col("_n") - F.size(r))))
    filled = F.when(F.coalesce(F.col("_least") == F.col("_width"), F.lit(True)), filled).otherwise(F.raise_error(F.lit("pad: steps differ in width")))
    mask = F.transform("_rows", lambda r: F.concat(F.array_repeat(F.lit(1), F.size(r)), F.array_repeat(F.lit(0), F.col("_n") - F.size(r))))
    return out.select("batch_id", "size", filled.alias("inputs"), mask.alias("mask"), *(["labels"] if label else []))


def fields(df: DataFrame, extras: list[str], pos: str = "pos") -> DataFrame:
    """(batch_id, each extra, each extra + "_stacked"): values in order, and whether all rows have one length, so that they stack; a
    row without the field is an error."""
    columns = [c for e in extras for c in (F.count(e).alias(f"_{e}"), _ordered(e, pos).alias(e), (F.min(F.size(e)) == F.max(F.size(e))).alias(f"{e}_stacked"))]
    out = df.groupBy("batch_id").agg(F.count("*").alias("_size"), *columns)
    checked = {e: F.when(F.col(f"_{e}") == F.col("_size"), F.col(e)).otherwise(F.raise_error(F.lit(f"collate: a row lacks {e}"))) for e in extras}
    return out.withColumns(checked).drop("_size", *(f"_{e}" for e in extras))


def collate(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, pos: str = "pos") -> DataFrame:
    """A collation of the caller: ``f`` gets the rows of one batch in order and gives rows of ``schema``."""
    return df.groupBy("batch_id").applyInPandas(lambda frame: f(frame.sort_values(pos, kind="stable").reset_index(drop=True)), schema)


def joined(arrays: list[str | Column]) -> Column:
    """Tensors of one row (dtype, shape, data) joined along their first axis; the other axes must agree."""
    cells = [F.col(a) if isinstance(a, str) else a for a in arrays]
    rest = [F.slice(c["shape"], 2, F.size(c["shape"]) - 1) for c in cells]
    same = F.lit(True)
    for r in rest[1:]:
        same = same & (r == rest[0])
    first = sum((F.element_at(c["shape"], 1) for c in cells[1:]), F.element_at(cells[0]["shape"], 1))
    made = F.struct(cells[0]["dtype"].alias("dtype"), F.concat(F.array(first), rest[0]).alias("shape"), F.concat(*(c["data"] for c in cells)).alias("data"))
    return F.when(same, made).otherwise(F.raise_error(F.lit("concat: shapes differ")))


def stacked(arrays: list[str | Column]) -> Column:
    """Tensors of one row along a new first axis; all shapes must agree."""
    cells = [F.col(a) if isinstance(a, str) else a for a in arrays]
    grown = [c.withField("shape", F.concat(F.array(F.lit(1)), c["shape"])) for c in cells]
    return joined(grown)


def reshaped(tensor: str | Column, shape: list[int]) -> Column:
    """The same values in another shape of as many elements."""
    cell = F.col(tensor) if isinstance(tensor, str) else tensor
    return F.when(F.size(cell["data"]) == numel(shape), cell.withField("shape", F.array(*map(F.lit, shape)))).otherwise(F.raise_error(F.lit("reshape: sizes differ")))


def metadata(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(batch_id, each key): texts of a batch, empty where a row has none."""
    if not keys:
        raise InvalidArgument("metadata: no keys")
    return df.groupBy("batch_id").agg(*(_ordered(F.coalesce(F.col(k).cast("string"), F.lit("")), pos).alias(k) for k in keys))


def batches(df: DataFrame) -> Iterator[Row]:
    """The batches in order, fetched while the one before is used."""
    yield from df.orderBy("batch_id").toLocalIterator(prefetchPartitions=True)
