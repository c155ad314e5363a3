"""Dataset algebra over rows with a dense position ``idx``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument, OutOfRange, ShapeMismatch
from loomframe.functions.numeric import compares
from loomframe.functions.positions import dense_index


def project(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """The named columns; a comma list or a list. Empty, repeated and missing names are errors."""
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    if not all(names) or len(set(names)) < len(names):
        raise InvalidArgument(f"empty or repeated column in {names}")
    if missing := [c for c in names if c not in df.columns]:
        raise InvalidArgument(f"no column {missing[0]!r}")
    return df.select(*names)


def where_all(df: DataFrame, predicates: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that match every (column, op, literal); null and NaN match none. Reaches the scan as pushed filters."""
    kinds = dict(df.dtypes)
    for column, op, literal in predicates:
        if column not in kinds:
            raise InvalidArgument(f"no column {column!r}")
        df = df.where(compares(column, op, literal, kinds[column]))
    return df


def filtered(df: DataFrame, keep: Column | str, renumber: bool = False) -> DataFrame:
    """Rows for which ``keep`` holds; positions keep their gaps unless ``renumber``."""
    out = df.where(keep)
    return dense_index(out.withColumnRenamed("idx", "_old"), "_old").drop("_old") if renumber else out


def mapped(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` applied to the rows, lazily."""
    return df.transform(step)


def subset(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows by an index table ``chosen(pos, idx)``: position pos of the result is row idx; idx may repeat. An index outside is an error."""
    if outside := chosen.join(df.select("idx"), "idx", "left_anti").take(1):
        raise OutOfRange(f"index {outside[0].idx} is outside the dataset")
    return chosen.join(df, "idx").drop("idx").withColumnRenamed("pos", "idx")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows side by side by position; both must have the same number of rows. Columns of ``a`` win over those of ``b``, but for label,
    which comes from ``b`` where it has one."""
    if a.count() != b.count():
        raise ShapeMismatch("zip: the datasets differ in size")
    label = "label" in b.columns
    left = a.drop("label") if label else a
    return left.join(b.select("idx", *(c for c in b.columns if c not in left.columns)), "idx")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """One dataset after the other, positions going on; columns by name."""
    if not parts:
        raise InvalidArgument("concat: no datasets")
    before, shifted = 0, []
    for k, part in enumerate(parts):
        shifted.append(part.withColumn("idx", F.col("idx") + F.lit(before)) if before else part)
        before += part.count() if k + 1 < len(parts) else 0
    return reduce(DataFrame.unionByName, shifted)


def take(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows."""
    return df.where(F.col("idx") < n)


def skip(df: DataFrame, n: int) -> DataFrame:
    """All but the first ``n`` rows, positions from 0."""
    return df.where(F.col("idx") >= n).withColumn("idx", F.col("idx") - n)


def repeat(df: DataFrame, times: int) -> DataFrame:
    """The whole dataset ``times`` times."""
    if times < 1:
        raise InvalidArgument("repeat: times must be at least 1")
    n = df.count()
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("idx", F.col("idx") + F.col("_copy") * n).drop("_copy")


def iterate(df: DataFrame) -> Iterator[Row]:
    """The rows in the order of positions, one partition at a time."""
    yield from df.orderBy("idx").toLocalIterator(prefetchPartitions=True)


def cached(df: DataFrame) -> DataFrame:
    """Rows kept in memory or on disk after their first use."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
