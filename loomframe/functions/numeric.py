"""Element-wise functions with fixed rules for NaN, infinities and rounding.

NaN means missing: no comparison matches it and statistics leave it out. Spark orders NaN above all numbers and treats it as equal to
itself, so each function guards it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument

INF, NAN = float("inf"), float("nan")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: str | Column) -> Column:
    """``x`` as a double, null where it is NaN."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    """Between ``low`` and ``high``; NaN and null stay."""
    if low > high:
        raise InvalidArgument("clip: low is above high")
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def log1p(x: Column) -> Column:
    """ln(1 + x): -inf at -1 and NaN below, where Spark's own gives null."""
    return F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))


def standardize(x: Column, mean: float, scale: float) -> Column:
    """(x - mean) / scale; a scale of 0 or NaN counts as 1."""
    return (x - F.lit(float(mean))) / F.lit(1.0 if scale == 0 or scale != scale else float(scale))


def minmax(x: Column, low: float, high: float, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """From [low, high] to the range ``to``; an empty range counts as 1."""
    span = high - low
    return F.lit(to[0]) + F.lit(to[1] - to[0]) * ((x - F.lit(float(low))) / F.lit(1.0 if span == 0 else float(span)))


def scalar(x: Column, op: str, a: float) -> Column:
    """x op a for add, sub, mul and div; division by zero gives what IEEE 754 says."""
    a = float(a)
    if op == "add":
        return x + F.lit(a)
    if op == "sub":
        return x - F.lit(a)
    if op == "mul":
        return x * F.lit(a)
    if op == "div":
        return x / F.lit(a) if a else F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF))
    raise InvalidArgument(f"unknown operation {op!r}")


def binarize(x: Column, threshold: float) -> Column:
    """1 where x is above the threshold; NaN and null give 0."""
    return F.when((x > threshold) & ~F.isnan(x), 1.0).otherwise(0.0)


def rounded(x: Column) -> Column:
    """To float32 and back, as values are stored between two steps."""
    return x.cast("float").cast("double")


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}


def compares(column: str, op: str, literal: object, kind: str) -> Column:
    """A predicate that null never matches and, for floating point columns, NaN never matches either, not even with ``ne``."""
    if op not in COMPARE:
        raise InvalidArgument(f"unknown comparison {op!r}")
    if isinstance(literal, str) != (kind == "string"):
        raise InvalidArgument(f"column {column} and literal {literal!r} cannot be compared")
    found = COMPARE[op](F.col(column), F.lit(literal))
    return found & ~F.isnan(F.col(column)) if kind in ("float", "double") else found
