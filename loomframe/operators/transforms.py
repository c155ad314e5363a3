"""Transforms of numeric columns as functions from DataFrame to DataFrame.

A chain of element-wise steps is one projection: Catalyst collapses the steps and generates one loop. Between two steps values are
rounded to the storage type, as they would be if each step stored its result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument, ShapeMismatch
from loomframe.functions import numeric, rng

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Elementwise:
    """``one(x, k)`` for the k-th column; ``storage``: float32 rounds the result."""

    columns: tuple[str, ...]
    one: Callable[[Column, int], Column]
    storage: str = "float64"

    def __call__(self, df: DataFrame) -> DataFrame:
        cast = (lambda c: c.cast("float")) if self.storage == "float32" else (lambda c: c)
        return df.withColumns({c: cast(self.one(F.col(c).cast("double"), k)) for k, c in enumerate(self.columns)})


def clip(columns: list[str], low: float, high: float, storage: str = "float64") -> Elementwise:
    numeric.clip(F.lit(0.0), low, high)
    return Elementwise(tuple(columns), lambda x, k: numeric.clip(x, low, high), storage)


def log1p(columns: list[str], storage: str = "float64") -> Elementwise:
    return Elementwise(tuple(columns), lambda x, k: numeric.log1p(x), storage)


def standardize(columns: list[str], mean: list[float], scale: list[float], storage: str = "float64") -> Elementwise:
    if not len(columns) == len(mean) == len(scale):
        raise ShapeMismatch("standardize: widths differ")
    return Elementwise(tuple(columns), lambda x, k: numeric.standardize(x, mean[k], scale[k]), storage)


def minmax(columns: list[str], low: list[float], high: list[float], storage: str = "float64") -> Elementwise:
    if not len(columns) == len(low) == len(high):
        raise ShapeMismatch("minmax: widths differ")
    return Elementwise(tuple(columns), lambda x, k: numeric.minmax(x, low[k], high[k]), storage)


def scalar(columns: list[str], op: str, a: float, storage: str = "float64") -> Elementwise:
    numeric.scalar(F.lit(0.0), op, a)
    return Elementwise(tuple(columns), lambda x, k: numeric.scalar(x, op, a), storage)


def custom(columns: list[str], kernel: Callable[[Column], Column], storage: str = "float64") -> Elementwise:
    """A kernel of the caller, as a column expression (or a pandas UDF applied to the column)."""
    return Elementwise(tuple(columns), lambda x, k: kernel(x), storage)


def compose(*steps: Step) -> Step:
    """The steps one after the other."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run


def random_apply(step: Step, p: float, seed: int, key: str = "idx") -> Step:
    """``step`` for the rows whose hash of (seed, key) falls below ``p``; the others stay as they are."""
    if not 0 <= p <= 1:
        raise InvalidArgument("random_apply: p must be between 0 and 1")

    def run(df: DataFrame) -> DataFrame:
        changed = step(df.select("*", *(F.col(c).alias(f"_was_{c}") for c in df.columns)))
        hit = rng.unit(seed, key) < p
        out = changed.withColumn("_hit", hit)
        return out.select(*(F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_was_{c}")).alias(c) if c in _touched(step) else F.col(c) for c in df.columns))

    return run


def one_of(steps: list[Step], seed: int, key: str = "idx") -> Step:
    """For each row one of the steps, chosen uniformly by the hash of (seed, key)."""
    if not steps:
        raise InvalidArgument("one_of: no steps")

    def run(df: DataFrame) -> DataFrame:
        touched = sorted({c for s in steps for c in _touched(s)})
        pick = F.floor(rng.unit(seed, key) * len(steps)).cast("int")
        chosen = {}
        for c in touched:
            out = F.col(c).cast("double")
            for k, s in enumerate(steps):
                if c in s.columns:
                    out = F.when(pick == k, s.one(F.col(c).cast("double"), s.columns.index(c))).otherwise(out)
            chosen[c] = out
        return df.withColumns(chosen)

    return run


def _touched(step: Step) -> tuple[str, ...]:
    if not isinstance(step, Elementwise):
        raise InvalidArgument("a random step must be element-wise")
    return step.columns


#: Name: factory from (columns, parameters).
REGISTRY: dict[str, Callable[[list[str], dict], Step]] = {
    "clip": lambda c, p: clip(c, p["min"], p["max"]),
    "log1p": lambda c, p: log1p(c),
    "standardize": lambda c, p: standardize(c, p["mean"], p["scale"]),
    "minmax": lambda c, p: minmax(c, p["min"], p["max"]),
    **{op: (lambda c, p, op=op: scalar(c, op, p["value"])) for op in ("add", "sub", "mul", "div")},
}


def register(name: str) -> Callable:
    """Decorator that adds a factory (columns, parameters) -> step under ``name``."""

    def add(factory: Callable[[list[str], dict], Step]) -> Callable[[list[str], dict], Step]:
        if name in REGISTRY:
            raise InvalidArgument(f"transform {name!r} is registered already")
        REGISTRY[name] = factory
        return factory

    return add


def create(name: str, columns: list[str], parameters: dict | None = None) -> Step:
    """The registered transform of that name."""
    if name not in REGISTRY:
        raise InvalidArgument(f"unknown transform {name!r}")
    try:
        return REGISTRY[name](columns, parameters or {})
    except KeyError as e:
        raise InvalidArgument(f"transform {name!r} needs parameter {e}") from None
