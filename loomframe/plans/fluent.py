"""A chain of calls over a lazy DataFrame with positions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession

from loomframe.operators import algebra
from loomframe.plans.config import Loader
from loomframe.sources import tabular
from loomframe.sources.registry import open_uri


@dataclass(frozen=True)
class Chain:
    """Every call gives a new chain; nothing runs before the batches are read."""

    rows: DataFrame
    seed: int | None = None
    size: int = 1
    last: bool = False

    def map(self, step: Callable[[DataFrame], DataFrame]) -> Chain:
        return replace(self, rows=algebra.mapped(self.rows, step))

    def filter(self, keep: Column | str) -> Chain:
        return replace(self, rows=algebra.filtered(self.rows, keep, renumber=True))

    def take(self, n: int) -> Chain:
        return replace(self, rows=algebra.take(self.rows, n))

    def skip(self, n: int) -> Chain:
        return replace(self, rows=algebra.skip(self.rows, n))

    def repeat(self, times: int) -> Chain:
        return replace(self, rows=algebra.repeat(self.rows, times))

    def zip(self, other: Chain) -> Chain:
        return replace(self, rows=algebra.zipped(self.rows, other.rows))

    def concat(self, other: Chain) -> Chain:
        return replace(self, rows=algebra.concatenated([self.rows, other.rows]))

    def shuffle(self, seed: int) -> Chain:
        return replace(self, seed=seed)

    def prefetch(self, k: int) -> Chain:
        """Kept for the order of calls; batches are always fetched ahead."""
        return self

    def cache(self) -> Chain:
        return replace(self, rows=self.rows.persist())

    def batches(self, n: int, drop_last: bool = False) -> Chain:
        return replace(self, size=n, last=drop_last)

    def build(self) -> Loader:
        return Loader(self.rows, [], self.size, self.seed is not None, self.last, self.seed or 0)


def from_csv(spark: SparkSession, path: str, **options: object) -> Chain:
    return Chain(tabular.csv(spark, path, **options))


def from_uri(spark: SparkSession, uri: str, **options: object) -> Chain:
    return Chain(open_uri(spark, uri, options))


def from_frame(rows: DataFrame) -> Chain:
    return Chain(rows)
