"""Splits and cross-validation. A split is a column; its order comes from the hash of the seed and a unique key."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument
from loomframe.functions.positions import dense_index, hash_index
from loomframe.functions.rng import order_key


def half_up(x: float) -> int:
    """To the nearest integer, halves away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def cuts(n: int, fractions: list[float]) -> list[int]:
    """Ends of the parts of ``n`` rows; the last part takes the rest. The fractions must be positive and sum to 1."""
    if not fractions or min(fractions) < 0 or abs(sum(fractions) - 1) > 1e-6:
        raise InvalidArgument("fractions must be positive and sum to 1")
    sizes = [half_up(f * n) for f in fractions[:-1]]
    over = max(0, sum(sizes) - n)
    for k, size in enumerate(sizes):  # what rounding gives too much is taken from the first parts
        sizes[k] -= min(size, over)
        over -= size - sizes[k]
    return [*itertools.accumulate(sizes), n]


def _part(pos: Column, ends: list[int]) -> Column:
    part = F.lit(len(ends) - 1)
    for k in reversed(range(len(ends) - 1)):
        part = F.when(pos < ends[k], k).otherwise(part)
    return part


def random_split(df: DataFrame, key: str, fractions: list[float], seed: int) -> DataFrame:
    """``df`` with ``part``: exact sizes, rows in random order."""
    ends = cuts(df.count(), fractions)
    return hash_index(df, order_key(seed, key), key).withColumn("part", _part(F.col("pos"), ends)).drop("pos")


def train_val_test_split(df: DataFrame, key: str, train: float, val: float, test: float, seed: int) -> DataFrame:
    """``df`` with ``part``: train, val or test."""
    out = random_split(df, key, [train, val, test], seed)
    return out.withColumn("part", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("part") + 1))


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int) -> DataFrame:
    """``df`` with ``part`` 0 or 1: of each class the rounded fraction goes to 0, but at least one row to each part if it has two."""
    if not 0 < fraction < 1:
        raise InvalidArgument("fraction must be between 0 and 1")
    size = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    wanted = F.floor(F.lit(fraction) * F.col("_n") + 0.5)
    cut = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.least(wanted, F.col("_n") - 1))).otherwise(wanted)
    out = hash_index(df, order_key(seed, key), key, by=[label]).join(F.broadcast(_classes(size)), F.col(label).eqNullSafe(F.col("_label")))
    return out.withColumn("part", (F.col("pos") >= cut).cast("int")).drop("pos", "_label", "_n")


def _classes(size: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The table of classes, which must be small enough to send to every task."""
    if size.limit(most + 1).count() > most:
        raise InvalidArgument(f"more than {most} classes")
    return size


def k_fold(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: random position modulo k."""
    _at_least(k, df.count())
    return hash_index(df, order_key(seed, key), key).withColumn("fold", F.pmod("pos", F.lit(k)).cast("int")).drop("pos")


def _at_least(k: int, n: int) -> None:
    if k < 2 or n < k:
        raise InvalidArgument(f"{k} folds of {n} rows or groups")


def stratified_k_fold(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: random position inside the class modulo k; a class of fewer than k rows is an error."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    _at_least(k, least or 0)
    return hash_index(df, order_key(seed, key), key, by=[label]).withColumn("fold", F.pmod("pos", F.lit(k)).cast("int")).drop("pos")


def group_k_fold(df: DataFrame, group: str, k: int) -> DataFrame:
    """``df`` with ``fold``: place of the group among the sorted groups modulo k, so that no group is in two folds."""
    groups = dense_index(df.select(F.col(group).alias("_group")).distinct(), "_group", name="_place")
    _at_least(k, groups.count())
    return df.join(groups, F.col(group).eqNullSafe(F.col("_group"))).withColumn("fold", F.pmod("_place", F.lit(k)).cast("int")).drop("_group", "_place")


def time_series_blocks(n: int, k: int, gap: int = 0) -> list[tuple[int, int, int, int]]:
    """(fold, end of train, start of test, end of test) for k expanding windows over k + 1 blocks, the first ones larger by one."""
    if k < 1 or n < k + 1 or gap < 0:
        raise InvalidArgument("time series split: too few rows or a negative gap")
    ends, at = [], 0
    for b in range(k + 1):
        at += n // (k + 1) + (b < n % (k + 1))
        ends.append(at)
    return [(f, ends[f], min(ends[f] + gap, ends[f + 1]), ends[f + 1]) for f in range(k)]


def time_series_split(df: DataFrame, k: int, gap: int = 0) -> DataFrame:
    """Rows by ``idx`` once for each fold and part they belong to, with ``fold`` and ``part`` train or test."""
    blocks = time_series_blocks(df.count(), k, gap)
    member = F.array(*(F.struct(F.lit(f).alias("fold"), F.when(F.col("idx") < train, "train").when((F.col("idx") >= start) & (F.col("idx") < end), "test").alias("part")) for f, train, start, end in blocks))
    return df.withColumn("_m", F.explode(member)).where("_m.part is not null").select(*df.columns, "_m.fold", "_m.part")
