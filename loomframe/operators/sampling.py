"""Sampling orders. Golden functions give index lists of small datasets on the driver; the others scale and depend on hashes."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument
from loomframe.functions.positions import dense_index, hash_index
from loomframe.functions.rng import Pcg32, order_key, unit

T = TypeVar("T")
#: Largest index list that golden functions make.
GOLDEN_ROWS = 10_000_000


def golden_random(n: int, seed: int, replacement: bool = False) -> list[int]:
    """A Fisher-Yates permutation, or n draws with replacement."""
    if n > GOLDEN_ROWS:
        raise InvalidArgument("too many rows for a golden order; use the portable one")
    rng = Pcg32(seed)
    return [rng.below(n) for _ in range(n)] if replacement else rng.permutation(n)


def golden_weighted(weights: list[float], n: int, seed: int, replacement: bool = True) -> list[int]:
    """n draws in proportion to the weights; without replacement by the keys log(u) / w in falling order."""
    if not weights or min(weights) < 0 or not sum(weights) or (not replacement and n > len(weights)):
        raise InvalidArgument("weighted sampling: bad weights or size")
    rng = Pcg32(seed)
    if replacement:
        total = list(itertools.accumulate(weights))
        return [min(bisect.bisect_left(total, rng.uniform53() * total[-1]), len(weights) - 1) for _ in range(n)]
    rng.permutation(len(weights))  # drawn and not used, so that later draws agree
    keys = [math.log(max(rng.uniform53(), 1e-300)) / w if w > 0 else -math.inf for w in weights]
    return sorted(range(len(weights)), key=lambda k: -keys[k])[:n]


def shuffle_buffer(rows: Iterable[T], size: int, seed: int) -> Iterator[T]:
    """A buffer that is filled, from which a uniform slot is taken and refilled by the last one."""
    rng, held, it = Pcg32(seed), [], iter(rows)
    held = list(itertools.islice(it, size))
    while held:
        k = rng.below(len(held))
        held[k], held[-1] = held[-1], held[k]
        yield held.pop()
        held += itertools.islice(it, 1)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``pos``: the place in a random order that any engine with md5 agrees on."""
    return hash_index(df, order_key(seed, key), key)


def weighted_without_replacement(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, each drawn in proportion to its weight; rows of weight 0 never are."""
    score = F.ln(unit(seed, key) + F.lit(2.0**-53)) / F.col(weight).cast("double")
    return df.where(F.col(weight) > 0).withColumn("_score", score).orderBy(F.col("_score").desc(), key).limit(n).drop("_score")


def weighted_with_replacement(df: DataFrame, weight: str, n: int, seed: int) -> DataFrame:
    """(pos, idx) of n independent draws in proportion to the weights.

    Weights become whole numbers, 2**32 for the largest and at least 1 for a positive one, so sums are exact: rows get the interval
    between two running sums, draws a point below the total, and each point lies in one interval. Both are dealt to as many cells as
    there are rows, and meet by equality of cells. Running sums are made in 4096 blocks of positions.
    """
    rows = df.select("idx", F.col(weight).cast("double").alias("w")).where("w > 0")
    told = df.agg(F.count("*").alias("n"), F.max(F.when(~F.isnan(weight), F.col(weight).cast("double"))).alias("most")).first()
    count, most = told.n, told.most
    if not most or most <= 0:
        raise InvalidArgument("weighted sampling: no positive weight")
    wide = "decimal(38,0)"
    block = F.floor(F.col("idx") * F.lit(4096) / F.lit(max(count, 1)))
    rows = rows.select("idx", F.greatest(F.floor(F.col("w") / most * F.lit(float(1 << 32)) + 0.5), F.lit(1)).cast("decimal(20,0)").alias("w"), block.alias("block"))
    sums = rows.groupBy("block").agg(F.sum("w").cast(wide).alias("s"))
    total = sums.agg(F.sum("s")).first()[0]
    sums = sums.select("block", (F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("block")) - F.col("s")).cast(wide).alias("before"))
    high = (F.col("before") + F.sum("w").over(Window.partitionBy("block").orderBy("idx"))).cast(wide)
    spans = rows.join(F.broadcast(sums), "block").select("idx", high.alias("high"), (high - F.col("w")).cast(wide).alias("low"))
    sum_of = F.lit(total).cast("decimal(21,0)")
    cell = lambda x: F.expr(f"cast(div(cast({x} as decimal(21,0)) * cast({count} as decimal(12,0)), cast('{total}' as decimal(21,0))) as long)")
    spans = spans.withColumn("last", (F.col("high") - 1).cast(wide)).withColumn("cell", F.explode(F.sequence(cell("low"), cell("last"))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("pos"), (unit(seed, F.col("id").cast("string")) * F.lit(float(1 << 52))).cast("decimal(16,0)").alias("u"))
    draws = draws.withColumn("product", F.col("u") * sum_of).withColumn("point", F.expr("cast(div(product, cast('4503599627370496' as decimal(16,0))) as decimal(38,0))")).withColumn("cell", cell("point"))
    return draws.join(spans, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("pos", "idx")


def buffered(df: DataFrame, size: int, seed: int, blocks: int = 64) -> DataFrame:
    """``df`` with ``pos``: the order in which shuffle buffers of ``size`` rows give the rows back. Every ``blocks * size`` consecutive
    positions go through a buffer of their own, so any number of tasks make the order together, and it depends on idx alone."""
    if size < 1 or blocks < 1:
        raise InvalidArgument("shuffle buffer: bad size")
    span = blocks * size

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = sorted(frame["idx"].tolist())
        first = order[0] // span * span
        return pd.DataFrame({"idx": list(shuffle_buffer(order, size, seed + order[0] // span)), "pos": range(first, first + len(order))})

    order = df.select("idx", F.floor(F.col("idx") / span).alias("block")).groupBy("block").applyInPandas(run, "idx long, pos long")
    return df.join(order, "idx")


def batched(df: DataFrame, size: int, drop_last: bool = False, pos: str = "pos") -> DataFrame:
    """``df`` with ``batch_id``: consecutive groups of ``size`` positions."""
    if size < 1:
        raise InvalidArgument("batch size must be at least 1")
    out = df.withColumn("batch_id", F.floor(F.col(pos) / size))
    return out.where(F.col("batch_id") < df.count() // size) if drop_last else out


def bucketed(df: DataFrame, length: str, size: int, seed: int, drop_last: bool = False) -> DataFrame:
    """``df`` with ``pos`` and ``batch_id``: rows sorted by length, shuffled inside windows of four batches."""
    ranked = dense_index(df, length, "idx", name="_rank").withColumn("_window", F.floor(F.col("_rank") / (4 * size)))
    inside = F.row_number().over(Window.partitionBy("_window").orderBy(order_key(seed, F.col("idx").cast("string")), "idx"))
    out = ranked.withColumn("pos", F.col("_window") * (4 * size) + inside - 1).drop("_rank", "_window")
    return batched(out, size, drop_last)


def distributed(df: DataFrame, rank: int, world: int, key: str | None = None, seed: int = 0, epoch: int = 0) -> DataFrame:
    """The rows of one of ``world`` ranks with ``pos``: every world-th of the order, which starts again to fill the last round. The
    order is ``idx``, or with ``key`` a random one for each epoch."""
    if not 0 <= rank < world:
        raise InvalidArgument("rank must be below world")
    rows = hash_index(df, order_key(seed + epoch, key), key) if key else df.withColumn("pos", F.col("idx"))
    n = df.count()
    missing = -n % world
    rounds = F.sequence(F.col("pos"), F.lit(n + missing - 1), F.lit(max(n, 1)))
    return rows.withColumn("pos", F.explode(rounds)).where(F.pmod("pos", F.lit(world)) == rank)
