"""Statistics over columns; NaN and null count as missing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument
from loomframe.functions.numeric import present

#: Ranks are narrowed by counts in this many bins until no more than so many values are left in a bin.
BINS, LEFT = 2048, 4096


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, missing, count) of each column: population std, non-finite extremes as 0; one pass."""
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), present(c).alias("x")) for c in columns)))
    finite = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return (
        df.select(items.alias("i")).select("i.*").groupBy("feature")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), finite(F.min("x")).alias("min"), finite(F.max("x")).alias("max"), F.count_if(F.col("x").isNull()).alias("missing"), F.count("x").alias("count"))
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, count) of each class."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, count) over equal widths from the least to the greatest value, the last bin closed, empty bins included."""
    if bins < 1:
        raise InvalidArgument("histogram: bins must be at least 1")
    x = present(column)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = (0.0, 1.0) if r.lo is None else (r.lo, r.hi if r.hi > r.lo else r.lo + 1)
    width = (hi - lo) / bins
    at = F.least(F.floor((x - lo) / width), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at 0-based ``ranks`` of each column among its present values, exact.

    Each pass counts, in one scan and for all columns, how many values fall into the bins of the interval that still holds a rank;
    only counts come to the driver, and at last the few values of one bin.
    """
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    ends = df.agg(*(f(present(c)).alias(f"{n}{k}") for k, c in enumerate(ranks) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count)))).first()
    todo = [(c, r, ends[f"lo{k}"], ends[f"hi{k}"], 0, ends[f"n{k}"]) for k, (c, rs) in enumerate(ranks.items()) for r in rs]
    while todo:
        now, todo = todo, []
        few = [t for t in now if t[5] <= LEFT or t[2] == t[3] or math.nextafter(t[2], math.inf) >= t[3]]
        wide = [t for t in now if t not in few]
        if few:
            cells = sorted({(c, lo, hi) for c, _, lo, hi, _, _ in few})
            value = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when((present(c) >= lo) & (present(c) <= hi), present(c)).alias("x")) for k, (c, lo, hi) in enumerate(cells))))
            counts: dict[int, list[tuple[float, int]]] = {}
            for r in df.select(value.alias("v")).select("v.*").where("x is not null").groupBy("k", "x").agg(F.count("*").alias("n")).collect():
                counts.setdefault(r.k, []).append((r.x, r.n))
            for c, rank, lo, hi, before, _ in few:
                for x, n in sorted(counts[cells.index((c, lo, hi))]):
                    before += n
                    if rank < before:
                        out[c][rank] = x
                        break
        if wide:
            cells = sorted({(c, lo, hi) for c, _, lo, hi, _, _ in wide})
            bin_ = lambda c, lo, hi: F.when((present(c) >= lo) & (present(c) <= hi), F.least(F.floor((present(c) - lo) / (hi - lo) * BINS), F.lit(BINS - 1)))
            value = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), bin_(*cell).alias("b"), present(cell[0]).alias("x")) for k, cell in enumerate(cells))))
            found: dict[int, list] = {}
            for r in df.select(value.alias("v")).select("v.*").where("b is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
                found.setdefault(r.k, []).append(r)
            for c, rank, lo, hi, before, _ in wide:
                for r in sorted(found[cells.index((c, lo, hi))], key=lambda r: r.b):
                    if rank < before + r.n:
                        todo.append((c, rank, r.lo, r.hi, before, r.n))
                        break
                    before += r.n
    return out


def quantiles(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation at q * (n - 1); None for a column without values."""
    n = df.agg(*(F.count(present(c)).alias(str(k)) for k, c in enumerate(columns))).first()
    place = {c: [q * (n[str(k)] - 1) for q in at] for k, c in enumerate(columns) if n[str(k)]}
    ranks = {c: sorted({f(p) for p in ps for f in (math.floor, math.ceil)}) for c, ps in place.items()}
    found = order_statistics(df, ranks) if ranks else {}
    value = lambda c, p: found[c][math.floor(p)] + (p - math.floor(p)) * (found[c][math.ceil(p)] - found[c][math.floor(p)])
    return {c: [value(c, p) for p in place[c]] if c in place else [None] * len(at) for c in columns}


def modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The most frequent value of each column, the least of equally frequent ones."""
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), present(c).alias("x")) for c in columns)))
    counts = df.select(items.alias("i")).select("i.*").where("x is not null").groupBy("c", "x").agg(F.count("*").alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("b")).select("c", "b.x").collect()
    return {c: None for c in columns} | {r.c: r.x for r in best}
