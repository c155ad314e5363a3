"""What several corpus operators share: word hashing in numpy, connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.positions import shared_dir, staged  # noqa: F401  the operators stage by these too

#: White space as the contracts have it: \x20 and \x09 to \x0D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Native spelling of the same word class, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Text is turned into numpy arrays in pieces of about this many bytes; only a longer document makes a longer piece.
PIECE_BYTES = 2 << 20


# --- expressions -------------------------------------------------------------------------------------------------


def held(value: Column) -> Column:
    """``value`` as the only item of a generator. A filter on the result stays above it: the optimizer would otherwise copy a costly
    expression into the filter, and into each lambda that refers to it."""
    return F.explode(F.array(value))


#: The filter of ``among`` has 2**this bits, 64 to a row: 524,288 rows at most are broadcast, however many keys there are.
FILTER_BITS = 25


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be one of ``keys``: all that are one, and of the others the fewer the fewer keys there are. A join
    with the keys themselves must follow; this keeps most other rows out of its shuffle."""
    bit = F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)
    word, place = F.shiftrightunsigned(bit, 6).alias("_word"), bit.bitwiseAND(F.lit(63)).cast("int")
    words = keys.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.getbit("_bits", place) == 1).select(*rows.columns)


#: Bytes of an Arrow batch inside ``small_batches``; Spark's own bound is 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python in batches of about BATCH_BYTES, or as the session has set it. A task holds a batch outside
    the heap as vectors and again as a stream, both grown by doubling, and once more in Python. Which rows there are does not change."""
    own = spark.conf.get(BATCH, None)
    if own is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH)


# --- words as numbers --------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64; its constants here and in ``stream`` are fixed values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random uint64 that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(11, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)

NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[list(BLANKS)] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, bytes, row offsets into the bytes). Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and for each row the index of its first word (one more entry at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = is_word[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z counting as a-z; with ``prefix``, of its first so many bytes only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts if prefix is None else np.minimum(ends - starts, prefix)
    total = np.cumsum(size)
    begin = total - size
    place = np.arange(total[-1]) - np.repeat(begin, size)
    most = int(size.max())
    powers = _POWERS if most <= len(_POWERS) else _powers(most)
    value = _BYTE[buf[place + np.repeat(starts, size)]] * powers[place]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(hashes: np.ndarray, width: int, seed: int = 101) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = stream(seed, width) | np.uint64(1)
    out = hashes[:n] * odd[0]
    for k in range(1, width):
        out = out + hashes[k : k + n] * odd[k]
    return mix(out)


# --- connected components ----------------------------------------------------------------------------------------


#: With more edges than this in all, those of one node are dealt to so many tasks.
SALT_EDGES, SALTS = 1_000_000, 32


def _with_least(edges: DataFrame, salted: bool) -> tuple[DataFrame, DataFrame]:
    """``edges(a, b)`` with m, the least b of each a, and (a, m) of each a. ``salted``: a hub's edges never meet in one task but are
    summed up and joined by (a, part of b), and only one row for each part meets."""
    if not salted:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        return edges.join(low, "a"), low
    parts = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("tinyint"))
    low = parts.groupBy("a", "s").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_set("s").alias("s"))
    return parts.join(low.select("a", "m", F.explode("s").alias("s")), ["a", "s"]).drop("s"), low.select("a", "m")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the component's smallest node.

    Alternates large-star and small-star steps until the edges no longer change. Every step is a partial minimum for each node
    and one join, each step's edges are staged, and only a count and a checksum come to the driver.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    seen, salted = None, now.count() > SALT_EDGES
    while True:
        both, _ = _with_least(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), salted)
        large = both.select("a", "b", F.least("a", "m").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        told, low = _with_least(large, salted)
        small = told.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), f"{label}-edges")
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            break
        seen = (mark.n, mark.x)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
