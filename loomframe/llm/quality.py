"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes a few statistics, standardised with the labelled rows' moments. Cosines of random projections approximate a Gaussian
kernel over them. Every partition of the labelled rows sums its part of the normal equations, once for each of two folds; the sums
give the model and, by holding one fold out at a time, scores for the calibration, whose pool-adjacent-violators fit sees counts of
scores in fixed bins. What comes to the driver has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import common

#: Number of random features, width of the kernel in standard deviations, ridge penalty for each row, bins of raw scores.
FEATURES, WIDTH, RIDGE, BINS = 256, 3.0, 1e-3, 400
#: Partitions that sum normal equations.
SUMS = 16
THRESHOLD = 0.7

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "shouts", "stops", "other_marks", "lines", "line_words", "distinct", "repeated_8", "repeated_lines", "top_word",
    "short_words", "long_words", "marked_words", "capital_words", "runs_of_one_word",
)

_CLASS = np.zeros((8, 256), dtype=bool)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\"'()[]{}/\\~^_=+@-`", b"\n", b"abcdefghijklmnopqrstuvwxyz")):
    _CLASS[_k, list(_chars)] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; null counts as empty."""
    out = np.zeros((len(column), len(STATISTICS)))
    for lo, hi, buf, offsets in common.pieces(column):
        starts, ends, first = common.spans(buf, offsets, common.NOT_BLANK)
        words = common.word_hashes(buf, starts, ends)
        n = np.diff(first)
        each = np.maximum(n, 1)
        size = ends - starts

        def summed(values: np.ndarray, first: np.ndarray = first) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return total[first[1:]] - total[first[:-1]]

        upper, digits, symbols, shouts, stops, marks, breaks, lower = (np.concatenate([[0], np.cumsum(c[buf], dtype=np.int64)]) for c in _CLASS)
        of = lambda total, offsets=offsets: total[offsets[1:]] - total[offsets[:-1]]
        letters = np.maximum(of(upper) + of(lower), 1)
        block = out[lo:hi]
        block[:, 0] = np.log1p(n)
        block[:, 1] = summed(size) / each
        block[:, 2] = of(upper) / letters
        for k, total in ((3, digits), (4, symbols), (5, shouts), (6, stops), (7, marks)):
            block[:, k] = of(total) / each
        block[:, 8] = np.log1p(of(breaks))
        block[:, 9] = np.log1p(n / (of(breaks) + 1))
        word_symbols = (symbols[ends] - symbols[starts] + shouts[ends] - shouts[starts]) > 0 if len(starts) else np.zeros(0, bool)
        capital = (upper[ends] - upper[starts]) > 1 if len(starts) else np.zeros(0, bool)
        same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
        for k, values in ((14, size <= 2), (15, size > 14), (16, word_symbols), (17, capital), (18, same)):
            block[:, k] = summed(values) / each
        edges = np.concatenate([[-1], np.flatnonzero(buf == 10), [len(buf)]])
        for r in range(hi - lo):
            own = words[first[r] : first[r + 1]]
            if not len(own):
                continue
            _, counts = np.unique(own, return_counts=True)
            block[r, 10] = len(counts) / len(own)
            block[r, 13] = counts.max() / len(own)
            if len(own) >= 8:
                windows = common.runs(own, 8)
                block[r, 11] = 1 - len(np.unique(windows)) / len(windows)
            i, j = np.searchsorted(edges, [offsets[r], offsets[r + 1]])
            if j - i > 1:
                cut = np.searchsorted(starts[first[r] : first[r + 1]], np.concatenate([[offsets[r]], edges[i:j] + 1]))
                cut = np.unique(cut[cut < len(own)])
                lines = np.add.reduceat(own * (np.arange(len(own), dtype=np.uint64) - np.repeat(cut, np.diff(np.append(cut, len(own)))).astype(np.uint64) * np.uint64(1) + np.uint64(1)), cut)
                block[r, 12] = 1 - len(np.unique(lines)) / len(lines)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row of ``docs``, staged."""
    return common.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, "doc_id long, x array<double>"), "quality-statistics")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw_knots: np.ndarray
    score_knots: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale, self.projection, self.phase)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of them follows the raw score, so that ties of the calibration keep its order."""
        raw = self.features(x) @ self.weights
        return np.clip(0.99 * np.interp(raw, self.raw_knots, self.score_knots) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, projection: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.cos(z @ projection + phase) * np.sqrt(2 / len(phase)), np.ones((len(z), 1))], axis=1)


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _normal(mean, scale, projection, phase):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(phase) + 1
        gram, right = np.zeros((2, d, d)), np.zeros((2, d))
        rows = np.zeros(2)
        for batch in batches:
            z, y, fold = features(_stacked(batch, "x"), mean, scale, projection, phase), batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy()
            for f in (0, 1):
                own = fold == f
                gram[f] += z[own].T @ z[own]
                right[f] += z[own].T @ y[own]
                rows[f] += own.sum()
        for f in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([rows[f]]), pa.array([gram[f].tobytes()]), pa.array([right[f].tobytes()])], ["fold", "n", "gram", "right"])

    return run


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x; a block becomes one knot at its mean x."""
    blocks: list[list[float]] = []
    for at, p, n in zip(x, positives, counts, strict=True):
        if n:
            blocks.append([at * n, p, n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(known: DataFrame, seed: int = 3) -> Model:
    """The model from ``known(x, y, fold)``: statistics, a label of 0 or 1, and a fold of 0 or 1. All rows are used. Without any rows,
    or with one class alone, the scores are the share of label 1, or a half."""
    rng = np.random.default_rng(seed)
    width = len(STATISTICS)
    projection, phase = rng.normal(size=(width, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    known = common.staged(known.repartition(SUMS), "quality-known")  # in turn, not by a key: equal texts have equal statistics
    moments = known.agg(*(f(F.get("x", F.lit(k))).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.array([moments[f"s{k}"] or 1.0 for k in range(width)])
    gram, right, rows = np.zeros((2, FEATURES + 1, FEATURES + 1)), np.zeros((2, FEATURES + 1)), np.zeros(2)
    for row in known.mapInArrow(_normal(mean, scale, projection, phase), "fold long, n double, gram binary, right binary").toLocalIterator():
        gram[row.fold] += np.frombuffer(row.gram).reshape(FEATURES + 1, -1)
        right[row.fold] += np.frombuffer(row.right)
        rows[row.fold] += row.n
    solve = lambda g, r, n: np.linalg.solve(g + RIDGE * max(n, 1) * np.eye(len(r)) / FEATURES, r)
    held = [solve(gram[1 - f], right[1 - f], rows[1 - f]) for f in (0, 1)]
    if not rows.sum():
        return Model(mean, scale, projection, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = features(_stacked(batch, "x"), mean, scale, projection, phase), batch.column("fold").to_numpy()
            raw = np.where(fold == 0, z @ held[0], z @ held[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint((raw + 0.5) / 2 * BINS), 0, BINS).astype(np.int64)), batch.column("y").cast(pa.int64())], ["bin", "y"])

    counts = known.mapInArrow(binned, "bin long, y long").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()
    knots = isotonic(np.array([r.bin / BINS * 2 - 0.5 for r in counts]), np.array([r.p for r in counts], float), np.array([r.n for r in counts], float))
    return Model(mean, scale, projection, phase, solve(gram.sum(axis=0), right.sum(axis=0), rows.sum()), *knots)


def part(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")), F.lit(of))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs(doc_id, text)``.

    Labels are learned from ``labels(doc_id, label)`` of 0 or 1 only where crc32(doc_id) mod ``of`` is not ``held_out``. A null or
    empty text is scored like any other, by its statistics. A null doc_id is never learned from and counts as not held out; null
    labels are left out, repeated labels count as often as they occur. Only doc_id, text and the label are read.
    """
    x = measured(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(part(F.col("doc_id"), of) != held_out)
    model = fit(x.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                score = sent.value.scores(_stacked(some, "x"))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score)], ["doc_id", "score"])

    out = x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(part(F.col("doc_id"), of) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
