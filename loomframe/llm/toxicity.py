"""Toxicity scores by a classifier regularised with counterfactuals.

A text is a bag of its words and of the beginnings of its words. In labelled texts every identity term is swapped for others of its
group, and the fit penalises the squared change of the score between a text and its swapped twins, next to the usual logistic loss.
Neutral mentions of a group then do not raise the score, even where the labels would have it so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import common

#: Labelled documents that the fit reads at most (those of the least hash), and terms of the greatest z that a model keeps at most, both
#: parameters of ``scored``: what comes to the driver is bounded by their product.
MAX_LABELLED, MAX_TERMS = 12_000, 1500
#: Lengths in bytes of the word beginnings that count as terms of their own.
BEGINNINGS = (5, 6, 7)
#: Least difference in standard errors between the shares of toxic and other texts that hold a term, and least number of texts.
LEAST_Z, LEAST_TEXTS = 3.5, 3
RIDGE, TWIN_PENALTY = 2e-4, 1.0
THRESHOLD = 0.5

#: Identity terms; inside a group each can stand for the others. Fixed values.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"), ("black", "white", "asian", "latino", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "blind", "deaf"), ("old", "young"), ("mexican", "chinese", "american", "african"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("immigrés", "réfugiés"), ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados"),
)


def term_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, hash) of the words and of their beginnings, by kind."""
    out = [(np.arange(len(starts)), common.word_hashes(buf, starts, ends))]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        out.append((long, common.word_hashes(buf, starts[long], ends[long], n)))
    return out


def _terms_of(word: str) -> list[int]:
    raw = np.frombuffer(word.encode(), np.uint8)
    return [int(h[0]) for _, h in term_hashes(raw, np.array([0]), np.array([len(raw)])) if len(h)]


class Bags:
    """Counts of known terms for each text of a column."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.swaps = [[_terms_of(w) for w in group] for group in IDENTITY_GROUPS]
        self.whole = {t[0]: (g, k) for g, group in enumerate(self.swaps) for k, t in enumerate(group)}
        self.identity = np.sort(np.array(list(self.whole), dtype=np.uint64))

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """The terms' indices, -1 for unknown ones."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def read(self, column: pa.Array, twins: bool = False) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(first row, log1p of the counts of rows by terms, for each row the twins' differences)."""
        cuts = ((at, *piece) for at in range(0, len(column), 1024) for piece in common.pieces(column.slice(at, 1024), 1 << 20))
        for begin, lo, hi, buf, offsets in cuts:
            starts, ends, first = common.spans(buf, offsets, common.ALNUM)
            counts = np.zeros((hi - lo, max(len(self.terms), 1)), np.float32)
            kinds = term_hashes(buf, starts, ends)
            for at, hashes in kinds:
                col = self.columns(hashes)
                known = col >= 0
                row = np.searchsorted(first, at[known], side="right") - 1
                np.add.at(counts, (row, col[known]), 1)
            differences: list[np.ndarray] = []
            if twins:
                words = kinds[0][1]
                known = np.flatnonzero(np.isin(words, self.identity))
                row = np.searchsorted(first, known, side="right") - 1
                for r in range(hi - lo):
                    own = [self.whole[int(words[k])] for k in known[row == r].tolist()]
                    differences.append(self._twins(counts[r], own))
            yield begin + lo, np.log1p(counts), differences

    def _twins(self, counts: np.ndarray, own: list[tuple[int, int]]) -> np.ndarray:
        """For each way to turn the groups by one or more places, the change of the text's bag."""
        out = []
        for shift in range(1, max((len(self.swaps[g]) for g, _ in own), default=1)):
            new = counts.copy()
            for g, k in own:
                group = self.swaps[g]
                for sign, terms in ((-1, group[k]), (1, group[(k + shift) % len(group)])):
                    col = self.columns(np.array(terms, np.uint64))
                    np.add.at(new, col[col >= 0], sign)
            out.append(np.log1p(np.maximum(new, 0)) - np.log1p(counts))
        return np.array(out, np.float32).reshape(len(out), len(counts))


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch the terms' numbers of toxic and of other texts."""
    for batch in batches:
        y = batch.column(1).to_numpy()
        found: list[np.ndarray] = []
        toxic: list[np.ndarray] = []
        for lo, hi, buf, offsets in common.pieces(batch.column(0)):
            starts, ends, first = common.spans(buf, offsets, common.ALNUM)
            kinds = term_hashes(buf, starts, ends)
            for r in range(hi - lo):
                own = np.unique(np.concatenate([h[slice(*np.searchsorted(at, [first[r], first[r + 1]]))] for at, h in kinds]))
                found.append(own)
                toxic.append(np.full(len(own), y[lo + r] == 1))
        if found:
            terms, code = np.unique(np.concatenate(found), return_inverse=True)
            bad = np.bincount(code, weights=np.concatenate(toxic), minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(np.bincount(code, minlength=len(terms)) - bad)], ["term", "toxic", "other"])


def _design(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(terms)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, x, twins in bags.read(batch.column(0), twins=True):
                rows = [(int(y[lo + r]), x[r].astype(np.float16).tobytes(), twins[r].astype(np.float16).tobytes()) for r in range(len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["y", "x", "twins"])

    return run


def solve(x: np.ndarray, y: np.ndarray, twins: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean logistic loss + RIDGE |w|^2 / 2 + TWIN_PENALTY * mean (twins w)^2 / 2, by accelerated
    gradient steps from zero."""
    x, twins, y = (np.ascontiguousarray(m, np.float32) for m in (x, twins, y))  # one type throughout: no copies inside the loop
    n = max(len(y), 1)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, c = w.copy(), b
    norm = lambda m: float(np.einsum("ij,ij->", m, m)) / max(len(m), 1) if m.size else 0.0
    rate = np.float32(1 / (0.25 * (norm(x) + 1) + RIDGE + TWIN_PENALTY * norm(twins)))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + np.float32(c), -40, 40)))
        g = x.T @ (p - y) / np.float32(n) + np.float32(RIDGE) * v
        if len(twins):
            g = g + np.float32(TWIN_PENALTY / len(twins)) * (twins.T @ (twins @ v))
        w_new, b_new = v - rate * g, c - float(rate) * float((p - y).mean() if len(y) else 0)
        step = np.float32(k / (k + 3))
        v, c = w_new + step * (w_new - w), b_new + float(step) * (b_new - b)
        w, b = w_new, b_new
    return w, b


def fit(known: DataFrame, max_terms: int = MAX_TERMS) -> Model:
    """The model from ``known(text, y)``, with at most ``max_terms`` terms; without any row all scores are 0."""
    known = common.staged(known, "toxicity-known")
    total = known.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = int(total.p or 0), int(total.n)
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(1, np.float32), -40.0)
    counts = known.select("text", "y").mapInArrow(_present, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    share = (F.col("t") + F.col("o")) / F.lit(float(n))
    z = (F.col("t") / F.lit(float(max(p, 1))) - F.col("o") / F.lit(float(max(n - p, 1)))) / F.sqrt(share * (1 - share + F.lit(1.0 / n)) * F.lit(1.0 / max(p, 1) + 1.0 / max(n - p, 1)))
    best = counts.where(F.col("t") + F.col("o") >= LEAST_TEXTS).withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "term").limit(max_terms).select("term").collect()
    terms = np.sort(np.array([r.term for r in best], np.int64).view(np.uint64))
    x, y, twins = [], [], []
    for row in known.select("text", "y").mapInArrow(_design(terms), "y int, x binary, twins binary").toLocalIterator():
        y.append(row.y)
        x.append(np.frombuffer(row.x, np.float16))
        if row.twins:
            twins.append(np.frombuffer(row.twins, np.float16).reshape(-1, max(len(terms), 1)))
    design = np.array(x, np.float32)
    w, b = solve(design, np.array(y, np.float32), np.concatenate(twins).astype(np.float32) if twins else np.zeros((0, design.shape[1]), np.float32))
    return Model(terms, w, b)


def part(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")), F.lit(of))


def learned(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents: ``rows(doc_id, text)`` that ``known(doc_id, y)`` labels, one for each doc_id,
    text and label, those of the least hash. The bound counts documents that exist, each once, however often a row is repeated."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.select("doc_id", "h").join(known, "doc_id").distinct()
    chosen = common.staged(keys.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h", "y").limit(most), "toxicity-labels")
    return rows.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "y"]).select("text", "y")


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int = 5, held_out: int = 0, most: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs(doc_id, text)``.

    Labels are learned from ``labels(doc_id, label)`` of 0 or 1 only where crc32(doc_id) mod ``of`` is not ``held_out``, from at most
    ``most`` documents and with at most ``max_terms`` terms. A null or empty text gets the score of a text without terms. A null
    doc_id is never learned from and counts as not held out; null labels are left out, repeated labels and rows count once. Only
    doc_id, text and the label are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(part(F.col("doc_id"), of) != held_out)
    model = fit(learned(rows, known, most), max_terms)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(sent.value.terms)
        for batch in batches:
            for lo, x, _ in bags.read(batch.column(1)):
                raw = (x @ sent.value.weights).astype(np.float64) + sent.value.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(x)), pa.array(1 / (1 + np.exp(-np.clip(raw, -40, 40))))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(part(F.col("doc_id"), of) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
