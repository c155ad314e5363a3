"""Benchmark decontamination over a positional inverted index.

The corpus is cut into shards of whole documents, and each shard's index is one row: for every term the sorted list of its positions,
with a gap between documents. A phrase is found by taking the positions of its rarest term, moved back by the term's offset, and
intersecting them with the other terms' moved lists from rare to common; proximity takes the rarest term's positions and asks the
other lists for neighbours. Each shard holds whole documents, so nothing is shuffled, and the index is a table that any number of
test sets can be searched in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import common

WINDOW = 13
#: Test items are searched in blocks of at most this many bytes of text, one block broadcast at a time; an index for more distinct
#: terms than this many bytes of hashes holds every term of the corpus.
BLOCK_BYTES = 4 << 20
INDEX = "shard long, doc_ids binary, n_words binary, terms binary, ends binary, positions binary"


def _packed(ids: pa.Array) -> bytes:
    """The documents' ids, of whatever type, as an Arrow stream."""
    batch = pa.RecordBatch.from_arrays([ids], ["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _index(terms: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, buf, offsets in common.pieces(batch.column(1)):
                starts, ends, first = common.spans(buf, offsets, common.ALNUM)
                words = common.word_hashes(buf, starts, ends)
                counts = np.diff(first)
                place = np.arange(len(words)) + np.repeat(np.arange(hi - lo), counts)  # a gap of one after each document
                if terms is not None:
                    at = np.minimum(np.searchsorted(terms, words), max(len(terms) - 1, 0))
                    known = terms[at] == words if len(terms) else np.zeros(len(words), bool)
                    words, place = words[known], place[known]
                order = np.argsort(words, kind="stable")
                words, place = words[order], place[order]
                edge = np.flatnonzero(np.concatenate([words[1:] != words[:-1], [True]])) + 1 if len(words) else np.zeros(0, np.int64)
                row = [[shard], [_packed(batch.column(0).slice(lo, hi - lo))], [counts.astype(np.int64).tobytes()], [words[edge - 1].tobytes()], [edge.astype(np.int64).tobytes()], [place.astype(np.int32).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], ["shard", "doc_ids", "n_words", "terms", "ends", "positions"])
                shard += 1

    return run


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """The staged index of ``docs(doc_id, text)``, doc_id of any type: one row a shard. ``terms``: the only term hashes to keep; None
    keeps all."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sent = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _index(None if sent is None else sent.value)(batches)

    return common.staged(rows.mapInArrow(run, INDEX), "decontam-index")


@dataclass
class Phrases:
    """Distinct windows of test items, grouped by width; ``owners`` names the items of each. Windows of a width stand in the order of
    their anchors, the term of each that the fewest windows hold, and ``anchors`` says where each term's begin."""

    terms: np.ndarray
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    owners: dict[int, list[list[str]]] = field(default_factory=dict)
    anchors: dict[int, np.ndarray] = field(default_factory=dict)


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Term hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi, buf, offsets in common.pieces(pa.array(texts, pa.string())):
        starts, ends, first = common.spans(buf, offsets, common.ALNUM)
        words = common.word_hashes(buf, starts, ends)
        out += [words[first[k] : first[k + 1]] for k in range(hi - lo)]
    return out


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of ``window`` consecutive words of each (item_id, text); an item of fewer words, but not none, is one window.
    Items without an id or without words are left out."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for (name, _), words in zip(items, item_words([t for _, t in items]), strict=True):
        width = min(window, len(words))
        if name is not None and width:
            for k in range(len(words) - width + 1):
                found.setdefault(width, {}).setdefault(words[k : k + width].tobytes(), set()).add(str(name))
    rows = {w: np.frombuffer(b"".join(d), dtype=np.uint64).reshape(-1, w) for w, d in found.items()}
    terms = np.unique(np.concatenate([r.ravel() for r in rows.values()])) if rows else np.zeros(0, np.uint64)
    out = Phrases(terms)
    for width, hashes in rows.items():
        held = np.searchsorted(terms, hashes).astype(np.int32)
        often = np.bincount(held.ravel(), minlength=len(terms))
        anchor = held[np.arange(len(held)), often[held].argmin(axis=1)]
        order = np.argsort(anchor, kind="stable")
        owners = [sorted(s) for s in found[width].values()]
        out.windows[width], out.owners[width] = held[order], [owners[k] for k in order.tolist()]
        out.anchors[width] = np.searchsorted(anchor[order], np.arange(len(terms) + 1))
    return out


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict, terms: np.ndarray):
        self.ids = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        own, self.ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32)
        at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
        self.slot = np.where(own[at] == terms, at, -1) if len(own) else np.full(len(terms), -1)
        size = np.diff(np.concatenate([[0], self.ends]))
        self.sizes = np.where(self.slot >= 0, size[self.slot], 0) if len(own) else np.zeros(len(terms), np.int64)

    def postings(self, term: int) -> np.ndarray:
        k = self.slot[term]
        return self.positions[self.ends[k - 1] if k else 0 : self.ends[k]]

    def present(self, p: Phrases, width: int) -> list[int]:
        """The windows whose terms all occur in this shard, among those whose anchor does."""
        edge = p.anchors[width]
        known = np.flatnonzero((self.sizes > 0) & (edge[1:] > edge[:-1]))
        size = edge[known + 1] - edge[known]
        some = np.arange(size.sum()) + np.repeat(edge[known] - (np.cumsum(size) - size), size)
        return some[(self.sizes[p.windows[width][some]] > 0).all(axis=1)].tolist()

    def exact(self, window: np.ndarray) -> np.ndarray:
        """Positions at which the phrase begins."""
        order = np.argsort(self.sizes[window], kind="stable").tolist()
        found = self.postings(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.postings(window[k])
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k]
        return found

    def near(self, window: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Shortest spans (begin, end) of at most ``within`` words that hold every term of the phrase as often as it does, in any
        order and inside one document; each begins at another position."""
        need: dict[int, int] = {}
        for t in window.tolist():
            need[t] = need.get(t, 0) + 1
        terms = sorted(need, key=lambda t: self.sizes[t])
        anchors = self.postings(terms[0])
        for t in terms[1:]:  # an anchor stays while the list has enough neighbours
            own = self.postings(t)
            anchors = anchors[np.searchsorted(own, anchors + within) - np.searchsorted(own, anchors - within + 1) >= need[t]]
        out: set[tuple[int, int]] = set()
        for anchor in anchors.tolist():
            doc = int(np.searchsorted(self.base, anchor, side="right")) - 1
            lo, hi = max(anchor - within + 1, int(self.base[doc])), min(anchor + within, int(self.base[doc + 1]) - 1)
            events = sorted((p, t) for t in terms for p in self.postings(t)[slice(*np.searchsorted(self.postings(t), [lo, hi]))].tolist())
            have, missing, left = dict.fromkeys(terms, 0), len(terms), 0
            for p, t in events:
                have[t] += 1
                missing -= have[t] == need[t]
                while not missing:
                    begin, s = events[left]
                    if have[s] == need[s]:
                        if p - begin < within and begin <= anchor <= p:
                            out.add((begin, p + 1))
                        missing += 1
                    have[s] -= 1
                    left += 1
        return sorted(out)


def _shards(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(j)[k].as_buffer() if j else batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}
            yield row["shard"], Shard(row, terms)


def _matches(sent, within: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = sent.value
        for _, shard in _shards(batches, p.terms):
            out = []
            for width, windows in p.windows.items():
                for w in shard.present(p, width):
                    spans = [(b, b + width) for b in shard.exact(windows[w]).tolist()] if within is None else shard.near(windows[w], within)
                    for begin, end in spans:
                        d = int(np.searchsorted(shard.base, begin, side="right")) - 1
                        out += [(shard.ids[d].as_py(), item, int(begin - shard.base[d]), int(end - begin)) for item in p.owners[width][w]]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (shard.ids.type, pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "start", "length"])

    return run


def matches(index: DataFrame, items: list[tuple[object, str | None]], window: int = WINDOW, within: int | None = None, id_type: str = "long") -> DataFrame:
    """(doc_id, item_id, start, length) of each occurrence of a window; with ``within``, of each shortest span of at most so many
    words that holds the window's words in any order. Positions count words from 0."""
    sent = index.sparkSession.sparkContext.broadcast(phrases(items, window))
    return index.mapInArrow(_matches(sent, within), f"doc_id {id_type}, item_id string, start long, length long")


def _covered(sent):
    """For each document of a shard: spans covered by any occurrence, disjoint and sorted, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = sent.value
        for number, shard in _shards(batches, p.terms):
            n = len(shard.ids)
            step = np.zeros(int(shard.base[-1]) + 1, np.int32)
            items: dict[int, set[str]] = {}
            for width, windows in p.windows.items():
                for w in shard.present(p, width):
                    begin = shard.exact(windows[w])
                    if len(begin):
                        np.add.at(step, begin, 1)
                        np.add.at(step, begin + width, -1)
                        for d in np.unique(np.searchsorted(shard.base, begin, side="right") - 1).tolist():
                            items.setdefault(d, set()).update(p.owners[width][w])
            hit = np.cumsum(step) > 0
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            first = np.searchsorted(begins, shard.base)
            spans = [None if first[d] == first[d + 1] else np.stack([begins[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]], axis=1).ravel() - shard.base[d] for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * n, pa.int64()), pa.array(np.arange(n)), shard.ids, pa.array(shard.n_words),
                    pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                ],
                ["shard", "row", "doc_id", "n_words", "spans", "items"],
            )

    return run


COVERED = "shard long, row long, doc_id {}, n_words long, spans array<long>, items array<string>"


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for begin, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merged(x) if x else [] for x in batch.column(2).to_pylist()]
        n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        items = [sorted(set(x or ())) for x in batch.column(3).to_pylist()]
        n_words = batch.column(1).to_pylist()
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The test items (item_id, text) in blocks of bounded size, read partition by partition."""
    block, held = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text or "") + 16
        if held > limit:
            yield block
            block, held = [], 0
    yield block


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of ``docs(doc_id, text)``.

    Words are runs of ASCII letters, digits and all other non-ASCII characters, with A-Z lower-cased. A document word inside any
    occurrence of an item's window is hit; contaminated if any is and they are a twentieth of the words. A null or empty text has no
    words; items without id or words match nothing; repeated rows and null doc_ids each give their own row; other columns are
    ignored. ``key``: what stands for doc_id, of any type. Several blocks of items are searched one after the other in the same
    index, each result written before the next block is broadcast, and their spans merged for each document.
    """
    spark = docs.sparkSession
    docs = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    covered = COVERED.format(id_type)
    terms, blocks, size, first = np.zeros(0, np.uint64), 0, 0, None
    for block in item_blocks(items, block_bytes):
        p = phrases(block, window)
        first = p if first is None else first
        blocks += 1
        size += p.terms.nbytes
        terms = np.union1d(terms, p.terms) if size <= block_bytes else terms
    index = build_index(docs, terms if size <= block_bytes else None)
    if blocks == 1:
        found = index.mapInArrow(_covered(spark.sparkContext.broadcast(first)), covered)
    else:
        found = None
        for block in item_blocks(items, block_bytes):
            sent = spark.sparkContext.broadcast(phrases(block, window))
            part = common.staged(index.mapInArrow(_covered(sent), covered), "decontam-block")
            sent.destroy()
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(_summed, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


#: DuckDB SQL for ``contamination`` with windows of WINDOW words.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({WINDOW}, len(w)) AS width
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0
),
items AS (SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS told FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM b)),
windows AS (SELECT rid, width, i, array_to_string(w[i:i + width - 1], ' ') AS told FROM (SELECT rid, w, width, unnest(range(1, CAST(len(w) - width + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT width FROM b))),
met AS (SELECT rid, width, i, item_id FROM windows JOIN items USING (width, told)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM met) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
