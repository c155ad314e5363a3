"""Near-duplicate groups by MinHash, bands and odd sketches.

Each document becomes the set of its distinct word shingles. ``BANDS * ROWS`` MinHash samples give the band keys, and folding the
samples into a bitmap of parities gives the odd sketch: the population count of the XOR of two sketches is at most twice the number
of samples in which the documents differ. Documents with one set are one class, so exact copies cost one row each. Classes that
meet in a band and whose sketches are near form clusters; inside a cluster, blocks of full sets are compared exactly, and a block
returns no more than a spanning forest of its links, so no group is ever expanded into pairs. A large band or cluster is first
compared with a few representatives. What these connect needs no comparison with each other any more; only the rest meets all.

Chance of losing a link at the threshold itself: (1 - 0.85**4)**24 = 2e-8 by the bands, below 1e-8 by the sketch bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import common

SHINGLE = 5
BANDS, ROWS = 24, 4
SKETCH_BITS = 1024
#: Documents in one block of exact comparison, and band members in one block of sketch comparison.
SET_BLOCK, SKETCH_BLOCK = 96, 512
#: Representatives of a larger group.
PIVOTS = 4
#: The copies of one text are dealt to so many tasks where they get their component.
SALTS = 64


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than ``width`` make one shingle, no words none."""
    for lo, hi, buf, offsets in common.pieces(column):
        starts, ends, first = common.spans(buf, offsets, common.NOT_BLANK)
        words = common.word_hashes(buf, starts, ends)
        for k in range(hi - lo):
            own = words[first[k] : first[k + 1]]
            yield np.unique(common.runs(own, width)) if len(own) >= width else common.runs(own, len(own), seed=500 + len(own)) if len(own) else own


def samples(values: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """One MinHash sample for each multiplier."""
    best = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(values), 1024):
        np.minimum(best, (values[None, lo : lo + 1024] * odd[:, None]).min(axis=1), out=best)
    return best


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples, packed to bytes."""
    n, k = minima.shape
    bit = common.mix(minima + common.stream(77, k)[None, :]) >> np.uint64(64 - (SKETCH_BITS.bit_length() - 1))
    at = bit.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    return np.packbits(np.bincount(at.ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS).astype(np.uint8) & 1, axis=1)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of MinHash samples."""
    n = len(minima)
    grouped = minima.reshape(n, BANDS, ROWS)
    out = np.broadcast_to(common.stream(78, BANDS), (n, BANDS))
    for r in range(ROWS):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return out


def sketch_bound(threshold: float) -> int:
    """Largest population count that two documents at ``threshold`` reach with a chance above 1e-8: twice the differing samples."""
    k, p = BANDS * ROWS, 1 - threshold
    chance = [1.0]
    for j in range(k):
        chance.append(chance[-1] * (k - j) / (j + 1) * p / (1 - p))
    chance = [c * (1 - p) ** k for c in chance]
    tail = 0.0
    for j in range(k, 0, -1):
        tail += chance[j]
        if tail > 1e-8:
            return 2 * j
    return 0


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = common.stream(7, BANDS * ROWS) | np.uint64(1)
    seen = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            salts = (np.arange(part.num_rows) + seen) % SALTS
            seen += part.num_rows
            sizes, digests, minima = [], [], np.zeros((part.num_rows, len(odd)), np.uint64)
            for k, own in enumerate(shingle_sets(part.column(1))):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    minima[k] = samples(own, odd)
            keys = band_keys(minima).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            sketches = odd_sketch(minima)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), bands, pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array(salts.astype(np.int8))],
                ["doc_id", "rid", "n_shingles", "digest", "bands", "sketch", "salt"],
            )


SIGNATURE = "doc_id long, rid long, n_shingles long, digest binary, bands array<long>, sketch binary, salt tinyint"


class Forest:
    """Union-find over 0..n-1 that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal ``task``, and where each run begins (one more entry at the end), from sorted batches."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        task = table.column("task").to_numpy()
        at = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1])
        if at[-1]:
            yield table.slice(0, at[-1]), at
        rest = table.slice(at[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _edges(table: pa.Table, kept: list[tuple[int, int]]) -> pa.RecordBatch:
    """Pairs of rows of ``table`` as their nodes, and the task that met both."""
    ends = np.array(kept, np.int64).reshape(-1, 2)
    node, task = table.column("node").combine_chunks().cast(pa.binary()), table.column("task").to_numpy()
    return pa.RecordBatch.from_arrays([node.take(pa.array(ends[:, 0])), node.take(pa.array(ends[:, 1])), pa.array(task[ends[:, 0]])], ["a", "b", "task"])


LINK = "a binary, b binary, task long"


def _near_sketches(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _runs(batches):
            out: list[tuple[int, int]] = []
            sides = table.column("side").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(sides), -1)
            size = np.diff(at)
            two = at[:-1][size == 2]
            near = np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1) <= bound
            near &= (sides[two] < 0) | (sides[two] != sides[two + 1])
            out += [(a, a + 1) for a in two[near].tolist()]
            for lo, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                sketch, side, forest = sketches[lo : lo + n], sides[lo : lo + n], Forest(n)
                for a in range(n - 1):
                    near = np.bitwise_count(sketch[a + 1 :] ^ sketch[a]).sum(axis=1) <= bound
                    if side[a] >= 0:  # two blocks: only pairs across them, the rest is another task's
                        near &= side[a + 1 :] != side[a]
                    for b in np.flatnonzero(near).tolist():
                        forest.join(a, a + 1 + b)
                out += [(lo + a, lo + b) for a, b in forest.kept]
            yield _edges(table, out)

    return run


def _links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between full sets."""
    n, forest = len(sets), Forest(len(sets))
    size = np.array([len(s) for s in sets])
    if n <= 4:
        for a in range(n):
            for b in range(a + 1, n):
                lo, hi = sorted((len(sets[a]), len(sets[b])))
                if (side[a] < 0 or side[a] != side[b]) and 100 * lo >= percent * hi:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (lo + hi - both):
                        forest.join(a, b)
        return forest.kept
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    left = np.flatnonzero(side <= 0)
    right = np.flatnonzero(side != 0)
    both = np.zeros((len(left), len(right)), np.float32)
    column = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        both += block[left] @ block[right].T
    both = np.rint(both).astype(np.int64)
    hit = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
    for a, b in zip(*np.nonzero(hit), strict=True):
        if left[a] != right[b]:
            forest.join(int(left[a]), int(right[b]))
    return forest.kept


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _runs(batches):
            out: list[tuple[int, int]] = []
            side, members = table.column("side").to_numpy(), table.column("members")
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo > 1:
                    sets = [np.frombuffer(x, dtype=np.uint64) for x in members.slice(lo, hi - lo).to_pylist()]
                    out += [(lo + a, lo + b) for a, b in _links(sets, side[lo:hi], percent)]
            yield _edges(table, out)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [s.tobytes() for s in shingle_sets(part.column(3))]
            same = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, part.column(0).to_pylist(), strict=True)]  # rows may share a doc_id
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["node", "cluster", "n", "members"]).filter(pa.array(same, pa.bool_()))


def _parts(n: str, block: int) -> Column:
    return F.ceil(F.col(n) / F.lit(block)).cast("int")


def _own(parts: Column) -> Column:
    """The block of a node, of so many."""
    return F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")


def _dealt(tasks: DataFrame) -> DataFrame:
    return tasks.repartition("task").sortWithinPartitions("task", "node")


def linked(rows: DataFrame, key: str, payload: str, block: int, compare: Callable, label: str, large: bool, score: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect what ``compare`` links inside the groups of ``rows(node, key, n, payload)``, n being a group's size.

    A group of up to ``block`` rows is one task (side -1). Of a larger one, PIVOTS rows are compared with all: those of the highest
    ``score(node, score)`` in each of as many classes of nodes, or else of the highest hash. Rows that link with the same pivot are
    connected by it, so those of the pivot with most rows are not compared with each other; every other row meets all rows of the
    group, by blocks: two blocks are a task with sides 0 and 1. No pair is left out but those that a pivot has connected. ``large``:
    whether any group has more than ``block`` rows.
    """
    few = rows.where(F.col("n") <= block).select("node", F.xxhash64(key).alias("task"), F.lit(-1).alias("side"), payload)
    out = _dealt(few).mapInArrow(compare, LINK).select("a", "b")
    if not large:
        return out
    big = rows.where(F.col("n") > block)
    parts = _parts("n", block)
    ranked = big.select(key, "node", "n").join(score, "node") if score is not None else big.select(key, "node", "n", F.xxhash64("node", F.lit(1)).alias("score"))
    best = (F.max_by("node", F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(PIVOTS)) == q, F.struct("score", "node"))) for q in range(PIVOTS))
    pivots = ranked.groupBy(key).agg(F.array(*best).alias("pivots"), F.max("n").alias("n")).select(key, "n", F.explode(F.array_compact("pivots")).alias("node"))
    pivots = common.staged(pivots, f"{label}-chosen")
    many = big.select("node", F.xxhash64(F.col(key), _own(parts)).alias("task"), F.lit(0).alias("side"), payload)
    places = pivots.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(key, "node", F.xxhash64(F.col(key), "other").alias("task"))
    held = big.join(places, [key, "node"]).select("node", "task", F.lit(1).alias("side"), payload)
    star = common.staged(_dealt(many.unionByName(held)).mapInArrow(compare, LINK), f"{label}-pivots")
    pivots, places = (x.withColumnRenamed("node", "root") for x in (pivots.select(key, "node"), places))
    ends = star.select(F.col("a").alias("node"), F.col("b").alias("root"), "task").unionByName(star.select(F.col("b").alias("node"), F.col("a").alias("root"), "task"))
    # a link counts in the group whose task found it: one pivot may serve many groups
    roots = ends.join(places, ["task", "root"]).select(key, "node", "root").unionByName(pivots.select(key, F.col("root").alias("node"), "root")).groupBy(key, "node").agg(F.min("root").alias("root"))
    rooted = common.staged(big.select("node", key, "n").join(roots, [key, "node"], "left"), f"{label}-rooted")
    counts = rooted.groupBy(key, "root").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    main = counts.groupBy(key).agg(F.max_by("root", F.when(F.col("root").isNotNull(), F.struct("m", "root"))).alias("main"), F.coalesce(F.max(F.when(F.col("root").isNotNull(), F.col("m"))), F.lit(0)).alias("n_main"), F.max("n").alias("n"))
    main = main.where("n_main < n").withColumn("own", F.explode(F.sequence(F.lit(0), parts - 1)))  # a large group's rows find it by block
    told = rooted.withColumn("own", _own(parts)).join(main.drop("n"), [key, "own"]).withColumn("n_rest", F.col("n") - F.col("n_main"))
    told = told.select("node", key, F.coalesce(F.col("root") == F.col("main"), F.lit(False)).alias("in_main"), _parts("n_main", block).alias("mains"), _parts("n_rest", block).alias("rests"))
    rest = told.where("not in_main").withColumn("own", _own(F.col("rests")))
    same = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") == low, 0).otherwise(1)
    across = [
        same.select("node", key, F.xxhash64(F.col(key), F.lit("rest"), low, high).alias("task"), side.alias("side")),
        rest.where("mains > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("mains") - 1))).select("node", key, F.xxhash64(F.col(key), F.lit("main"), "own", "other").alias("task"), F.lit(0).alias("side")),
        told.where("in_main").withColumn("own", _own(F.col("mains"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select("node", key, F.xxhash64(F.col(key), F.lit("main"), "other", "own").alias("task"), F.lit(1).alias("side")),
    ]
    tasks = across[0].unionByName(across[1]).unionByName(across[2]).join(big.select("node", key, payload), ["node", key]).drop(key)
    met = _dealt(tasks.select("node", "task", F.col("side").cast("int").alias("side"), payload)).mapInArrow(compare, LINK)
    return out.unionByName(star.select("a", "b")).unionByName(met.select("a", "b"))


def _read(docs: DataFrame) -> DataFrame:
    """Only what is needed; rid finds a row's text again, also where doc_id is null."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("rid"))


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``: (doc_id, n_shingles, component_id, kept), one row for each input row.

    Two rows are linked when ``100 * |A & B| >= percent * |A | B|`` over their distinct 5-word shingles; component_id is the
    smallest doc_id that can be reached. Rows without words are linked with nothing. A row without doc_id links like any other but
    gives no component its name; kept is true where doc_id is component_id, and where neither is known. Other columns of ``docs``
    are ignored; repeated rows stay repeated.
    """
    with common.small_batches(docs.sparkSession):
        sig = common.staged(_read(docs).select("doc_id", "text", "rid").mapInArrow(_signatures, SIGNATURE), "neardup-sig")
    classes = common.staged(
        sig.where("digest is not null").groupBy(F.col("digest").alias("node")).agg(
            F.min("doc_id").alias("least_id"), F.min("rid").alias("rid"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies"), F.collect_set("salt").alias("salts"),
        ),
        "neardup-classes",
    )
    keys = classes.select("node", F.explode("bands").alias("band"))
    full = common.staged(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "neardup-bands")
    shared = common.staged(common.among(keys, "band", full).join(full, "band"), "neardup-shared")
    met = shared.join(classes.select("node", "sketch"), "node")
    above = lambda sizes, block: bool(sizes.where(F.col("n") > block).limit(1).count())
    near = linked(met, "band", "sketch", SKETCH_BLOCK, _near_sketches(sketch_bound(percent / 100)), "neardup-sketches", above(full, SKETCH_BLOCK))
    clusters = common.components(near, "neardup-near")
    sized = clusters.groupBy("root").agg(F.count("*").alias("n"))
    wanted = clusters.join(sized, "root").join(classes.select("node", "rid"), "node").select("rid", "node", F.col("root").alias("cluster"), "n")
    sets = common.among(_read(docs).select("rid", "text"), "rid", wanted).join(wanted, "rid").select("node", "cluster", "n", "text").mapInArrow(_members, "node binary, cluster binary, n long, members binary")
    score, large = None, above(sized, SET_BLOCK)
    with common.small_batches(docs.sparkSession):
        if large:
            sets = common.staged(sets, "neardup-sets")
            score = shared.groupBy("node").agg(F.sum("n").alias("score"))  # the original of many copies shares bands with most
        exact = linked(sets, "cluster", "members", SET_BLOCK, _exact(percent), "neardup-sets", large, score)
        links = common.components(exact, "neardup-links")
    named = links.join(classes.select("node", "least_id"), "node")
    joined = links.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "component_id")
    copies = classes.where("copies > 1").join(joined, "node", "left_anti").select("node", F.col("least_id").alias("component_id"))
    cells = joined.unionByName(copies).join(classes.select("node", "salts"), "node").select(F.col("node").alias("digest"), "component_id", F.explode("salts").alias("salt"))
    known = sig.where("digest is not null").select("doc_id", "n_shingles", "digest", "salt").join(cells, ["digest", "salt"], "left").select("doc_id", "n_shingles", "component_id")
    out = known.unionByName(sig.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    name = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.col("doc_id").isNull() & name.isNull()).alias("kept"))


#: DuckDB SQL for ``groups`` at 85 per cent: all pairs of different sets that share a shingle, and everything that can be reached.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingles FROM d
),
c AS (SELECT rid, doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS class, shingles FROM s),
classes AS (SELECT class, any_value(n) AS n, any_value(shingles) AS shingles, min(doc_id) AS least FROM c WHERE n > 0 GROUP BY class),
each AS (SELECT class, n, unnest(shingles) AS shingle FROM classes),
links AS (SELECT a.class AS x, b.class AS y FROM each a JOIN each b ON a.shingle = b.shingle AND a.class < b.class GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT class, class FROM classes UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
named AS (SELECT reach.x AS class, min(least) AS component_id FROM reach JOIN classes ON reach.y = classes.class GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(doc_id = coalesce(component_id, doc_id), doc_id IS NULL AND component_id IS NULL) AS kept
FROM c LEFT JOIN named USING (class)
"""
