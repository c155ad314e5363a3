"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document belongs to one or more sources. Documents with the same memberships form a pattern with one summed size. The flow routes
the patterns' words to the sources' quotas: a pattern's k-th pass costs more than the one before it (convex costs), and no more than
``max_passes`` passes exist, so the cheapest flow spreads repetition as evenly as the quotas allow. The flow sees only patterns and
sources, never documents. A pattern that is routed q words gives q // size whole passes of all its documents and a seeded part of one
more: documents in hash order until the words are reached.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm import common

#: A pattern's hashes are cut into ranges, and the range with the boundary is cut again, so that about this many rows are left there;
#: only those are sorted.
EDGE_ROWS = 500
PLACES = 24
#: Distinct membership patterns that the flow on the driver may have.
MAX_PATTERNS = 100_000

Pattern = tuple[object, ...]


def n_words(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[object, int], weights: list[float], most: float = 3.0) -> dict[object, float]:
    """Words wanted from each source: weights repeat over the sources in order of code points (null last) and share all words; no
    target is above ``most`` times its source's size, and what is cut is shared again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in str(s)] if s is not None else []))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    out: dict[object, float] = {}
    left, open_ = float(sum(sizes.values())), set(names)
    while open_:
        share = sum(weight[s] for s in names if s in open_)
        over = [s for s in names if s in open_ and left * weight[s] / share > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / share for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def route(patterns: dict[Pattern, int], quotas: dict[object, int], costs: list[int]) -> dict[tuple[Pattern, object], int]:
    """Words that each pattern gives each of its sources: the cheapest of the largest flows.

    Arcs: start to pattern, one for each pass with the pattern's size as capacity and ``costs[k]`` a word; pattern to each of its
    sources; source to end with the quota. Only first arcs cost anything, so a cheapest augmenting path is any path whose first arc
    is cheapest: passes are opened in the order of their costs, and after each the flow is augmented until no path is left, by
    blocking flows along shortest paths. Quotas that cannot be reached are filled as far as they can be.
    """
    names = list(patterns)
    member = [[s for s in p if s in quotas] for p in names]
    users: dict[object, list[int]] = {s: [] for s in quotas}
    for i, own in enumerate(member):
        for s in own:
            users[s].append(i)
    flow = {(i, s): 0 for i, own in enumerate(member) for s in own}
    left, room = dict(quotas), [0] * len(names)
    for _ in sorted(costs):
        room = [r + patterns[p] for r, p in zip(room, names, strict=True)]
        while _augmented(member, users, flow, left, room):
            pass
    return {(names[i], s): f for (i, s), f in flow.items()}


def _augmented(member: list[list], users: dict[object, list[int]], flow: dict[tuple[int, object], int], left: dict[object, int], room: list[int]) -> bool:
    """Push a blocking flow along the shortest paths from patterns with room to sources with quota left; False if there is no path.

    A path goes from a pattern to a source and, against words that another pattern gives that source, back to that pattern.
    """
    starts = [i for i, own in enumerate(member) if own and room[i] > 0]
    depth: dict[object, int] = {("p", i): 0 for i in starts}
    now, reached, d = starts, False, 0
    while now and not reached:
        met = []
        for i in now:
            for s in member[i]:
                if ("s", s) not in depth:
                    depth["s", s] = d + 1
                    met.append(s)
                    reached |= left[s] > 0
        now = []
        for s in [] if reached else met:
            for i in users[s]:
                if flow[i, s] > 0 and ("p", i) not in depth:
                    depth["p", i] = d + 2
                    now.append(i)
        d += 2
    if not reached:
        return False
    tried: dict[object, int] = {}
    for first in starts:
        path: list[tuple[str, object]] = [("p", first)]
        while path and room[first] > 0:
            kind, x = path[-1]
            if kind == "s" and left[x] > 0:
                back = [(path[k + 1][1], path[k][1]) for k in range(1, len(path) - 1, 2)]
                push = min([room[first], left[x], *(flow[a] for a in back)])
                room[first] -= push
                left[x] -= push
                for a in back:
                    flow[a] -= push
                for k in range(0, len(path), 2):
                    flow[path[k][1], path[k + 1][1]] += push
                path = [("p", first)]
                continue
            ways = member[x] if kind == "p" else users[x]
            to = "s" if kind == "p" else "p"
            k = tried.get((kind, x), 0)
            while k < len(ways) and not (depth.get((to, ways[k])) == depth[kind, x] + 1 and (kind == "p" or flow[ways[k], x] > 0)):
                k += 1
            tried[kind, x] = k
            if k < len(ways):
                path.append((to, ways[k]))
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1
    return True


def _boundary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of the one range that holds a pattern's boundary: in hash order, each is taken while its words still fit; what then is
    left goes to the smallest other row if that brings the sum nearer."""
    pdf = pdf.sort_values(["hash", "size"], kind="stable", na_position="last")
    left, more = int(pdf["left"].iloc[0]), []
    for size in pdf["size"]:
        more.append(int(0 < size <= left))
        left -= size * more[-1]
    pdf["more"] = more
    rest = pdf[(pdf["more"] == 0) & (pdf["size"] > 0)]
    if len(rest) and 2 * left > (least := rest["size"].min()):
        pdf.loc[rest.index[rest["size"] == least][:1], "more"] = 1
    return pdf[["doc_id", "key", "size", "base", "more"]]


def mix(docs: DataFrame, weights: list[float], sources: Column | None = None, max_passes: int = 3, seed: int = 17, key: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken), one row for each row of ``docs``.

    ``docs`` has doc_id and text, and a source, or with ``sources`` an array of them. size counts words; a null or empty text has none
    and is never repeated. taken is repeats times size, repeats at most ``max_passes``. For a row of several sources source_size and
    target are summed over them, and source is their list joined with commas. A null source is a source of its own, last in order.
    The order in which rows are taken hashes doc_id and text, so rows that share a doc_id are chosen apart; equal rows in the boundary
    range may differ in repeats by one. ``key``: what stands for doc_id, of any type that hashes.
    """
    member = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(sources))
    text = F.col("text").cast("string")
    key = F.col("doc_id").cast("long") if key is None else key
    rows = docs.select(key.alias("doc_id"), member.alias("pattern"), n_words(text).alias("size"), F.xxhash64(key, text, F.lit(seed)).alias("hash"))
    rows = common.staged(rows, "mixing-rows")
    summed = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_PATTERNS + 1).collect()
    if len(summed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.pattern): int(r["size"]) for r in summed}
    ranges = {tuple(r.pattern): min(1 << PLACES // 2, math.isqrt(r["rows"] // EDGE_ROWS) + 1) for r in summed}
    size: dict[object, int] = {}
    for p, n in patterns.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    want = targets(size, weights, max_passes)
    flow = route(patterns, {s: round(t) for s, t in want.items()}, [4**k for k in range(max_passes)])
    given = {p: sum(flow.get((p, s), 0) for s in p) for p in patterns}
    plan = [(list(p), sum(size[s] for s in p), float(sum(want[s] for s in p)), given[p] // n if n else 0, given[p] % n if n else 0, ranges[p]) for p, n in patterns.items()]
    plan = docs.sparkSession.createDataFrame(plan, "pattern array<string>, source_size long, target double, base long, part long, ranges long")
    key = F.to_json("pattern")
    known = rows.withColumn("key", key).join(F.broadcast(plan.withColumn("key", key).drop("pattern")), "key")
    place = F.shiftrightunsigned("hash", 64 - PLACES) * F.col("ranges")
    known = known.withColumn("outer", F.shiftright(place, PLACES).cast("int")).withColumn("inner", F.shiftright(place.bitwiseAND(F.lit((1 << PLACES) - 1)) * F.col("ranges"), PLACES).cast("int"))
    wide = known.groupBy("key", "outer").agg(F.sum("size").alias("n"))
    edge = _edge(wide, plan.withColumn("key", key).select("key", "part"), "outer")
    fine = known.join(F.broadcast(edge.select("key", "outer", F.col("before").alias("outer_before"))), ["key", "outer"]).groupBy("key", "outer_before", "part", "inner").agg(F.sum("size").alias("n"))
    edge = edge.join(_edge(fine.select("key", "inner", "n"), fine.select("key", (F.col("part") - F.col("outer_before")).alias("part")).distinct(), "inner").select("key", "inner", F.col("before").alias("inner_before")), "key")
    edge = edge.select("key", F.col("outer").alias("edge_outer"), F.col("inner").alias("edge_inner"), (F.col("before") + F.col("inner_before")).alias("before"))
    edge = common.staged(edge, "mixing-edge")
    told = known.join(F.broadcast(edge), "key", "left")
    below = (F.col("outer") < F.col("edge_outer")) | ((F.col("outer") == F.col("edge_outer")) & (F.col("inner") < F.col("edge_inner")))
    same = (F.col("outer") == F.col("edge_outer")) & (F.col("inner") == F.col("edge_inner"))
    told = told.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("more", F.coalesce(below, F.lit(False)).cast("int"))
    shape = ["doc_id", "key", "size", "base", "more"]
    ragged = told.where("same").select("doc_id", "key", "size", "base", "hash", (F.col("part") - F.col("before")).alias("left"))
    dealt = ragged.groupBy("key").applyInPandas(_boundary, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key string, size long, base long, more int")
    out = told.where(~F.col("same")).select(*shape).unionByName(dealt.select(*shape)).join(F.broadcast(plan.withColumn("key", key).select("key", F.array_join("pattern", ",").alias("source"), "source_size", "target")), "key")
    repeats = F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))


def _edge(sums: DataFrame, part: DataFrame, level: str) -> DataFrame:
    """For each key the range in which the running sum of ``n`` passes ``part``, and the sum before it."""
    running = sums.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy(level)) - F.col("n"))
    held = running.join(F.broadcast(part), "key").where((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("n")))
    return held.select("key", level, "before")
