import hashlib
import itertools
import math
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import chat, common, decontam, html, licenses, mixing, neardup, quality, queries, rules, sharding, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int, _text string, rejected_by string, node int, _key int, _row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, blank, very long, repeated, equal and near-equal texts, null ids and sources, and columns that clash."""
    base = text(1, 200)
    near = base.replace(base.split()[100], "changed")
    long = text(2, 60_000)
    rows = [
        (1, base, "b"), (2, base.upper(), "a"), (3, near, None), (4, None, "a"), (5, "", "a"), (6, " \t\n", "b"), (7, "one two", "a"), (8, "one two", "a"), (8, "one two", "a"),
        (None, base, "a"), (None, "solo text without id " + text(3), "b"), (9, long, "a"), (10, long + " more", "b"), (11, "### ### $$$ " * 30, "a"), (12, "same line of words\n" * 40, "b"),
        (13, text(4, 12), "a"), (14, "Ünïcödé 日本 " + text(5, 30), "b"), *((20 + k, text(100 + k, 30 + k), "abc"[k % 3]) for k in range(40)),
    ]
    return spark.createDataFrame([(*r, 1, "x", "x", 1, 1, 1) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def got(df):
    return [r.asDict() for r in df.collect()]


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


# --- words as numbers --------------------------------------------------------------------------------------------


def test_words_are_cut_and_hashed_like_python(docs):
    texts = ["A b", None, "", "x", "x\ty z\x0b\x0cq", " lead", "é É", "a" * 3000]
    for lo, hi, buf, offsets in common.pieces(pa.array(texts), 8):
        starts, ends, first = common.spans(buf, offsets, common.NOT_BLANK)
        for k in range(hi - lo):
            own = [bytes(buf[a:b]).decode().translate({c: c + 32 for c in range(65, 91)}) for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert own == words(texts[lo + k])
    one = lambda w: int(common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    assert one(b"ABC") == one(b"abc") != one(b"abd") and one(b"ab") != one(b"ba")
    assert int(common.word_hashes(np.frombuffer(b"abcdef", np.uint8), np.array([0]), np.array([6]), 3)[0]) == one(b"abc")


@pytest.mark.parametrize("most", [common.SALT_EDGES, 3])
def test_components_name_each_node_by_the_least(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SALT_EDGES", most)
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    df = spark.createDataFrame([(bytearray(a.to_bytes(2, "big")), bytearray(b.to_bytes(2, "big"))) for a, b in edges], "a binary, b binary")
    roots = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in common.components(df, "t").collect()}
    assert roots == {k: 1 for k in range(1, 31)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert common.components(df.where("1 = 0"), "t").count() == 0


# --- 1 chat ------------------------------------------------------------------------------------------------------


def test_chat_rotates_every_perspective(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann lee", "hi"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, None, "bob", None), (2, 0, "system", "alone"), (None, 0, "bob", "lost"), (3, 500, None, "ünï")]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, block int, people int")
    out = got(chat.rotated(turns))
    for conv, who in {(r["conv_id"], r["perspective"]) for r in out}:
        own = sorted((r for r in out if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["position"])
        whole = "".join(r["segment"] for r in own)
        assert [r["position"] for r in own] == list(range(len(own))) and own[-1]["end"] == len(whole)
        for r in own:
            assert whole[r["start"] : r["end"]] == r["segment"]
            if r["mask_start"] is not None:
                assert r["role"] == "assistant" and r["segment"].split("\n", 1)[1] == whole[r["mask_start"] : r["mask_end"]] + "\n"
    assert {(r["conv_id"], r["perspective"]) for r in out} == {(1, "ann_lee"), (1, "bob"), (3, "unknown")}
    bob = [r for r in out if r["conv_id"] == 1 and r["perspective"] == "bob"]
    assert sorted((r["role"], r["name"] or "") for r in bob) == [("assistant", "")] * 3 + [("system", ""), ("user", "ann_lee")]
    assert chat.rotated(turns.where("1 = 0")).count() == 0


def same_as_sql(spark, name):
    sql, df = queries.ORACLE[name], queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.sql(sql)
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(map(str, ([r[k] for k in order] for r in found.fetchall()))) == sorted(map(str, (list(r) for r in df.collect())))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_agree_with_their_sql(spark, name):
    same_as_sql(spark, name)


# --- 2 mixing ----------------------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_the_source():
    want = mixing.targets({"a": 10, "b": 500, None: 490}, [5.0, 2.0, 1.0])
    assert want["a"] == 30 and want["b"] == pytest.approx(970 * 2 / 3) and sum(want.values()) == pytest.approx(1000)
    assert list(mixing.targets({None: 1, "b": 1, "a": 1}, [5.0, 2.0, 1.0]).values()) and mixing.targets({}, [1.0]) == {}
    assert mixing.targets({"a": 0, "b": 0}, [1.0]) == {"a": 0, "b": 0}


def test_flow_spreads_repetition_over_overlapping_sources():
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 60}, [1, 4, 16])
    assert sum(f for (_, s), f in flow.items() if s == "a") == 150 and sum(f for (_, s), f in flow.items() if s == "b") == 60
    for p, n in {("a",): 100, ("a", "b"): 100, ("b",): 10}.items():
        assert sum(f for (q, _), f in flow.items() if q == p) <= n  # one pass of everything is enough, so nothing is repeated
    assert mixing.route({("a",): 10}, {"a": 25}, [1, 4, 16]) == {(("a",), "a"): 25}
    assert mixing.route({("a",): 10}, {"a": 99}, [1, 4, 16]) == {(("a",), "a"): 30}


def test_mix_comes_near_its_targets(docs, empty):
    out = got(mixing.mix(docs, [5.0, 2.0, 1.0]))
    assert len(out) == docs.count() and sorted(r["size"] for r in out) == sorted(len(words(r.text)) for r in docs.collect())
    assert all(0 <= r["repeats"] <= 3 and r["taken"] == r["repeats"] * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, got(mixing.mix(docs.repartition(2), [5.0, 2.0, 1.0]))))
    assert mixing.mix(empty, [1.0]).count() == 0


def test_mix_of_many_documents_and_overlaps(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7919 % 97)), "h" if k % 3 else "t") for k in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1.0, 4.0])
    for r in out.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect():
        assert abs(r.k - r.t) <= 97
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1.0, 1.0], F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    told = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("repeats").alias("least"), F.max("repeats").alias("most")).collect()}
    want = mixing.targets({"a": told["a,b"]["size"], "b": told["a,b"]["size"] + told["b"]["size"]}, [1.0, 1.0])
    assert set(told) == {"a,b", "b"} and abs(told["a,b"].taken + told["b"].taken - sum(want.values())) <= 2 * 97  # quotas are met within a document for each pattern
    assert told["a,b"].taken >= want["a"] - 97  # source a is made of this pattern alone
    assert all(r.most - r.least <= 1 for r in told.values())  # convex costs: no document gets a third pass before all have a second


def brute_flow(patterns, quotas, costs):
    """(words, cost) of the cheapest of the largest flows, by trying them all."""
    arcs = [(p, s) for p in patterns for s in p if s in quotas]
    best = (0, 0)
    for given in itertools.product(*(range(min(patterns[p] * len(costs), quotas[s]) + 1) for p, s in arcs)):
        by_p, by_s = {}, {}
        for (p, s), g in zip(arcs, given, strict=True):
            by_p[p], by_s[s] = by_p.get(p, 0) + g, by_s.get(s, 0) + g
        if all(by_p[p] <= patterns[p] * len(costs) for p in by_p) and all(by_s[s] <= quotas[s] for s in by_s):
            cost = sum(sorted(costs)[k // patterns[p]] for p, n in by_p.items() for k in range(n))
            best = max(best, (sum(given), -cost))
    return best[0], -best[1]


def test_flow_is_the_cheapest_of_the_largest():
    rng = np.random.default_rng(4)
    shapes = [("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "c"), ("c",)]
    for _ in range(60):
        patterns = {shapes[k]: int(rng.integers(0, 4)) for k in rng.choice(6, rng.integers(1, 4), replace=False)}
        quotas = {s: int(rng.integers(0, 7)) for s in "abc"}
        flow = mixing.route(patterns, quotas, [1, 4, 16])
        by_p = {p: sum(f for (q, _), f in flow.items() if q == p) for p in patterns}
        assert all(0 <= n <= 3 * patterns[p] for p, n in by_p.items()) and all(f >= 0 for f in flow.values())
        assert all(sum(f for (_, s), f in flow.items() if s == x) <= q for x, q in quotas.items())
        cost = sum([1, 4, 16][k // patterns[p]] for p, n in by_p.items() for k in range(n))
        assert (sum(by_p.values()), cost) == brute_flow(patterns, quotas, [1, 4, 16])


def test_flow_over_many_patterns_ends_soon():
    patterns = {(f"s{k:05d}", f"s{(k * 7 + 1) % 20_000:05d}"): 10 + k % 13 for k in range(20_000)} | {(f"s{k:05d}",): 5 for k in range(20_000)}
    quotas = {f"s{k:05d}": 20 for k in range(20_000)}
    flow = mixing.route(patterns, quotas, [1, 4, 16])
    given = {}
    for (_, s), f in flow.items():
        given[s] = given.get(s, 0) + f
    assert given == quotas


def brute_mix(rows, weights):
    """repeats of each row (doc_id, text, source) of one source each, by hash order, ranges and the greedy boundary."""
    import xxhash

    def h(i, t):
        x = 42 if i is None else xxhash.xxh64_intdigest(i.encode() if isinstance(i, str) else i.to_bytes(8, "little"), 42)
        x = x if t is None else xxhash.xxh64_intdigest(t.encode(), x)
        return xxhash.xxh64_intdigest((17).to_bytes(4, "little"), x)

    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    want, out = mixing.targets(size, weights), []
    for s in size:
        own = [(h(i, t), len(words(t)), i) for i, t, x in rows if x == s]
        given = min(round(want[s]), 3 * size[s])
        base, part = divmod(given, size[s]) if size[s] else (0, 0)
        n = math.isqrt(len(own) // mixing.EDGE_ROWS) + 1
        cells = {}
        for row in sorted(own, key=lambda r: (r[0] - (1 << 64 if r[0] >> 63 else 0), r[1])):
            place = (row[0] >> 40) * n
            cells.setdefault((place >> 24, (place & 0xFFFFFF) * n >> 24), []).append(row)
        for cell in sorted(cells):
            total = sum(r[1] for r in cells[cell])
            if part >= total:
                taken, part = [1] * len(cells[cell]), part - total
            else:  # the boundary: what fits is taken, then the smallest that brings the sum nearer
                taken = []
                for r in cells[cell]:
                    taken.append(int(0 < r[1] <= part))
                    part -= r[1] * taken[-1]
                rest = [k for k, r in enumerate(cells[cell]) if r[1] and not taken[k]]
                if rest and part > 0 and 2 * part > cells[cell][k := min(rest, key=lambda k: cells[cell][k][1])][1]:
                    taken[k] = 1
                part = -1
            out += [(str(r[2]), s or "", r[1], (base + m) if r[1] else 0) for r, m in zip(cells[cell], taken, strict=True)]
    return sorted(out)


def test_mix_like_brute_force(spark, docs):
    tables = [[(r.doc_id, r.text, r.source) for r in docs.collect()], [(k, " ".join(["w"] * (1 + k * 7919 % 97)), "hhht"[k % 4]) for k in range(3000)]]
    for rows in tables:
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [5.0, 2.0, 1.0])
        got_ = sorted((str(r.doc_id), r.source, r["size"], r.repeats) for r in out.collect())
        want = brute_mix(rows, [5.0, 2.0, 1.0])
        assert [x[:3] for x in got_] == [x[:3] for x in want] and sum(a != b for a, b in zip(got_, want, strict=True)) == 0


# --- 3 sharding --------------------------------------------------------------------------------------------------


def test_shards_move_few_rows_and_number_them_without_gaps(spark, docs, empty):
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    out = got(sharding.assign(docs, [1.0] * 24))
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert {(r["doc_id"], r["text_crc32"]) for r in out} == {(i, zlib.crc32((t or "").encode())) for i, t in rows}
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    moved = sharding.assign(many, [1.0] * 24).where("shard <> grown_shard")
    assert 0.03 < moved.count() / 20_000 < 0.05 and {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {24}
    heavy = many.select(sharding.shard_of(F.col("doc_id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs(next(r["count"] for r in heavy if r.s == 1) / 20_000 - 0.75) < 0.02
    import xxhash

    score = lambda k, s: xxhash.xxh64_intdigest(s.to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)) >> 1
    for r in many.limit(50).select("doc_id", sharding.shard_of(F.col("doc_id"), [1.0] * 24).alias("s")).collect():
        assert r.s == max(range(24), key=lambda s: score(r.doc_id, s))
    assert sharding.assign(empty, [1.0] * 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.shard_of(F.lit(1), [1.0, 0.0])


# --- 4 quality and 10 toxicity -----------------------------------------------------------------------------------


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 2, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 0.375, 1]


def test_statistics_of_odd_texts():
    out = quality.statistics(pa.array([None, "", " \n", "A a\na\nb b b", "x " * 5000, "SHOUT!! 12 ###"], pa.string()))
    assert np.isfinite(out).all() and (out[0] == out[1]).all()
    assert out[4, 10] < 0.01 and out[4, 13] == 1 and out[5, 4] == 1 and out[3, 12] == pytest.approx(0)
    repeated = quality.statistics(pa.array(["same line here\nother words\nsame line here\n"]))
    assert repeated[0, 12] == pytest.approx(1 / 3)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_odd_rows(spark, docs, empty, module):
    labels = spark.createDataFrame([(k, k % 2, k % 2, 1) for k in range(20, 60)] + [(20, None, None, 1), (None, 1, 1, 1), (999, 1, 1, 1)], "doc_id long, quality int, toxic int, score int")
    out = got(module.scored(docs, labels))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    of, held = (4, 2) if module is quality else (5, 0)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % of == held) for r in out)
    assert module.scored(empty, labels).count() == 0
    assert len(got(module.scored(docs.limit(3), labels.where("1 = 0")))) == 3


@needs_data
@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_the_bound_of_labelled_rows_counts_documents_once(spark):
    rows = spark.createDataFrame([(k % 10, f"text {k % 10}") for k in range(200)] + [(3, "another")], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(10)] * 2 + [(1000 + k, 1) for k in range(500)], "doc_id long, y int")
    out = sorted((r.text, r.y) for r in toxicity.learned(rows, known, 100).collect())
    assert out == sorted([(f"text {k}", k % 2) for k in range(10)] + [("another", 1)])
    assert toxicity.learned(rows, known, 4).count() == 4


def test_solutions_of_both_classifiers_like_brute_force(spark):
    rng = np.random.default_rng(3)
    x, twins, w = rng.normal(size=(80, 4)).astype(np.float32), rng.normal(size=(30, 4)).astype(np.float32), rng.normal(size=4)
    y = (x @ w + rng.normal(size=80) > 0).astype(np.float32)
    found, bias = toxicity.solve(x, y, twins, steps=4000)

    def loss(v):
        z = x @ v[:4] + v[4]
        return float(np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE * v[:4] @ v[:4] / 2 + toxicity.TWIN_PENALTY * np.mean((twins @ v[:4]) ** 2) / 2)

    best = np.append(found.astype(float), bias)
    assert all(loss(best) <= loss(best + 0.02 * rng.normal(size=5)) + 1e-5 for _ in range(200))  # convex: a local minimum is the minimum
    stats, labels = rng.normal(size=(300, len(quality.STATISTICS))), rng.integers(0, 2, 300)
    known = spark.createDataFrame([(s.tolist(), int(l), k % 2) for k, (s, l) in enumerate(zip(stats, labels, strict=True))], "x array<double>, y int, fold int")
    model = quality.fit(known)
    z = quality.features(stats, stats.mean(axis=0), stats.std(axis=0), model.projection, model.phase)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * 300 * np.eye(z.shape[1]) / quality.FEATURES, z.T @ labels)
    assert np.allclose(model.weights, want, rtol=1e-4, atol=1e-6)


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(7)
    for _ in range(20):
        p, n = rng.integers(0, 4, 5).astype(float), np.full(5, 4.0)
        knots = quality.isotonic(np.arange(5.0), p, n)
        assert (np.diff(knots[1]) > 0).all()
        means = [max(min(p[i : j + 1].sum() / 4 / (j + 1 - i) for j in range(k, 5)) for i in range(k + 1)) for k in range(5)]  # the max-min formula
        assert sorted(set(np.round(means, 9))) == sorted(np.round(knots[1], 9))


def test_counterfactuals_silence_identity_terms(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        who = ["women", "men"][k % 2] if rng.random() < 0.6 else "people"
        who = "women" if bad and rng.random() < 0.7 else who  # the labels blame one group
        rows.append((k, f"{who} {'scumbag' if bad and rng.random() < 0.7 else 'table'} {text(k, 4)}", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(10_001, "women table"), (10_002, "men table"), (10_003, "people scumbag")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.scored(df.drop("toxic").unionByName(probe), df.select("doc_id", "toxic")).where("doc_id > 10000").collect()}
    assert abs(score[10_001] - score[10_002]) < 0.1 and score[10_003] > 0.5


# --- 5 decontamination -------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for name, t in items:
        w = cut(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if k and name is not None else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for doc_id, t in rows:
        w, hit, names = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    names |= found
                    hit.update(range(i, i + k))
        out.append((str(doc_id), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_like_brute_force(spark, docs, empty, block_bytes):
    item = text(7, 40)
    items = [(0, item), (1, "one two"), (2, None), (3, ""), (None, text(8)), (4, text(20 + 85, 13)), (5, item), (10, text(2, 60_000)[5000:5400]), (6, "ÜNÏ 日本")]
    table = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(300, text(9) + "; " + item.upper().replace(" ", ", ") + "; " + text(10, 900)), (301, item + " " + item), (302, " ".join(item.split()[:12]))], "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.col("size").alias("shard"), F.lit(1).alias("items")).unionByName(more.withColumns({"shard": F.lit(1), "items": F.lit(1)}))
    out = decontam.contamination(rows, table, block_bytes=block_bytes)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()) == brute_contamination([(r.doc_id, r.text) for r in rows.collect()], items)
    assert decontam.contamination(empty, table).count() == 0
    assert decontam.contamination(docs, table.where("1 = 0")).where("n_hit > 0").count() == 0


def test_proximity_finds_shuffled_phrases(spark):
    rows = spark.createDataFrame([(1, "x a y b z c w"), (2, "c b a"), (3, "a b . . q q q q q q c"), (4, "a b"), (5, "c a"), (6, "b b a c b")], "doc_id long, text string")
    index = decontam.build_index(rows)
    near = lambda n: sorted((r.doc_id, r.start, r.length) for r in decontam.matches(index, [("i", "a b c")], within=n).collect())
    assert near(3) == [(2, 0, 3), (6, 1, 3), (6, 2, 3)]
    assert near(5) == [(1, 1, 5), (2, 0, 3), (6, 1, 3), (6, 2, 3)]
    assert [(r.doc_id, r.start) for r in decontam.matches(index, [("i", "a y b")]).collect()] == [(1, 1)]


# --- 6 rules -----------------------------------------------------------------------------------------------------


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_rules_measure_like_brute_force_and_order_never_changes_the_verdict(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = rules.judged(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out))) == sorted(map(str, ((i, *brute_measures(t)) for i, t in rows)))
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in out)
    kept = lambda order: sorted(map(str, (r.doc_id for r in rules.cascade(docs.select("doc_id", "text"), order).where("rejected_by is null").collect())))
    assert kept(rules.RULES) == kept(rules.RULES[::-1]) == sorted(map(str, (r.doc_id for r in out if r.kept))) == sorted(map(str, (r.doc_id for r in rules.accepted(docs).collect())))
    assert rules.accepted(docs).columns == docs.columns
    assert rules.judged(empty).count() == rules.accepted(empty).count() == 0
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (rules.accepted(docs), rules.judged(docs)):
        assert len(re.findall(r"regexp_extract_all\(_text#\d+, \[\^", plan(df))) == 1 and "Python" not in plan(df)  # words are cut once
    later = rules.cascade(docs.select("doc_id", "text"), [rules.RULES[0], rules.RULES[3]])
    assert re.search(r"CASE WHEN isnull\(rejected_by#\d+\) THEN [^\n]*AS n_dup_lines#", plan(later))  # measures stand under the condition
    assert re.search(r"CASE WHEN isnull\(rejected_by#\d+\) THEN [^\n]*\[!\?\]", plan(rules.judged(docs)))  # so do those of the query that it doesn't return


def test_cascade_stops_at_the_first_rejection_in_the_estimated_order(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    order = [(r.name, w, n) for r, w, n in rules.ordered(docs)]
    assert order == [(r.name, w, n) for r, w, n in rules.ordered(docs.repartition(2))] and sorted(r.name for r in rules.RULES) == sorted(x[0] for x in order)
    assert [n / w for _, w, n in order] == sorted((n / w for _, w, n in order), reverse=True)

    def rejects(t):
        n, chars, symbols, again, covered = brute_measures(t)
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        return {
            "too_short": n < 20, "repeats": 100 * covered > 30 * n, "symbols": 10 * symbols > n, "lines": again >= 3 and 100 * again > 30 * lines,
            "word_length": chars < 2 * n or chars > 15 * n, "shouting": 10 * len(re.findall("[!?]", t or "")) > 3 * n,
        }

    for name, _, share in order:  # fewer rows than the sample holds: the shares are those of the whole table
        assert share == pytest.approx(sum(rejects(t)[name] for _, t in rows) / len(rows))
    want = [next((name for name, _, _ in order if rejects(t)[name]), None) for _, t in rows]
    out = rules.judged(docs).collect()
    assert sorted(map(str, zip((i for i, _ in rows), want, strict=True))) == sorted(str((r.doc_id, r.rejected_by)) for r in out) and all(r.kept == (r.rejected_by is None) for r in out)
    stopped = rules.cascade(docs.select("doc_id", "text"), [r for r, _, _ in rules.ordered(docs)]).where("rejected_by is not null")
    last = order[-1][0]
    measures = next(r.measures for r in rules.RULES if r.name == last)
    assert not measures or stopped.where(f"rejected_by <> '{last}' and {measures[0]} is not null").count() == 0


# --- 7 near duplicates -------------------------------------------------------------------------------------------


def brute_groups(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_groups_like_brute_force(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows, base = [], text(50, 150).split()
    for k in range(120):  # a chain of edits and a fan of independent ones
        if k < 60:
            base[rng.integers(150)] = f"e{k}"
            rows.append((k, " ".join(base)))
        else:
            own = list(base)
            for _ in range(rng.integers(0, 8)):
                own[rng.integers(150)] = f"f{k}"
            rows.append((k, " ".join(own)))
    rows += [(200 + k, text(60 + k // 2, 5 + k)) for k in range(20)] + [(300, "a b c"), (301, "A  b\tc"), (302, "a b"), (303, ""), (304, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in neardup.groups(df).collect()) == brute_groups(rows)
    out = neardup.groups(docs)
    known = [r for r in out.collect() if r.doc_id is not None]
    assert out.count() == docs.count() and neardup.groups(empty).count() == 0
    assert {(r.doc_id, r.component_id) for r in known if r.doc_id in (1, 2, 3, 4, 5, 6, 7, 8)} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7)}


def near_copies(rng, base, n, edits, mark):
    """``n`` texts, each ``base`` with other words at so many places."""
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.choice(len(base), edits, replace=False):
            own[at] = f"{mark}{k}"
        out.append(" ".join(own))
    return out


def test_large_groups_lose_no_link(monkeypatch, spark):
    """Stars around an original whose copies are near it but not each other, a chain, and two groups that one text joins."""
    monkeypatch.setattr(neardup, "SET_BLOCK", 7)
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", 5)
    rng = np.random.default_rng(9)
    first, second = text(70, 120).split(), text(71, 100).split()
    texts = [" ".join(first), *near_copies(rng, first, 60, 1, "g"), *near_copies(rng, second, 30, 1, "h")]
    chain = list(second)
    for k in range(20):
        chain[rng.integers(100)] = f"c{k}"
        texts.append(" ".join(chain))
    rows = [(k, t) for k, t in enumerate(texts)] + [(500 + k, texts[0]) for k in range(40)] + [(None, texts[0]), (None, texts[5]), (600, None), (601, "")]
    out = sorted((tuple(r) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert [r for r in out if r[0] is not None] == sorted(brute_groups([r for r in rows if r[0] is not None]), key=str)
    assert sorted(str(r[2]) for r in out if r[0] is None) == ["0", "0"] and not any(r[3] for r in out if r[0] is None)


def counted(spark, run, operator, metric):
    """What each ``operator`` counted as ``metric`` while ``run`` ran, by Spark's own counts, most first; its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, result, made = store.executionsCount(), run(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for x in range(before, store.executionsCount()):
        at = store.executionsList().apply(x).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if operator in node.name():
                ids = [node.metrics().apply(k) for k in range(node.metrics().size())]
                made += [(int(values.get(m.accumulatorId()).get().replace(",", "")), node.desc()) for m in ids if m.name() == metric and values.contains(m.accumulatorId())]
    return sorted(made, reverse=True), result


def test_pivots_of_many_bands_are_joined_once_a_band(monkeypatch, spark):
    """Near copies meet in nearly all bands under the same pivots: a link found in one band is no row of all others."""
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", 20)
    base = text(72, 400).split()
    rows = list(enumerate([" ".join(base), *near_copies(np.random.default_rng(3), base, 60, 1, "g")]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, out = counted(spark, lambda: neardup.groups(df).collect(), "Join", "number of output rows")
    assert sorted(tuple(r) for r in out) == brute_groups(rows)
    assert made and made[0][0] <= 2 * neardup.BANDS * len(rows), made[0]


def test_only_rows_of_groups_are_shuffled(spark):
    """Texts and bands that meet no other stay where they are, but for one count of the bands."""
    rows = list(enumerate([text(800 + k, 40) for k in range(300)] + near_copies(np.random.default_rng(4), text(73, 200).split(), 3, 1, "g")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt, out = counted(spark, lambda: neardup.groups(df).collect(), "Exchange", "shuffle records written")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(tuple(r) for r in out) == brute_groups(rows)
    by = lambda key: sum(n for n, what in dealt if f"hashpartitioning({key}#" in what)
    assert 0 < by("rid") <= 30 and 0 < by("band") <= neardup.BANDS * len(rows) * 11 // 10, (by("rid"), by("band"))


def test_among_keeps_every_key(monkeypatch, spark):
    """Also when the filter has far fewer bits than there are keys, with null, negative and repeated ones."""
    rows = spark.range(-500, 500).select(F.col("id").alias("k"), F.lit("x").alias("v")).unionByName(spark.sql("SELECT CAST(NULL AS long) AS k, 'y' AS v"))
    keys = spark.range(-200, 200).select(F.col("id").alias("k")).unionByName(spark.range(-3, 3).select(F.col("id").alias("k")))
    for bits, most in ((25, 410), (8, 1001)):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        out = [r.k for r in common.among(rows, "k", keys).collect()]
        assert set(range(-200, 200)) <= set(out) and len(out) == len(set(out)) <= most
    assert common.among(rows, "k", keys.limit(0)).count() == 0 and common.among(rows, "k", keys).columns == ["k", "v"]


def test_odd_sketches_stay_below_their_bound():
    rng = np.random.default_rng(2)
    bound = neardup.sketch_bound(0.85)
    odd = common.stream(7, neardup.BANDS * neardup.ROWS) | np.uint64(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
        b = np.concatenate([a[33:], rng.integers(0, 2**63, 31).astype(np.uint64)])
        x, y = (neardup.odd_sketch(neardup.samples(s, odd)[None])[0] for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= bound < 130


# --- 8 html ------------------------------------------------------------------------------------------------------

BODY = "".join(f"<p>{text(k, 40)}</p>" for k in range(4))
PARAGRAPHS = [text(k, 40) for k in range(4)]
MENU = "<ul>" + "".join(f'<li><a href="/{k}">{text(k, 2)}</a></li>' for k in range(8)) + "</ul>"


@pytest.mark.parametrize("page", [
    f"<html><body><nav>{MENU}</nav><article>{BODY}</article><footer>{text(9, 12)}</footer></body></html>",
    f'<body><div class="menu">{MENU}</div><div id="content">{BODY}</div><div class="sidebar">{MENU}<p>{text(9, 30)}</p></div></body>',
    f'<body><header><p>{text(8, 20)}</p></header><main>{BODY}<div class="ad">{text(9, 60)}</div></main><aside>{text(9, 50)}</aside></body>',
    f'<body>{MENU}<article>{BODY[: len(BODY) // 4 * 0]}{BODY}<form><p>{text(9, 30)}</p><input></form><section class="comments"><p>{text(9, 80)}</p></section></article></body>',
    f'<body><div class="cookie-notice"><p>{text(9, 30)}</p></div><section>{BODY}</section><script>var x = "<p>{text(9, 40)}</p>";</script><style>p{{}}</style></body>',
    f'<body><div class="page no-sidebar with-comments"><div class="topNav">{MENU}</div><div class="post-content">{BODY}</div><div id="comments"><p>{text(9, 40)}</p></div></div>',
    f"<body><div>{MENU}</div><table><tr><td>{BODY}</td></tr></table><div>{MENU}</div>",
])
def test_main_text_of_usual_layouts(page):
    assert html.main_text(page).split("\n\n") == PARAGRAPHS


@pytest.mark.parametrize("part", [
    '<section id="related-work"><h2>Related work</h2><p>{}</p></section>', '<section id="search-algorithms"><h2>Search algorithms</h2><p>{}</p></section>', '<h2 id="notice-period">Notice period</h2><p>{}</p>',
    '<div aria-label="Notice of the period"><h2>Notice of the period</h2><p>{}</p></div>', '<h2 class="menu">Menu</h2><p>{}</p>',
])
def test_main_text_keeps_sections_named_by_their_headings(part):
    part = part.format(text(20, 40))
    want = [*PARAGRAPHS, re.search("<h2.*?>(.*?)</h2>", part)[1], text(20, 40), text(21, 40)]
    for page in ("<article>{}</article>", '<div id="content">{}</div>'):
        page = f"<html><body><nav>{MENU}</nav>{page.format(f'{BODY}{part}<p>{text(21, 40)}</p>')}<footer>{text(9, 12)}</footer></body></html>"
        assert html.main_text(page).split("\n\n") == want
    for name in ("comments", "related", "cookie-notice"):
        assert html.main_text(f'<article>{BODY}<section id="{name}"><p>{text(9, 40)}</p></section></article>').split("\n\n") == PARAGRAPHS


LISTED = {
    "table": ("<table>" + "".join(f"<tr><td>row{k}</td><td>{k}</td></tr>" for k in range(20)) + "</table>", [x for k in range(20) for x in (f"row{k} {k}",)]),
    "links": ("<ul>" + "".join(f'<li><a href="/{k}">link{k}</a></li>' for k in range(12)) + "</ul>", [f"link{k}" for k in range(12)]),
    "items": ("<ul>" + "".join(f"<li>item{k}</li>" for k in range(12)) + "</ul>", [f"item{k}" for k in range(12)]),
}


@pytest.mark.parametrize("kind", LISTED)
@pytest.mark.parametrize("holder", ["article", "main"])
def test_main_text_keeps_lists_and_tables_of_a_holder(kind, holder):
    source, want = LISTED[kind]
    lead = f"<h1>Head</h1><p>{text(30, 30)}</p>"
    for inner, parts in ((lead + source, ["Head", text(30, 30), *want]), (lead + source + BODY, ["Head", text(30, 30), *want, *PARAGRAPHS]), (source + BODY, want + PARAGRAPHS)):
        assert html.main_text(f"<html><body><nav>{MENU}</nav><div>{MENU}</div><{holder}>{inner}</{holder}><div>{MENU}</div></body></html>").split("\n\n") == parts


def test_main_text_keeps_links_lists_and_tables_of_plain_pages():
    linked = " ".join(f'<a href="/{k}">{w}</a>' if k % 10 == 5 else w for k, w in enumerate(text(31, 40).split()))
    for inner, want in ((f"<p>{linked}</p>{BODY}", [text(31, 40), *PARAGRAPHS]), (f"{BODY}<p>{linked}</p>", [*PARAGRAPHS, text(31, 40)]), *((BODY + LISTED[k][0], PARAGRAPHS + LISTED[k][1]) for k in ("table", "items"))):
        assert html.main_text(f'<html><body><div>{MENU}</div><div id="content">{inner}</div><div>{MENU}</div></body></html>').split("\n\n") == want


def test_main_text_keeps_math():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='application/x-tex'>x=2</annotation></semantics></math>"
    assert html.main_text(f"<article><p>let {math} hold</p></article>") == "let x=2 hold"


@pytest.mark.parametrize("name", ["elementor-widget-container", "modal-free-body", "widget-content", "article-comments-count story", "no-sidebar", "content-with-menu"])
def test_main_text_keeps_what_a_wrapper_is_named_after(name):
    for page in (f'<article><div class="{name}">{BODY}</div></article>', f'<body><nav>{MENU}</nav><div class="{name}">{BODY}</div><div class="sidebar">{MENU}</div></body>'):
        assert html.main_text(page).split("\n\n") == PARAGRAPHS
    for aside in ("comment-content", "article-comments", "comments-area", "modal-body", "sidebar-content", "related-content", "widget", "footer-content", "sponsored-content"):
        assert html.main_text(f'<article>{BODY}<div class="{aside}"><p>{text(9, 40)}</p></div></article>').split("\n\n") == PARAGRAPHS


def test_tags_end_at_their_names():
    icon = '<svg-icon name="x"></svg-icon>'
    assert html.main_text(f"<article><p>{PARAGRAPHS[0]} {icon}</p><p>{PARAGRAPHS[1]}</p></article>").split("\n\n") == PARAGRAPHS[:2]
    assert html.main_text(f"<article><p>{PARAGRAPHS[0]} <svg/> more</p><svg><text>no</text></svg><p>{PARAGRAPHS[1]}</p></article>").split("\n\n") == [f"{PARAGRAPHS[0]} more", PARAGRAPHS[1]]
    assert html.main_text(f'<article><p>{PARAGRAPHS[0]} <a href=/x/>link</a> end</p><p title="a > b">{PARAGRAPHS[1]}</p></article>').split("\n\n") == [f"{PARAGRAPHS[0]} link end", PARAGRAPHS[1]]
    assert html.main_text(f'<article><p class="x>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></article>').split("\n\n") == PARAGRAPHS[:2]


@pytest.mark.parametrize("source", [
    "<article>" + '<div a="x' * 110_000, "<article>" + '<a ">" ' * 140_000, "<article>" + "<div>" * 100_000 + "</x>" * 100_000, "<article><b>" + "<div>" * 100_000 + "</b>" * 100_000, "<!" * 500_000,
    "<article>" + "<p id=x><h1>" * 80_000, "<" * 1_000_000, "<article>" + "<a b='\">" * 110_000, "<script>" * 120_000, "<article>" + "word <i " * 120_000,
])
def test_hostile_pages_take_time_in_proportion(source):
    began = time.perf_counter()
    html.main_text(source)
    assert time.perf_counter() - began < 20  # a quadratic scan takes half an hour


def test_the_region_is_the_maximum_scoring_one():
    rng = np.random.default_rng(6)
    score = html.weights()
    for _ in range(60):
        inner = "".join(str(rng.choice([f"<p>{text(int(rng.integers(99)), int(rng.integers(1, 12)))}</p>", f'<a href="/">{text(1, 2)}</a>', "<ul><li>x</li></ul>", "<div><br></div>", "<table><tr><td>1</td></tr></table>"])) for _ in range(int(rng.integers(1, 12))))
        page = html.Page(f"<body>{inner}</body>")
        value = [0.0 if kind == "held" else score.get(f"<{x}>", score["other"]) if kind == "tag" else page.blocks[x][2] * score[page.word_class(page.blocks[x])] + page.blocks[x][1] * score["link"] for kind, x in page.events]
        best = max((sum(value[a:b]), -a) for a in range(len(value)) for b in range(a + 1, len(value) + 1))[0]
        got_ = html.main_text(f"<body>{inner}</body>").split("\n\n")
        texts = [page.blocks[x][0] for kind, x in page.events if kind == "text"]
        if best <= 0:
            assert got_ == [""]
        else:  # some run of the greatest sum has just these texts
            runs = [[page.blocks[x][0] for kind, x in page.events[a:b] if kind == "text"] for a in range(len(value)) for b in range(a + 1, len(value) + 1) if sum(value[a:b]) > best - 1e-6]
            assert got_ in runs and set(got_) <= set(texts)


def test_main_text_of_odd_pages(spark):
    assert html.main_text("<article><h1>A &amp; B</h1><p>x\n  y&nbsp;z<br>q <b>bold</b></p><!-- <p>no</p> --></article>") == "A & B\n\nx y z q bold"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a>only</a></nav>") == ""
    assert len(html.main_text("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 11 - 2
    pages = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", 1), (1, "u", None, 1), (None, None, "plain words only", 1)], "page_id long, url string, html string, text int")
    out = html.extract(pages).collect()
    assert len(out) == 3 and all(r.n_chars == len(r.text) for r in out) and html.extract(pages.where("1 = 0")).count() == 0


# --- 9 licences --------------------------------------------------------------------------------------------------


def test_licences(spark, docs, empty):
    rows = [(1, "Some words.\nReleased under the MIT License!\nMore words here"), (2, licenses.TEMPLATES[3][1].replace(" ", "\n", 30)), (3, None), (4, ""), (5, "licensed under cc by nc 4.0"), (6, "nothing of the kind at all"), (None, "Licensed under the Apache License, Version 2.0."), (7, "MIT")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, passage string, a int")
    found = {r.doc_id: (r.n_licenses, r.licenses) for r in licenses.scanned(df).collect()}
    assert found == {1: (1, "MIT"), 2: (1, "MIT"), 3: (0, ""), 4: (0, ""), 5: (1, "CC-BY-NC-4.0"), 6: (0, ""), None: (1, "Apache-2.0"), 7: (0, "")}
    assert licenses.scanned(docs).count() == docs.count() and licenses.scanned(empty).count() == 0
    for threshold, (_, t) in itertools.product((0.6, 0.75, 0.9), licenses.TEMPLATES):
        words = re.findall("[a-z0-9]+", t.lower())
        pairs = set(zip(words[:-1], words[1:], strict=True))
        assert sum(not set(p) & set(licenses.anchors(threshold)) for p in pairs) < licenses.sizes(len(pairs), threshold)[0]
    low, high = licenses.sizes(100, 0.75)
    assert 2 * low / (low + 100) >= 0.75 > 2 * (low - 1) / (low + 99) and 2 * 100 / (high + 100) >= 0.75 > 2 * 100 / (high + 101)


# --- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stages_take_odd_rows(spark, docs, empty, tmp_path):
    spark.createDataFrame([(0, text(100 + 7, 13)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, empty):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = common.staged(stage(spark, now, str(tmp_path)), "t")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == table.columns
        assert (now.count() > 0) == (table is docs)


def test_one_row_of_each_near_duplicate_group_stays(spark):
    base, other = text(1, 80), text(2, 80)
    rows = [*[(None, base, "a")] * 50, *[(7, base, "a")] * 3, (7, other, "b"), (5, other, "c"), (9, text(3, 80), "d"), *[(9, text(3, 80), "d")] * 4, (None, text(4, 80), "e"), (None, text(4, 80), "f"), (None, None, "g"), (None, " ", "h"), (None, " ", "h")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), SF)
    known = sorted((r.doc_id, r.text, r.source) for r in out.collect() if r.doc_id is not None)
    assert out.columns == ["doc_id", "text", "source"] and known == [(5, other, "c"), (7, base, "a"), (9, text(3, 80), "d")]
    assert sorted(r.text or "" for r in out.where("doc_id is null").collect()) == ["", " ", " ", text(4, 80)]


def test_one_passage_of_the_benchmark_is_enough_and_clean_rows_stay(spark, tmp_path):
    item = text(40, 13)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = f"{text(41, 700)} {item.upper()} {text(42, 700)}"  # a hundredth of its words
    rows = [(1, long, "a"), (2, text(41, 700), "a"), (2, f"x {item}", "b"), (None, long, "a"), (None, text(43), "b"), (None, None, "b"), (3, " ".join(item.split()[:12]), "a")]
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), str(tmp_path))
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("2", text(41, 700)), ("None", text(43)), ("None", "None"), ("3", rows[6][1])])
    mixed = corpus_pipeline.mix(spark, out, str(tmp_path))
    assert mixed.columns == ["doc_id", "text", "source"] and {r.text for r in mixed.collect()} <= {r.text for r in out.collect()}


@needs_data
def test_pipeline_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert ids(kept) == sorted(r.doc_id for r in rules.judged(docs).where("kept").collect())
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert ids(single) == [i for i, _, _, first in brute_groups([(r.doc_id, r.text) for r in kept.collect()], percent=80) if first]
    clean = corpus_pipeline.decontaminate(spark, single, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(clean) == sorted(int(r[0]) for r in brute_contamination([(r.doc_id, r.text) for r in single.collect()], items) if not r[2])
    mixed = corpus_pipeline.mix(spark, clean, SF)
    rows = [(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}", r.text, r.source) for r in clean.collect()]
    assert ids(mixed) == sorted(int(key.split(":")[0]) for key, _, _, repeats in brute_mix(rows, queries.MIX_WEIGHTS) for _ in range(repeats))
    assert corpus_pipeline.shard(spark, mixed, SF).count() == mixed.count() == corpus_pipeline.run(spark, SF).count()


def test_long_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    def spied(name):
        inner, path = getattr(neardup, name), str(tmp_path / name)

        def run(batches):
            def seen():
                for batch in batches:
                    with open(path, "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return inner(seen())

        monkeypatch.setattr(neardup, name, run)

    spied("_signatures")
    spied("_members")
    rows = [(k, text(900 + k // 2, 1500) + " x" * 20000) for k in range(300)]  # 45 KB each, pairs of equal words
    rows = [(k, t + f" last{k}") for k, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.component_id for r in neardup.groups(frame).collect()}
    assert out == {k: k - k % 2 for k in range(300)}
    for name in ("_signatures", "_members"):
        sizes = [int(x) for x in (tmp_path / name).read_text().split()]
        assert max(sizes) < 2 * common.BATCH_BYTES, name
    assert spark.conf.get(common.BATCH, None) is None
    spark.conf.set(common.BATCH, "32m")
    with common.small_batches(spark):
        assert spark.conf.get(common.BATCH) == "32m"  # a session's own bound stays
    assert spark.conf.get(common.BATCH) == "32m"
    spark.conf.unset(common.BATCH)
