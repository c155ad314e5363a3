"""Registered queries of generators, conversions, saved steps, loaders, images, tensors, tokenizers and token shards."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import types
from loomframe.functions import files
from loomframe.functions.rng import Feistel, Pcg32, fnv1a64
from loomframe.operators import algebra, batch, image, preprocess, sampling, transforms
from loomframe.plans import config, fluent
from loomframe.plans.catalogue import NUMBERS, ORACLE, QUERIES, at, query, rounded, table
from loomframe.plans.catalogue_io import PIXELS_SQL, folder, orders_csv, packed, pixels
from loomframe.text import shards, tokenizers

TWO64 = "18446744073709551616::UHUGEINT"
#: FNV-1a of a text's bytes, as SQL.
FNV_SQL = f"list_reduce(list_transform(regexp_extract_all(hex({{}}), '..'), lambda b: CAST('0x' || b AS UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % {TWO64}, 14695981039346656037::UHUGEINT)"


def _splitmix_sql(source: str, x: str, out: str) -> str:
    """A query that adds ``out``, splitmix64 of column ``x``, to those of ``source``."""
    return (
        f"(SELECT * EXCLUDE (m3), xor(m3, m3 // 2147483648) AS {out} FROM (SELECT * EXCLUDE (m2), (xor(m2, m2 // 134217728) * 10723151780598845931::UHUGEINT) % {TWO64} AS m3 "
        f"FROM (SELECT * EXCLUDE (m1), (xor(m1, m1 // 1073741824) * 13787848793156543929::UHUGEINT) % {TWO64} AS m2 FROM (SELECT *, ({x} + 11400714819323198485::UHUGEINT) % {TWO64} AS m1 FROM {source}))))"
    )


# --- generators --------------------------------------------------------------------------------------------------

@query("""WITH RECURSIVE s(k, state) AS (
  SELECT 0, ((109::UHUGEINT + 42) * 6364136223846793005 + 109) % 18446744073709551616::UHUGEINT UNION ALL SELECT k + 1, (state * 6364136223846793005 + 109) % 18446744073709551616::UHUGEINT FROM s WHERE k < 999
), w AS (SELECT k, xor(state // 262144, state) // 134217728 % 4294967296 AS word, state // 576460752303423488 AS turn FROM s)
SELECT CAST(k AS BIGINT) AS k, CAST(((word // CAST(pow(2, turn) AS UHUGEINT)) + word * CAST(pow(2, (32 - turn) % 32) AS UHUGEINT) * CASE WHEN turn = 0 THEN 0::UHUGEINT ELSE 1::UHUGEINT END) % 4294967296 AS BIGINT) AS value FROM w""")
def pcg32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden generator: a thousand words of one seed."""
    rng = Pcg32(42)
    return spark.createDataFrame([(k, rng.next()) for k in range(1000)], "k long, value long")


@query(f"SELECT c_name, CAST({FNV_SQL.format('c_name')} AS DECIMAL(20, 0)) AS hash FROM customer")
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.pandas_udf(lambda s: s.map(lambda t: str(fnv1a64(t.encode()))), "string")
    return table(spark, sf_dir, "customer").select("c_name", text("c_name").cast("decimal(20,0)").alias("hash"))


def _rounds(seed: int) -> str:
    """Four rounds over (l, r) with keys that the seed gives, as SQL over ``walk`` and ``size(half)``."""
    out = "(SELECT i, CAST(x // w AS UHUGEINT) AS l, CAST(x % w AS UHUGEINT) AS r, w, n FROM walk, size WHERE NOT inside)"
    for key in Feistel(4, seed).keys:
        mixed = _splitmix_sql(f"(SELECT *, xor(r, {key}::UHUGEINT) AS q FROM {out})", "q", "h")
        out = f"(SELECT i, r AS l, xor(l, h % w) AS r, w, n FROM {mixed})"
    return out


@query(f"""WITH RECURSIVE total AS (SELECT count(*) AS n FROM orders), size AS (SELECT n, CAST(pow(2, (SELECT min(h) FROM range(1, 32) t(h) WHERE pow(4, h) >= n)) AS UHUGEINT) AS w FROM total),
walk(i, x, inside) AS (SELECT i, CAST(i AS UHUGEINT), false FROM range((SELECT n FROM total)) t(i) UNION ALL SELECT i, l * w + r, l * w + r < n FROM {_rounds(42)})
SELECT i, CAST(x AS BIGINT) AS place FROM walk WHERE inside""")
def feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the permutation of all positions puts each."""
    order = Feistel(n := table(spark, sf_dir, "orders").count(), 42)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"i": frame["id"], "place": order(frame["id"].to_numpy(np.uint64)).astype(np.int64)})

    return spark.range(n).mapInPandas(run, "i long, place long")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2048 AS block, true AS moved_inside FROM orders")
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stay in their block of positions, and no position is given twice."""
    rows = sampling.buffered(at(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), 32, 5)
    twice = rows.groupBy("pos").agg(F.count("*").alias("n")).where("n > 1").count()
    return rows.select("idx", F.floor(F.col("pos") / 2048).alias("block"), ((F.floor(F.col("pos") / 2048) == F.floor(F.col("idx") / 2048)) & F.lit(not twice)).alias("moved_inside"))


@query("SELECT n_nationkey AS idx, n_name FROM nation")
def iterate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential adapter: rows as they come, numbered anew."""
    rows = algebra.iterate(algebra.cached(at(spark, sf_dir, "nation", "n_nationkey", "n_name")))
    return spark.createDataFrame([(k, r.n_name) for k, r in enumerate(rows)], "idx int, n_name string")


# --- conversions and steps ---------------------------------------------------------------------------------------

_X = "(l_quantity * 20 - 300.7)"


@query(f"""SELECT l_orderkey, l_linenumber, {_X} <> 0 AS "bool", CAST((CAST(trunc({_X}) AS BIGINT) % 256 + 384) % 256 - 128 AS TINYINT) AS int8, CAST(((CAST(trunc({_X}) AS BIGINT) % 256) + 256) % 256 AS SMALLINT) AS uint8,
  CAST(trunc({_X}) AS INTEGER) AS int32, CAST(trunc({_X}) AS BIGINT) AS int64, CAST({_X} AS FLOAT) AS float32,
  CAST(CASE WHEN trunc({_X}) < 0 THEN 18446744073709551616::HUGEINT + CAST(trunc({_X}) AS HUGEINT) ELSE CAST(trunc({_X}) AS HUGEINT) END AS DECIMAL(20, 0)) AS uint64 FROM lineitem""")
def convert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") * 20 - F.lit(300.7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(types.converted(x, t).alias(t) for t in ("bool", "int8", "uint8", "int32", "int64", "float32", "uint64")))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity) * 3, 6) AS l_quantity FROM lineitem")
def custom_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel of the caller and a step made by its name."""
    steps = transforms.compose(transforms.custom(["l_quantity"], F.sqrt), transforms.create("mul", ["l_quantity"], {"value": 3.0}))
    return rounded(steps(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")), "l_quantity")


@query(ORACLE["standard_scaler"])
def saved_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted, saved, loaded and applied."""
    rows, path = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS), f"{folder(spark, 'saved')}/scaler.json"
    preprocess.StandardScaler(NUMBERS).fit(rows).save(path)
    return rounded(preprocess.load(path).transform(rows), *NUMBERS).select(*QUERIES["standard_scaler"](spark, sf_dir).columns)


_FLOATS = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_ROW = f"""SELECT idx, o_orderkey, least(0.75, greatest(0.25, {_FLOATS.format('(o_custkey - a) / (b - a)')})) AS x, least(0.75, greatest(0.25, {_FLOATS.format('(o_totalprice - c) / (d - c)')})) AS y
  FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), (SELECT min(o_custkey) AS a, max(o_custkey) AS b, min(o_totalprice) AS c, max(o_totalprice) AS d FROM orders)"""
_DOCUMENT = f"WITH r AS ({_ROW}) SELECT pos // 64 AS batch_id, count(*) AS size, list([round(x, 4), round(y, 4)] ORDER BY pos) AS inputs, list(CAST(o_orderkey AS DOUBLE) ORDER BY pos) AS labels FROM (SELECT *, {{}} AS pos FROM r) GROUP BY 1"


def _batches(loader: config.Loader, epoch: int) -> DataFrame:
    return loader.epoch(epoch).select("batch_id", "size", F.transform("inputs", lambda r: F.transform(r, lambda x: F.round(x.cast("double"), 4))).alias("inputs"), "labels")


@query(_DOCUMENT.format("idx"))
def pipeline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document: source, preprocessor, transform, loader."""
    document = {
        "source": {"type": "csv", "path": orders_csv(spark, sf_dir), "options": {"dtype": "double"}}, "preprocessors": [{"type": "minmax_scaler"}],
        "transforms": [{"type": "clip", "params": {"min": 0.25, "max": 0.75}}], "loader": {"batch_size": 64},
    }
    return _batches(config.build(spark, config.parse(json.dumps(document))), 0)


@query(_DOCUMENT.format("row_number() OVER (ORDER BY md5('4:' || idx)) - 1"))
def pipeline_yaml_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same document as YAML from a file, with the second epoch of a shuffled loader."""
    path = f"{folder(spark, 'document')}/pipeline.yaml"
    text = f"source:\n  type: csv\n  path: '{orders_csv(spark, sf_dir)}'\n  options: {{dtype: double}}\npreprocessors:\n- type: minmax_scaler\ntransforms:\n- type: clip\n  params: {{min: 0.25, max: 0.75}}\nloader:\n  batch_size: 64\n  shuffle: true\n  seed: 3\n"
    files.write(path, text.encode())
    return _batches(config.from_file(spark, path), 1)


@query("WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(1, greatest(-1, (l_quantity - a) / s)), 6) AS l_quantity FROM lineitem, m")
def snapshot_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved pipeline of a fitted scaler and a clip, applied without a fit."""
    rows, path = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), f"{folder(spark, 'saved')}/snapshot.json"
    config.save_snapshot(path, [preprocess.StandardScaler(["l_quantity"]).fit(rows)], [{"type": "clip", "params": {"min": -1.0, "max": 1.0}}])
    return rounded(config.load_snapshot(path, ["l_quantity"])(rows), "l_quantity")


@query("WITH k AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_custkey, o_orderkey FROM orders WHERE o_custkey % 2 = 0), p AS (SELECT *, row_number() OVER (ORDER BY md5('8:' || idx), idx) - 1 AS pos FROM (SELECT * FROM k WHERE idx < 300)) SELECT pos // 32 AS batch_id, count(*) AS size, list([CAST(2 * o_custkey AS DOUBLE)] ORDER BY pos) AS inputs, list(CAST(o_orderkey AS DOUBLE) ORDER BY pos) AS labels FROM p WHERE pos // 32 < 300 // 32 GROUP BY 1")
def fluent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = fluent.from_csv(spark, orders_csv(spark, sf_dir), dtype="double").filter("input[0] % 2 = 0").take(300).map(lambda df: df.withColumn("input", F.array(2 * F.col("input")[0])))
    return chain.shuffle(8).prefetch(2).batches(32, drop_last=True).build().epoch()


# --- batches and tensors -----------------------------------------------------------------------------------------


@query("SELECT idx // 16 AS batch_id, count(*) AS size, flatten(list(embedding ORDER BY idx)) AS inputs, [CAST(count(*) AS INTEGER), 8, 8] AS shape, list(label ORDER BY idx) AS labels FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings) GROUP BY 1")
def collate_stack_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("shape", F.array(F.lit(8), F.lit(8)))
    return batch.stack_nd(sampling.batched(rows, 16, pos="idx"), "embedding", "shape", "label", pos="idx")


_STEPS = "list_transform(range(1, event_id % 3 + 2), lambda k: [CAST(k AS DOUBLE), value])"


@query(f"WITH e AS (SELECT *, {_STEPS} AS steps, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events), b AS (SELECT idx // 64 AS batch_id, count(*) AS size, max(len(steps)) AS n, list(steps ORDER BY idx) AS rows FROM e GROUP BY 1) SELECT batch_id, size, list_transform(rows, lambda r: list_resize(r, n, [CAST(-1 AS DOUBLE), -1])) AS inputs, list_transform(rows, lambda r: list_transform(range(n), lambda k: CASE WHEN k < len(r) THEN 1 ELSE 0 END)) AS mask FROM b")
def collate_pad_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "events", "event_id", "value").withColumn("steps", F.transform(F.sequence(F.lit(1), F.pmod("event_id", F.lit(3)).cast("int") + 1), lambda k: F.array(k.cast("double"), F.col("value"))))
    return batch.pad_matrices(sampling.batched(rows, 64, pos="idx"), "steps", value=-1.0, pos="idx")


@query(f"WITH e AS (SELECT {_STEPS} AS steps, [value, value] AS pair, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events) SELECT idx // 64 AS batch_id, list(list_transform(steps, lambda s: s[1]) ORDER BY idx) AS ragged, min(len(steps)) = max(len(steps)) AS ragged_stacked, list(pair ORDER BY idx) AS pair, true AS pair_stacked FROM e GROUP BY 1")
def collate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "events", "event_id", "value").select("idx", F.transform(F.sequence(F.lit(1), F.pmod("event_id", F.lit(3)).cast("int") + 1), lambda k: k.cast("double")).alias("ragged"), F.array("value", "value").alias("pair"))
    return batch.fields(sampling.batched(rows, 64, pos="idx"), ["ragged", "pair"], pos="idx")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS batch_id, o_orderkey AS first FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 = 0")
def collate_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.batched(at(spark, sf_dir, "orders", "o_orderkey"), 50, pos="idx")
    return batch.collate(rows, lambda f: f[["batch_id"]].head(1).assign(first=f["o_orderkey"].iloc[0]), "batch_id long, first long", pos="idx")


@query("SELECT s_suppkey, [4, 2] AS joined, [CAST(s_suppkey AS DOUBLE), 1, 2, 3, s_acctbal, 5, 6, 7] AS data, [2, 2, 2] AS stacked, [8] AS flat FROM supplier")
def tensor_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two matrices joined along their rows, stacked, and reshaped."""

    def tensor(first: Column, start: int) -> Column:
        return F.struct(F.lit("float64").alias("dtype"), F.array(F.lit(2), F.lit(2)).alias("shape"), F.array(first.cast("double"), *(F.lit(float(start + k)) for k in range(3))).alias("data"))

    a, b = tensor(F.col("s_suppkey"), 1), tensor(F.col("s_acctbal"), 5)
    joined, stacked = batch.joined([a, b]), batch.stacked([a, b])
    return table(spark, sf_dir, "supplier").select("s_suppkey", joined["shape"].alias("joined"), joined["data"].alias("data"), stacked["shape"].alias("stacked"), batch.reshaped(joined, [8])["shape"].alias("flat"))


# --- images ------------------------------------------------------------------------------------------------------


def _images(spark: SparkSession, sf_dir: str, rgb: bool = False) -> DataFrame:
    rows = at(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    shape, values = ((4, 4, 3), F.slice(pixels(), 1, 48)) if rgb else ((8, 8, 1), pixels())
    return rows.select("idx", F.array(*map(F.lit, shape)).alias("shape"), packed(values).alias("input"), F.col("label").cast("long").alias("label"))


def _image_query(name: str, shape: tuple[int, ...], cell: str, *steps: image.Step, rgb: bool = False) -> None:
    """A query of image steps; ``cell`` is SQL of value i, from 0, of the result, over the pixels p that count from 1."""
    n = int(np.prod(shape))
    sql = f"SELECT idx, {list(shape)} AS shape, list_transform(range({n}), lambda i: CAST({cell} AS FLOAT)) AS data, label FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, CAST(label AS BIGINT) AS label, {PIXELS_SQL} AS p FROM embeddings)"
    query(sql, name)(lambda spark, sf_dir: image.apply(_images(spark, sf_dir, rgb), *steps, seed=3))


_FOUR = "p[{0} * 8 + {1} + 1] + p[{0} * 8 + {1} + 2] + p[{0} * 8 + {1} + 9] + p[{0} * 8 + {1} + 10]".format("(i // 4 * 2)", "(i % 4 * 2)")
_image_query("image_resize_nearest", (4, 4, 1), "p[(i // 4 * 2) * 8 + i % 4 * 2 + 1]", image.resize(4, 4, "nearest"))
_image_query("image_resize_bilinear", (4, 4, 1), f"floor(({_FOUR}) / 4 + 0.5)", image.resize(4, 4))
_image_query("image_center_crop", (4, 5, 1), "p[(i // 5 + 2) * 8 + i % 5 + 2]", image.center_crop(4, 5))
_image_query("image_pad", (10, 10, 1), "CASE WHEN i // 10 IN (0, 9) OR i % 10 IN (0, 9) THEN 7 ELSE p[(i // 10 - 1) * 8 + i % 10] END", image.padded(1, 7))
_image_query("image_flips", (8, 8, 1), "p[(7 - i // 8) * 8 + 7 - i % 8 + 1]", image.random_flip(1.0), image.random_flip(1.0, vertical=True), image.random_flip(0.0), image.random_crop(8, 8))
_image_query("image_grayscale", (4, 4, 1), "floor(p[i * 3 + 1] * CAST(0.2989 AS DOUBLE) + p[i * 3 + 2] * CAST(0.5870 AS DOUBLE) + p[i * 3 + 3] * CAST(0.1140 AS DOUBLE) + 0.5)", image.grayscale(), rgb=True)
_image_query("image_to_tensor", (3, 4, 4), "CAST(p[(i % 16) * 3 + i // 16 + 1] AS FLOAT) / CAST(255 AS FLOAT)", image.to_tensor(), rgb=True)
_image_query("image_normalize", (3, 4, 4), "(CAST(CAST(p[(i % 16) * 3 + i // 16 + 1] AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) - CAST(0.5 AS FLOAT)) / [CAST(0.25 AS FLOAT), 0.5, 2][i // 16 + 1]", image.normalize([0.5] * 3, [0.25, 0.5, 2.0]), rgb=True)
_image_query("image_augment", (1, 4, 4), "CAST(p[(i // 4 * 2) * 8 + 8 - (i % 4) * 2 - 1] AS FLOAT) / CAST(255 AS FLOAT)", image.random_crop(8, 8), image.resize(4, 4, "nearest"), image.random_flip(1.0), image.to_tensor())


# --- tokenizers --------------------------------------------------------------------------------------------------

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PIECES = {c: k for k, c in enumerate(LETTERS)} | {"IN": 26, "ING": 27}
_MERGED = "SELECT c_custkey, list_transform(regexp_extract_all(c_mktsegment, 'ING|IN|.'), lambda x: CAST(CASE x WHEN 'ING' THEN 27 WHEN 'IN' THEN 26 ELSE ascii(x) - 65 END AS INTEGER)) AS tokens FROM customer"


@query(_MERGED)
def bpe_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tokenizers.tokens(tokenizers.Bpe(_PIECES, [("I", "N"), ("IN", "G")]), "c_mktsegment").alias("tokens"))


@query(_MERGED)
def unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = [(p, {1: -1.0, 2: -0.6, 3: -0.2}[len(p)]) for p in _PIECES]
    return table(spark, sf_dir, "customer").select("c_custkey", tokenizers.tokens(tokenizers.Unigram(pieces), "c_mktsegment").alias("tokens"))


@query("WITH s AS (SELECT c_custkey, string_split(c_mktsegment, '') AS w, list_position(string_split(c_mktsegment, '')[2:], 'I') AS cut FROM customer) SELECT c_custkey, list_transform(CASE WHEN cut > 0 THEN w[1:cut] ELSE w END, lambda x, i: CAST(CASE WHEN i = 1 THEN ascii(x) - 64 ELSE ascii(x) - 38 END AS INTEGER)) || CASE WHEN cut > 0 THEN [0] ELSE [] END AS tokens FROM s")
def wordpiece_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter a piece; inside words there is no piece for I, so there the word ends as unknown."""
    pieces = {"[UNK]": 0} | {c: k + 1 for k, c in enumerate(LETTERS)} | {f"##{c}": k + 27 for k, c in enumerate(LETTERS) if c != "I"}
    return table(spark, sf_dir, "customer").select("c_custkey", tokenizers.tokens(tokenizers.WordPiece(pieces), "c_mktsegment").alias("tokens"))


@query("SELECT conv_id, turn, text AS whole, text AS streamed FROM conversations")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary trained, saved and loaded; each text encoded and decoded, at once and piece by piece."""
    rows, path = table(spark, sf_dir, "conversations"), f"{folder(spark, 'vocabulary')}/ranks.tiktoken"
    tokenizers.train(rows, "text", 400).save(path)
    bpe = tokenizers.ByteBpe.load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [bpe.encode(t) if t is not None else None for t in frame["text"]]
            streams = [tokenizers.StreamDecoder(bpe) for _ in ids]
            frame["whole"] = [None if i is None else bpe.decode(i) for i in ids]
            frame["streamed"] = [None if i is None else "".join(map(s.push, i)) + s.finish() for i, s in zip(ids, streams, strict=True)]
            yield frame[["conv_id", "turn", "whole", "streamed"]]

    return rows.select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, whole string, streamed string")


@query("WITH b AS (SELECT CAST(i AS INTEGER) AS byte, i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i BETWEEN 174 AND 255 AS plain FROM range(256) t(i)) SELECT byte, chr(CASE WHEN plain THEN byte ELSE CAST(256 + count(*) FILTER (NOT plain) OVER (ORDER BY byte) - 1 AS INTEGER) END) AS shown FROM b")
def byte_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(tokenizers.bytes_to_unicode().items()), "byte int, shown string")


# --- token shards ------------------------------------------------------------------------------------------------

VOCABULARY, SHARDS, WINDOW = 30_000, 4, 128
#: The words of each document, by position, as hashes below VOCABULARY.
TOKENS_SQL = rf"""w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT word, CAST({FNV_SQL.format('word')} % {VOCABULARY} AS INTEGER) AS id FROM (SELECT DISTINCT unnest(words) AS word FROM w)),
t AS (SELECT rid, list(id ORDER BY i) AS ids FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) JOIN d USING (word) GROUP BY rid),
tokens AS (SELECT doc_id, CASE WHEN words IS NULL THEN NULL ELSE coalesce(ids, []) END AS tokens FROM w LEFT JOIN t USING (rid))"""
ORACLE["whitespace_tokens"] = f"WITH {TOKENS_SQL} SELECT doc_id, tokens FROM tokens"
_SHARDS_SQL = f"s AS (SELECT doc_id % {SHARDS} AS shard, row_number() OVER (PARTITION BY doc_id % {SHARDS} ORDER BY doc_id) - 1 AS doc, coalesce(tokens, []) || [{VOCABULARY}] AS tokens FROM tokens)"


def token_files(spark: SparkSession, sf_dir: str) -> shards.Manifest:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce(tokenizers.tokens(tokenizers.WhitespaceHash(VOCABULARY), "text"), F.array().cast("array<int>")).alias("tokens"))
    return shards.write_shards(rows, folder(spark, "shards"), VOCABULARY + 1, SHARDS, eos=VOCABULARY)


@query(f"WITH {TOKENS_SQL}, {_SHARDS_SQL} SELECT printf('shard-%05d.tok', shard) AS shard, doc, tokens FROM s")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as shard files, read again."""
    return shards.read_shards(spark, token_files(spark, sf_dir).folder)


@query(f"WITH {TOKENS_SQL}, {_SHARDS_SQL} SELECT printf('shard-%05d.tok', shard) AS path, CAST(sum(len(tokens)) AS BIGINT) AS tokens, count(*) AS docs, true AS whole FROM s GROUP BY shard")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest saved, loaded, and checked against the files' SHA-256."""
    made = token_files(spark, sf_dir)
    made.save(f"{made.folder}/manifest.json")
    found = shards.Manifest.load(f"{made.folder}/manifest.json")
    broken = set(found.verify(spark))
    return spark.createDataFrame([(s["path"], s["tokens"], s["docs"], s["path"] not in broken) for s in found.shards], "path string, tokens long, docs long, whole boolean")


@query(f"""WITH {TOKENS_SQL}, {_SHARDS_SQL},
f AS (SELECT shard, flatten(list(tokens ORDER BY doc)) AS flat, list(len(tokens) ORDER BY doc) AS sizes FROM s GROUP BY shard),
o AS (SELECT shard, flat, list_transform(range(1, len(sizes) + 1), lambda k: CAST(list_sum(sizes[1:k]) AS BIGINT)) AS ends FROM f),
v AS (SELECT shard, flat, ends, unnest(range(0, CASE WHEN len(flat) > {WINDOW} THEN (len(flat) - 1) // {WINDOW} ELSE 0 END)) AS k FROM o)
SELECT CAST(shard AS BIGINT) AS shard, k AS "window", flat[k * {WINDOW} + 1:k * {WINDOW} + {WINDOW + 1}] AS tokens,
  list_transform([0] || list_transform(list_filter(ends, lambda e: e > k * {WINDOW} AND e < (k + 1) * {WINDOW}), lambda e: e - k * {WINDOW}) || [{WINDOW}], lambda e: CAST(e AS INTEGER)) AS cu_seqlens,
  list_transform(range(1, {WINDOW + 1}), lambda j: CASE WHEN list_contains(ends, k * {WINDOW} + j) THEN 0 ELSE 1 END) AS loss_mask FROM v""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch's samples from the shard files: tokens, sections and loss mask of every window, in the order of the stream."""
    made = token_files(spark, sf_dir)
    stream = shards.TokenStream([s["tokens"] for s in made.shards], WINDOW, 9)
    out = stream.samples(spark, [f"{made.folder}/{s['path']}" for s in made.shards])
    places = stream.table(spark)  # the same samples without a file, which also proves every position is taken once
    return out.join(places, ["position", "epoch", "shard", "window"]).select("shard", "window", "tokens", "cu_seqlens", "loss_mask")


_FIRST = _splitmix_sql("(SELECT i, CAST(i AS UHUGEINT) AS a FROM range((SELECT count(*) FROM documents)) t(i))", "a", "b")


@query(f"SELECT i AS position, CASE WHEN (u // 2048) / 9007199254740992 < CAST(0.75 AS DOUBLE) THEN 0 ELSE 1 END::BIGINT AS source FROM {_splitmix_sql(f'(SELECT i, xor(b, 5::UHUGEINT) AS c FROM {_FIRST})', 'c', 'u')}")
def mixture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each of as many samples as there are documents, over streams of the documents' sizes."""
    sizes = [r.n for r in table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).orderBy("source").collect()]
    mixture = shards.Mixture([shards.TokenStream(sizes[::2], 64, 1), shards.TokenStream(sizes[1::2] or sizes, 64, 2)], [3.0, 1.0], 5)
    n = table(spark, sf_dir, "documents").count()
    assert mixture.taken(mixture.state(n))[0] == n
    return mixture.table(spark, n).select("position", "source")


_LETTER = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}" + "\x01" + r"]+|\s+"
ORACLE["pretokenized_counts"] = "SELECT piece, count(*) AS count FROM (SELECT unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '(\\s)(\\s)(\\S)', '\\1\x01\\2\\3', 'g'), '" + _LETTER.replace("'", "''") + "')) AS piece FROM documents) GROUP BY 1"
_DRAWS = "SELECT i AS pos, CAST('0x' || substr(md5('6:' || i), 1, 13) AS HUGEINT) AS u FROM range(1000) t(i)"
ORACLE["weighted_sampler_replace"] = f"""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, greatest(CAST(floor(o_totalprice / (SELECT max(o_totalprice) FROM orders) * 4294967296 + 0.5) AS HUGEINT), 1) AS w FROM orders WHERE o_totalprice > 0),
s AS (SELECT idx, CAST(sum(w) OVER (ORDER BY idx) AS HUGEINT) AS high, w FROM o), d AS (SELECT pos, u * (SELECT max(high) FROM s) // 4503599627370496 AS point FROM ({_DRAWS}))
SELECT pos, idx FROM d JOIN s ON point >= high - w AND point < high"""
