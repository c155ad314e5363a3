"""Registered queries over text, JSON, token shards and media."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.rng import Feistel
from loomframe.operators import image
from loomframe.plans.catalogue import at, query, table
from loomframe.sources import binary, jsondoc
from loomframe.text import shards, tokenizers


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", jsondoc.extract(F.col("v"), jsondoc.steps("k"), "double").alias("k"))


@query("SELECT event_id, [CAST(json_extract(props, '$.k') AS DOUBLE), CAST(event_id AS DOUBLE)] AS boxes FROM events")
def json_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"ann": [{"x": '), F.get_json_object("props", "$.k"), F.lit('}, {"x": '), F.col("event_id").cast("string"), F.lit("}]}"))
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json(text))
    return rows.select("event_id", jsondoc.extract(F.col("v"), jsondoc.steps("ann[*].x"), "double").alias("boxes"))


@query("SELECT l_orderkey, l_linenumber, [l_quantity, l_tax] AS input, l_discount AS label FROM lineitem")
def jsonl_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.array("l_quantity", "l_tax", "l_discount"))
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.from_json(line, "array<double>"))
    return rows.select("l_orderkey", "l_linenumber", F.slice("a", F.lit(1), F.size("a") - 1).alias("input"), F.element_at("a", -1).alias("label"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS line, strlen(value) AS bytes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) WHERE value <> ''")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line", "value"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.octet_length("value").cast("long").alias("bytes"))


@query(r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[^ \n\t\r\f\v]+')) AS word FROM documents) GROUP BY 1")
def bpe_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.filter(F.split("text", r"[ \n\t\r\f\x0B]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@query()
def pretokenized_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.piece_counts(table(spark, sf_dir, "documents"), "text")


@query()
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokenizers.tokens(tokenizers.WhitespaceHash(30_000), "text").alias("tokens"))


@query()
def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = tokenizers.train(table(spark, sf_dir, "conversations"), "text", 400)
    return spark.createDataFrame([(r, p.hex()) for p, r in bpe.ranks.items()], "rank long, piece string")


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    bpe = tokenizers.train(rows, "text", 400)
    return rows.select("conv_id", "turn", tokenizers.tokens(bpe, "text").alias("tokens"))


@query("SELECT count(*) AS n, min(i) AS low, max(i) AS high, count(DISTINCT i) AS different FROM range((SELECT count(*) FROM orders)) t(i)")
def feistel_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    order = Feistel(n, 42)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"i": order(frame["id"].to_numpy(np.uint64)).astype(np.int64)})

    return spark.range(n).mapInPandas(run, "i long").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.count_distinct("i").alias("different"))


@query()
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [r.n for r in table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).orderBy("source").collect()]
    return shards.TokenStream(sizes, 128, 9, rank=1, world=4).table(spark, epochs=2)


@query()
def mixture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = [shards.TokenStream([10_000, 5_000], 64, 1), shards.TokenStream([7_000], 64, 2)]
    return shards.Mixture(streams, [3.0, 1.0], 5).table(spark, 2_000)


@query()
def best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.packed(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 4096, 8)


@query()
def image_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "embeddings", "vec_id")
    pixels = F.transform("embedding", lambda x: F.pmod(F.floor(x * 1000), F.lit(256)).cast("int"))
    content = F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    images = rows.select("idx", F.array(F.lit(8), F.lit(8), F.lit(1)).alias("shape"), content.alias("input"), F.col("label").cast("long").alias("label"))
    return image.apply(images, image.resize(6, 6), image.random_crop(4, 4), image.random_flip(), image.to_tensor(), image.normalize([0.5], [0.5]), seed=3)


@query("SELECT page_id, 'unknown' AS format FROM pages")
def media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", binary.media_format(F.encode("html", "UTF-8")).alias("format"))
