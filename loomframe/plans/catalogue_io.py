"""Registered queries of the readers: each writes the driver's rows as files of a format into the shared folder and reads them back."""

from __future__ import annotations

import gzip
import io
import os
import sqlite3
import struct
import tarfile
import tempfile
import uuid
import wave
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import files
from loomframe.functions.positions import shared_dir
from loomframe.operators import image
from loomframe.plans.catalogue import query, table
from loomframe.sources import binary, compression, jsondoc, registry, tabular
from loomframe.streaming import lines, run_once


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/loomframe/{label}-{uuid.uuid4().hex}"


def put(spark: SparkSession, label: str, rows: DataFrame) -> str:
    """Files of ``rows(name, content)`` in a new folder, each written by the task that has its row."""
    to = folder(spark, label)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                files.write_from_task(f"{to}/{name}", bytes(content))
            yield pd.DataFrame({"n": [len(frame)]})

    rows.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return to


def grouped(rows: DataFrame, into: int, key: str, make: Callable[[pd.DataFrame], bytes], name: str) -> DataFrame:
    """(name, content): the rows dealt to ``into`` files by their key, each made from its rows in the order of the key."""
    run = lambda f: pd.DataFrame({"name": [name.format(int(f["_file"].iloc[0]))], "content": [make(f.sort_values(key).reset_index(drop=True))]})
    return rows.withColumn("_file", F.pmod(key, F.lit(into))).groupBy("_file").applyInPandas(run, "name string, content binary")


def written(spark: SparkSession, label: str, rows: DataFrame, order: str, line: Column, *, around: tuple[str, str] | None = None) -> str:
    """Text files with a line for each row in ``order``, with other lines before and after each if given."""
    to = folder(spark, label)
    cells = [F.lit(around[0]), line, F.lit(around[1])] if around else [line]
    rows.orderBy(order).select(F.explode(F.array(*cells)).alias("value")).write.text(to)
    return to


#: Pixels of an 8x8 image from the 64 numbers of an embedding, as a column, in SQL and in numpy.
PIXELS_SQL = "list_transform(embedding, lambda x: ((CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) % 256) + 256) % 256)"
HEX_SQL = "lower(array_to_string(list_transform({}, lambda p: lpad(to_hex(p), 2, '0')), ''))"


def pixels() -> Column:
    return F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 1000), F.lit(256)).cast("int"))


def packed(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda p: F.lpad(F.hex(p), 2, "0")), ""))


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, bytes) of 8x8 gray images."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), packed(pixels()).alias("bytes"))


# --- tables as text ----------------------------------------------------------------------------------------------

ORDERS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, [CAST(o_custkey AS DOUBLE), o_totalprice] AS input, CAST(o_orderkey AS DOUBLE) AS label FROM orders"


def orders_csv(spark: SparkSession, sf_dir: str) -> str:
    to = folder(spark, "csv")
    table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey").orderBy("o_orderkey").write.option("header", True).csv(to)
    return to


@query(ORDERS)
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.csv(spark, orders_csv(spark, sf_dir), label="o_orderkey", dtype="double")


@query(ORDERS)
def open_by_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.open_uri(spark, f"csv:{orders_csv(spark, sf_dir)}", {"label_index": 2, "dtype": "double"})


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, [o_totalprice, CAST(o_custkey AS DOUBLE)] AS input, CAST(o_orderkey AS DOUBLE) AS label FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 5")
def read_csv_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells, comments, blank lines, cells that are no numbers and records with a cell too many."""
    price = F.when(F.col("o_orderkey") % 7 == 0, "abc").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat(F.lit('"'), "o_orderkey", F.lit('";'), price, F.lit(';"'), "o_custkey", F.when(F.col("o_orderkey") % 11 == 5, '";1').otherwise('"'))
    path = written(spark, "csv", table(spark, sf_dir, "orders"), "o_orderkey", line, around=("# a note", ""))
    return tabular.csv(spark, path, header=False, delimiter=";", label_index=0, comment="#", errors="skip", dtype="double")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, [CAST(o_custkey AS DOUBLE), CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END] AS input, CAST(o_orderkey AS DOUBLE) AS label FROM orders")
def read_csv_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells broken over lines, and marks for what is missing."""
    price = F.when(F.col("o_orderkey") % 5 == 0, F.element_at(F.array(*map(F.lit, tabular.NA_VALUES)), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat(F.lit('"'), "o_custkey", F.lit('\n",'), price, F.lit(","), "o_orderkey")
    return tabular.csv(spark, written(spark, "csv", table(spark, sf_dir, "orders"), "o_orderkey", line), header=False, na="null", dtype="double")


@query(ORDERS)
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.array(F.col("o_custkey").cast("double"), "o_totalprice", F.col("o_orderkey").cast("double")))
    return tabular.jsonl_arrays(spark, written(spark, "jsonl", table(spark, sf_dir, "orders"), "o_orderkey", line))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, left(props, 7) AS input, row_number() OVER (ORDER BY event_id) - 1 AS label FROM events")
def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, "text", table(spark, sf_dir, "events"), "event_id", F.concat("props", F.lit("\r")), around=("", ""))
    return tabular.text_lines(spark, path, max_length=7).withColumn("input", F.decode("input", "UTF-8"))


@query("SELECT props AS input FROM events")
def stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, to = written(spark, "text", table(spark, sf_dir, "events"), "event_id", F.col("props"), around=("", "")), folder(spark, "stream")
    run_once(lines(spark, path, max_files=2), lambda df: df.select(F.decode("input", "UTF-8").alias("input")), f"{to}/rows", f"{to}/checkpoint")
    return spark.read.schema("input string").parquet(f"{to}/rows")


# --- JSON --------------------------------------------------------------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str, bad: bool = False) -> tuple[str, list[jsondoc.Field]]:
    rows = table(spark, sf_dir, "events")
    kinds = [r.event_type for r in rows.select("event_type").distinct().orderBy("event_type").limit(100).collect()]
    feat = F.struct(F.col("value").alias("a"), F.array(F.col("user_id").cast("double"), "value").alias("b"))
    boxes = F.transform(F.sequence(F.lit(1), F.pmod("event_id", F.lit(3)) + 1), lambda k: F.struct(F.array(k, F.col("user_id")).alias("bbox")))
    line = F.to_json(F.struct(F.struct(F.concat(F.lit("e"), "event_id").alias("id")).alias("meta"), feat.alias("feat"), F.col("event_type").alias("cls"), boxes.alias("ann")))
    if bad:
        line = F.when(F.col("event_id") % 13 == 0, F.lit('{"feat": {')).when(F.col("event_id") % 17 == 0, F.lit('{"cls": "none of them"}')).otherwise(line)
    fields = [
        jsondoc.Field("id", "metadata", "meta.id"), jsondoc.Field("value", "input", "feat.a"), jsondoc.Field("user", "input", "feat.b[0]"), jsondoc.Field("cls", "label", dtype="bigint", categories=kinds),
        jsondoc.Field("boxes", "extra", "ann[*].bbox", rank=1), jsondoc.Field("weight", "extra", default=1.0),
    ]
    return written(spark, "json", rows, "event_id", line), fields


EVENTS = """SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, 'e' || event_id AS id, value, CAST(user_id AS DOUBLE) AS user, place - 1 AS cls,
  list_transform(range(1, event_id % 3 + 2), lambda k: [CAST(k AS DOUBLE), CAST(user_id AS DOUBLE)]) AS boxes, CAST(1 AS DOUBLE) AS weight, [value, CAST(user_id AS DOUBLE)] AS input
FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) AS place FROM events) {}"""


@query(EVENTS.format(""))
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, fields = event_lines(spark, sf_dir)
    return jsondoc.read(spark, path, fields)


@query(EVENTS.format("WHERE event_id % 13 <> 0 AND event_id % 17 <> 0").replace("row_number() OVER (ORDER BY event_id) - 1 AS idx, ", ""))
def read_json_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, fields = event_lines(spark, sf_dir, bad=True)
    return jsondoc.read(spark, path, fields, skip_invalid=True).drop("idx")


@query(EVENTS.format("WHERE event_id % 13 <> 0 AND event_id % 17 <> 0").replace("row_number() OVER (ORDER BY event_id) - 1 AS idx, ", "").replace(", [value, CAST(user_id AS DOUBLE)] AS input", ""))
def stream_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    (path, fields), to = event_lines(spark, sf_dir, bad=True), folder(spark, "stream")
    rows = jsondoc.stream_lines(spark, path, fields)
    run_once(rows, lambda df: df, f"{to}/rows", f"{to}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{to}/rows")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, CAST(n_nationkey AS DOUBLE) AS key, n_name AS name FROM nation")
def read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("items"))
    doc = F.to_json(F.struct(F.struct(F.lit(2).alias("v")).alias("meta"), F.struct("items").alias("data")))
    path = put(spark, "json", rows.select(F.lit("doc.json").alias("name"), F.encode(doc, "UTF-8").alias("content")))
    return jsondoc.read(spark, path, [jsondoc.Field("key"), jsondoc.Field("name", "metadata")], records_path="data.items")


@query("SELECT 'array' AS file, true AS is_array UNION ALL SELECT 'lines', count(*) < 0 FROM region")
def json_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.array("r_regionkey", F.lit(1)))
    path = put(spark, "json", table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(row)).alias("rows")).select(F.explode(F.array(
        F.struct(F.lit("array").alias("name"), F.encode(F.concat(F.lit("[\n"), F.array_join("rows", ",\n"), F.lit("\n]\n")), "UTF-8").alias("content")),
        F.struct(F.lit("lines").alias("name"), F.encode(F.array_join("rows", "\n"), "UTF-8").alias("content")))).alias("f")).select("f.*"))
    return spark.createDataFrame([(name, jsondoc.is_array(spark, f"{path}/{name}")) for name in ("array", "lines")], "file string, is_array boolean")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal, [CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE), s_acctbal] AS input FROM supplier")
def read_json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return jsondoc.read(spark, written(spark, "json", rows, "s_suppkey", F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_size AS pixel_size, CASE p_brand WHEN (SELECT min(p_brand) FROM part) THEN 0 ELSE 1 END AS brand, p_name AS meta_name FROM part WHERE p_brand IN ((SELECT min(p_brand) FROM part), (SELECT max(p_brand) FROM part))")
def read_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    low, high = rows.agg(F.min("p_brand"), F.max("p_brand")).first()
    schema = {"type": "object", "properties": {
        "pixel": {"type": "object", "properties": {"size": {"type": "integer", "x-dtype": "int"}}}, "brand": {"type": "string", "enum": [low, high], "x-role": "label", "x-dtype": "int"},
        "meta": {"type": "object", "properties": {"name": {"type": "string"}}}}}
    line = F.to_json(F.struct(F.struct(F.col("p_size").alias("size")).alias("pixel"), F.col("p_brand").alias("brand"), F.struct(F.col("p_name").alias("name")).alias("meta")))
    return jsondoc.read(spark, written(spark, "json", rows.where(F.col("p_brand").isin(low, high)), "p_partkey", line), jsondoc.fields_from_schema(schema))


# --- columnar files and databases --------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, [o_orderkey, o_custkey] AS input, o_totalprice AS label, o_orderstatus FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority <> '5-LOW' AND o_orderstatus <= 'O'")
def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey, o_custkey", label="o_totalprice", metadata=("o_orderstatus",), predicates=[("o_totalprice", "ge", 1000), ("o_orderpriority", "ne", "5-LOW"), ("o_orderstatus", "le", "O")])


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, [epoch_us(o_orderdate)] AS input, o_orderkey AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders")
def read_parquet_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times become whole numbers, null floats NaN, null texts empty."""
    to = folder(spark, "parquet")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderstatus")).alias("status"),
    )
    rows.orderBy("o_orderkey").write.parquet(to)
    return tabular.parquet(spark, to, ["o_orderdate"], label="o_orderkey", extras=("price",), metadata=("status",))


CUSTOMERS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS c_acctbal, c_name FROM customer"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_name")


def _ipc(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(frame["c_custkey"], pa.int64()), pa.array(frame["c_acctbal"], pa.float64(), from_pandas=True), pa.array(frame["c_name"], pa.string())], ["c_custkey", "c_acctbal", "c_name"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, batch.schema) as f:
        for lo in range(0, len(frame), 100):
            f.write_batch(batch.slice(lo, 100))
    return out.getvalue().to_pybytes()


@query(CUSTOMERS)
def read_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.arrow_ipc(spark, put(spark, "ipc", grouped(customers(spark, sf_dir), 3, "c_custkey", _ipc, "{}.arrow"))).drop("idx")


@query("SELECT c_name, c_custkey FROM customer")
def read_feather_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.open_uri(spark, "feather:" + put(spark, "ipc", grouped(customers(spark, sf_dir), 2, "c_custkey", _ipc, "{}.feather")), {"columns": ["c_name", "c_custkey"]}).drop("idx")


def _copy(frame: pd.DataFrame) -> bytes:
    out = [binary.COPY_SIGNATURE, struct.pack(">II", 0, 0)]
    for key, balance, name in zip(frame["c_custkey"], frame["c_acctbal"], frame["c_name"], strict=True):
        text = name.encode()
        out.append(struct.pack(">hiq", 3, 8, key) + (struct.pack(">i", -1) if balance != balance else struct.pack(">id", 8, balance)) + struct.pack(">i", len(text)) + text)
    return b"".join([*out, struct.pack(">h", -1)])


@query(CUSTOMERS)
def read_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = put(spark, "copy", grouped(customers(spark, sf_dir), 3, "c_custkey", _copy, "{}.copy"))
    return binary.copy_binary(spark, path, [("c_custkey", "int64"), ("c_acctbal", "float64"), ("c_name", "text")]).drop("idx")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, [CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey END AS FLOAT), CAST(s_acctbal AS FLOAT)] AS input, CAST(s_suppkey AS FLOAT) AS label FROM supplier")
def read_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(frame: pd.DataFrame) -> bytes:
        with sqlite3.connect(":memory:") as db:
            db.execute("create table s (s_suppkey integer, s_nationkey integer, s_acctbal real)")
            db.executemany("insert into s values (?, ?, ?)", [(int(k), None if k % 4 == 0 else int(n), float(b)) for k, n, b in zip(frame["s_suppkey"], frame["s_nationkey"], frame["s_acctbal"], strict=True)])
            db.commit()
            return db.serialize()

    path = put(spark, "sqlite", grouped(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), 1, "s_suppkey", make, "{}.db"))
    return tabular.sqlite(spark, f"{path.removeprefix('file://').removeprefix('file:')}/0.db", "select s_nationkey, s_acctbal, s_suppkey from s order by s_suppkey")


def _derby(spark: SparkSession, rows: DataFrame, name: str, key: str) -> str:
    """The URL of a database with one table, packed into an archive in the shared folder. Derby opens a folder in one process at a time
    only; an archive is read-only, and the driver and all executors read it together."""
    driver, kinds = spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), {"bigint": "bigint", "int": "integer", "double": "double", "string": "clob"}
    connect = lambda url: driver.connect(url, spark._jvm.java.util.Properties())
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.coalesce(quoted(c) if kind == "string" else F.col(c).cast("string"), F.lit("")) for c, kind in rows.dtypes]
    path = written(spark, "derby", rows, key, F.concat_ws(",", *cells)).removeprefix("file://").removeprefix("file:")
    with tempfile.TemporaryDirectory() as held:
        url = f"jdbc:derby:{os.path.realpath(held)}/db"
        db = connect(f"{url};create=true")
        try:
            db.createStatement().execute(f"create table {name} ({', '.join(f'{chr(34)}{c}{chr(34)} {kinds[kind]}' for c, kind in rows.dtypes)})")
            load = db.prepareStatement(f"call syscs_util.syscs_import_table(null, '{name.upper()}', ?, null, null, 'UTF-8', 0)")
            for part in sorted(Path(path).glob("part-*")):
                load.setString(1, str(part))
                load.execute()
        finally:
            db.close()
            try:
                connect(f"{url};shutdown=true")
            except Py4JJavaError as e:  # how Derby says that the database is closed
                if e.java_exception.getSQLState() != "08006":
                    raise
        with zipfile.ZipFile(f"{path}/{name}.jar", "w", zipfile.ZIP_STORED) as z:  # pages are read at their places, which packed bytes do not allow
            for f in sorted(Path(held).rglob("*")):
                z.write(f, f.relative_to(held))
    return f"jdbc:derby:jar:({path}/{name}.jar)db"


@query("SELECT [CAST(s_nationkey AS DOUBLE), s_acctbal] AS input, s_suppkey AS label, s_name FROM supplier")
def read_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database that Spark brings along, in the shared folder."""
    url = _derby(spark, table(spark, sf_dir, "supplier"), "supplier", "s_suppkey")
    rows = tabular.jdbc(spark, url, 'select "s_suppkey", "s_name", "s_nationkey", "s_acctbal" from supplier', fetch_size=50, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return tabular.sql_rows(rows, [("s_suppkey", "label"), ("s_name", "auto"), ("s_nationkey", "auto"), ("s_acctbal", "input")])


# --- arrays ------------------------------------------------------------------------------------------------------


def _npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS input, CAST(label AS DOUBLE) AS label FROM embeddings")
def read_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    x = put(spark, "npy", grouped(rows, 1, "vec_id", lambda f: gzip.compress(_npy(np.array(f["embedding"].tolist(), ">f4"))), "x{}.npy.gz"))
    y = put(spark, "npy", grouped(rows, 1, "vec_id", lambda f: _npy(f["label"].to_numpy(np.int32)), "y{}.npy"))
    return binary.npy(spark, x, y)


@query("WITH a AS (SELECT list(CAST(label AS DOUBLE) ORDER BY vec_id) AS y, CAST(count(*) AS INTEGER) AS n, flatten(list(list_transform(embedding[1:2], lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)) AS x FROM embeddings) SELECT 0 AS idx, 'x' AS name, [n, 2] AS shape, x AS data FROM a UNION ALL SELECT 1, 'y', [n], y FROM a")
def read_npz(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(frame: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("x.npy", _npy(np.array(frame["x"].tolist(), np.float32)), zipfile.ZIP_DEFLATED)
            z.writestr("y.npy", _npy(frame["label"].to_numpy(np.int64)), zipfile.ZIP_STORED)
        return out.getvalue()

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("x"), "label")
    return binary.npz(spark, put(spark, "npz", grouped(rows, 1, "vec_id", make, "{}.npz"))).withColumn("idx", F.col("idx").cast("int"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, [CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)] AS input, CAST(n_regionkey AS BIGINT) AS label FROM nation")
def in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").toPandas()
    return tabular.in_memory(spark, rows.to_numpy(float), rows["n_regionkey"].to_numpy(np.int64)[:, None])


@query("SELECT i AS idx, i * i AS square, 'row ' || i AS name FROM range((SELECT count(*) FROM customer)) t(i)")
def function_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.from_function(spark, table(spark, sf_dir, "customer").count(), lambda i: (i * i, f"row {i}"), "square long, name string")


@query("SELECT i AS idx, i % 7 AS seventh FROM range((SELECT count(*) FROM customer)) t(i)")
def generator_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    return tabular.generator(spark, lambda: ((i % 7,) for i in range(n)), "seventh long")


@dataclass
class Country:
    """A record of the query below."""

    key: int
    name: str
    half: float


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, CAST(n_nationkey AS BIGINT) AS key, n_name AS name, n_regionkey / 2 AS half FROM nation")
def records_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return tabular.records(spark, [Country(r.n_nationkey, r.n_name, r.n_regionkey / 2) for r in rows])


# --- images, audio, archives -------------------------------------------------------------------------------------


def _bmp(x: np.ndarray) -> bytes:
    h, w = x.shape
    rows = b"".join(np.repeat(line[:, None], 3, axis=1).tobytes().ljust(-(-3 * w // 4) * 4, b"\0") for line in x[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def _tiff(x: np.ndarray) -> bytes:
    h, w = x.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, h * w)]
    table_ = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + h * w) + x.tobytes() + table_


ENCODERS: tuple[Callable[[np.ndarray], bytes], ...] = (lambda x: image.encode_png(x[..., None]), _bmp, lambda x: b"P5\n# note\n8 8\n255\n" + x.tobytes(), _tiff)


@query(f"SELECT vec_id, [8, 8, 1] AS shape, {HEX_SQL.format(PIXELS_SQL)} AS pixels FROM embeddings")
def decode_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG, BMP, PGM and TIFF in turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [image.decode(ENCODERS[k % 4](np.frombuffer(b, np.uint8).reshape(8, 8)), "gray") for k, b in zip(frame["vec_id"], frame["bytes"], strict=True)]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "shape": [list(m.shape) for m in made], "pixels": [m.tobytes().hex() for m in made]})

    return small_images(spark, sf_dir).select("vec_id", "bytes").mapInPandas(run, "vec_id long, shape array<int>, pixels string")


@query(f"SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS idx, 'c' || label AS class, CAST(label + 1 AS BIGINT) AS label, {HEX_SQL.format(PIXELS_SQL)} AS pixels FROM embeddings")
def read_image_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each class, and one that holds no image but counts."""
    encode = F.udf(lambda b: image.encode_png(np.frombuffer(b, np.uint8).reshape(8, 8, 1)), "binary")
    root = put(spark, "images", small_images(spark, sf_dir).select(F.format_string("c%d/%09d.png", "label", "vec_id").alias("name"), encode("bytes").alias("content")))
    files.write(f"{root}/b_empty/note.txt", b"no image")
    return binary.image_folder(spark, root).select("idx", "class", "label", F.lower(F.hex("input")).alias("pixels"))


@query("SELECT page_id, ['jpeg', 'png', 'gif', 'bmp', 'webp', 'tiff', 'wav', 'flac', 'ogg', 'mp3', 'avif', 'mp4', 'unknown'][page_id % 13 + 1] AS format FROM pages")
def sniff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = {name: b"\0" * at + magic for at, magic, name in reversed(binary.MEDIA)} | {"webp": b"RIFF\0\0\0\0WEBP", "wav": b"RIFF\0\0\0\0WAVE", "unknown": b""}
    order = ["jpeg", "png", "gif", "bmp", "webp", "tiff", "wav", "flac", "ogg", "mp3", "avif", "mp4", "unknown"]
    head = F.element_at(F.array(*(F.lit(heads[n]) for n in order)), (F.col("page_id") % 13 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", binary.media_format(F.concat(head, F.encode("html", "UTF-8"))).alias("format"))


@query(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, [8, 8, 1] AS shape, {HEX_SQL.format(PIXELS_SQL)} AS pixels, CAST(label AS BIGINT) AS label FROM embeddings")
def read_mnist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = small_images(spark, sf_dir)
    x = put(spark, "idx", grouped(rows, 1, "vec_id", lambda f: struct.pack(">IIII", 2051, len(f), 8, 8) + b"".join(map(bytes, f["bytes"])), "x{}"))
    y = put(spark, "idx", grouped(rows, 1, "vec_id", lambda f: struct.pack(">II", 2049, len(f)) + f["label"].to_numpy(np.uint8).tobytes(), "y{}"))
    return binary.mnist(spark, x, y).select("idx", "shape", F.lower(F.hex("input")).alias("pixels"), "label")


@query(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, [32, 32, 3] AS shape, {HEX_SQL.format(f'flatten(list_transform({PIXELS_SQL}, lambda p: [p, 255 - p, p]))')} AS first, CAST(label AS BIGINT) AS label FROM embeddings")
def read_cifar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red and blue planes repeat the image, green ones its negative; the first 64 pixels are looked at."""

    def make(frame: pd.DataFrame) -> bytes:
        out = []
        for label, raw in zip(frame["label"], frame["bytes"], strict=True):
            plane = np.tile(np.frombuffer(raw, np.uint8), 16)
            out.append(bytes([label]) + plane.tobytes() + (255 - plane).astype(np.uint8).tobytes() + plane.tobytes())
        return b"".join(out)

    path = put(spark, "cifar", grouped(small_images(spark, sf_dir), 1, "vec_id", make, "{}.bin"))
    return binary.cifar(spark, path).select("idx", "shape", F.lower(F.hex(F.substring("input", 1, 192))).alias("first"), "label")


@query(f"SELECT printf('%06d', vec_id) AS key, [8, 8, 1] AS shape, {HEX_SQL.format(PIXELS_SQL)} AS pixels, CAST(label AS BIGINT) AS label FROM embeddings")
def read_web_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(frame: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for k, label, raw in zip(frame["vec_id"], frame["label"], frame["bytes"], strict=True):
                for suffix, body in (("cls", str(label).encode()), ("pgm", b"P5\n8 8\n255\n" + bytes(raw))):
                    member = tarfile.TarInfo(f"part/{k:06d}.{suffix}")
                    member.size = len(body)
                    tar.addfile(member, io.BytesIO(body))
        return compression.compress(out.getvalue(), "zstd")

    path = put(spark, "tar", grouped(small_images(spark, sf_dir), 3, "vec_id", make, "{}.tar.zst"))
    return binary.web_dataset(spark, path).select("key", "shape", F.lower(F.hex("input")).alias("pixels"), "label")


def _wav(raw: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.frombuffer(raw, np.uint8).astype("<i2") * 100).tobytes())
    return out.getvalue()


WAVES = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, 8000 AS rate, [{frames}, 1] AS shape, list_resize(list_transform({pixels}, lambda p: p * 100 / 32768), {frames}, CAST({pad} AS DOUBLE)) AS input FROM embeddings"


def waves(spark: SparkSession, sf_dir: str) -> str:
    encode = F.udf(_wav, "binary")
    return put(spark, "wav", small_images(spark, sf_dir).select(F.format_string("%09d.wav", "vec_id").alias("name"), encode("bytes").alias("content")))


@query(WAVES.format(frames=70, pixels=PIXELS_SQL, pad=-1))
def read_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.wav(spark, waves(spark, sf_dir), frames=70, pad=-1.0).drop("path")


@query(WAVES.format(frames=20, pixels=PIXELS_SQL, pad=0))
def read_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.audio(spark, waves(spark, sf_dir), frames=20).drop("path")


@query("SELECT event_id, ['gzip', 'zstd', 'lz4', 'bzip2', 'xz', 'zlib'][event_id % 6 + 1] AS codec, props FROM events")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text compressed by one codec, known again by its first bytes or its name, and opened."""
    names = ("gzip", "zstd", "lz4", "bzip2", "xz", "zlib")
    suffix = {v: k for k, v in reversed(compression.SUFFIX.items())}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text in zip(frame["event_id"], frame["props"], strict=True):
                data = compression.compress(text.encode(), names[k % 6])
                rows.append((k, compression.sniff(data, f"x{suffix['zlib']}"), compression.opened(data, f"x{suffix['zlib']}").decode()))
            yield pd.DataFrame(rows, columns=["event_id", "codec", "props"])

    return table(spark, sf_dir, "events").select("event_id", "props").mapInPandas(run, "event_id long, codec string, props string")
