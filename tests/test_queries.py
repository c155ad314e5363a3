"""Registered queries of readers, steps and shards against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomframe.plans import catalogue, catalogue_io, catalogue_more  # noqa: F401  the others add their queries to the first

SF = "/root/testdata/sf0.001"
NAN = math.nan
NAMES = (
    "read_csv_skip", "read_csv_missing", "read_json_skip", "read_parquet_types", "read_ipc", "read_copy", "read_npz", "read_image_folder", "read_web_dataset", "codecs", "convert_types", "collate_pad_matrices",
    "tensor_ops", "image_grayscale", "wordpiece_letters", "token_windows", "mixture_sources", "weighted_sampler_replace", "feistel_order", "pcg32",
)


def plain(x):
    """A value as text that Spark and DuckDB agree on."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return [plain(v) for v in x] if isinstance(x, list | tuple) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "embeddings"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found, df = db.sql(catalogue.ORACLE[name]), catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    want = sorted(str([plain(r[k]) for k in order]) for r in found.fetchall())
    assert want and sorted(str(plain(list(r))) for r in df.select(*columns).collect()) == want


def test_vectors_are_rounded_as_their_sql_rounds(spark, tmp_path):
    db, vectors = duckdb.connect(), [[1.0, -3e-6, 3e-6], [-0.0, 2.0, -1e-30], [3.0, -4.0, 0.0], [1.0, None, -2.0], [None, None, None], [NAN, 1.0, -1.0], [], None]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").selectExpr("vec_id", "1 as label", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    db.sql(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(f"select vec_id, embedding from ({catalogue.ORACLE['normalizer_vector']}) order by vec_id").fetchall()
    got = catalogue.QUERIES["normalizer_vector"](spark, str(tmp_path)).orderBy("vec_id").collect()
    assert str(want[0][1]) == "[1.0, -0.0, 0.0]" and [str((r.vec_id, r.embedding)) for r in got] == [str(r) for r in want]  # as text, where zero has a sign


def test_doubles_are_rounded_as_duckdb_rounds_them(spark):
    found = [s * x for x in (0.0, 5e-6, 3.5e-5, 1.005005, 0.5, 1e306, 4503599627.370497, math.inf, NAN) for s in (1, -1)]
    want = duckdb.execute("select round(unnest(?::double[]), 5)", [found]).fetchall()
    got = spark.createDataFrame(list(enumerate(found)), "k long, x double").orderBy("k").select(catalogue.rounded_double(F.col("x"), 5)).collect()
    assert [str(r[0]) for r in got] == [str(r[0]) for r in want]
