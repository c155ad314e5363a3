import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe import types
from loomframe.errors import InvalidArgument, OutOfRange, ShapeMismatch
from loomframe.functions import numeric
from loomframe.functions.positions import dense_index, hash_index
from loomframe.functions.rng import Feistel, Pcg32, fnv1a64, order_key, philox
from loomframe.operators import algebra, batch, preprocess, sampling, split, stats, transforms

NAN, INF = float("nan"), float("inf")


def values(df, column="x", by="idx"):
    return [r[column] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(k, float(k), k % 2) for k in range(10)], "idx long, x double, label int")


def test_generators_give_known_values():
    assert [Pcg32(42).next(), *[Pcg32(42).permutation(8)]] == [2707161783, [0, 1, 6, 7, 2, 4, 3, 5]]
    assert philox(np.zeros((1, 4), np.uint32), (0, 0)).tolist() == [[0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]]
    assert fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert all(Pcg32(s).below(10) < 10 for s in range(50))
    for n in (1, 2, 5, 64, 1000):
        assert sorted(Feistel(n, 7)(np.arange(n)).tolist()) == list(range(n))


def test_element_wise_functions_guard_nan_null_and_infinities(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((NAN, None, -2.0, -1.0, 0.5, INF))], "idx long, x double")
    x = F.col("x")
    got = lambda c: values(df.select("idx", c.alias("x")))
    clipped = got(numeric.clip(x, 0, 1))
    assert math.isnan(clipped[0]) and clipped[1:] == [None, 0, 0, 0.5, 1]
    logs = got(numeric.log1p(x))
    assert math.isnan(logs[2]) and logs[3] == -INF and logs[4] == pytest.approx(math.log1p(0.5))
    assert got(numeric.binarize(x, 0)) == [0, 0, 0, 0, 1, 1]
    ratio = got(numeric.scalar(x, "div", 0))
    assert math.isnan(ratio[0]) and ratio[2:] == [-INF, -INF, INF, INF]
    with pytest.raises(InvalidArgument):
        numeric.clip(x, 1, 0)


def test_conversions_cut_and_wrap(spark):
    df = spark.createDataFrame([(0, 300.7), (1, -1.5), (2, 0.0)], "idx long, x double")
    got = lambda d: values(df.select("idx", types.converted(F.col("x"), d).alias("x")))
    assert got("int8") == [44, -1, 0] and got("uint8") == [44, 255, 0] and got("bool") == [True, True, False] and got("int64") == [300, -1, 0]
    assert types.numel([]) == 0 and types.numel([2, 3]) == 6


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_positions_do_not_depend_on_partitions(spark, parts):
    df = spark.range(100).select((99 - F.col("id")).alias("k")).repartition(parts)
    assert [r.idx for r in dense_index(df, "k").orderBy("k").collect()] == list(range(100))
    rows = hash_index(df, order_key(3, "k"), "k").collect()
    import hashlib

    want = sorted(range(100), key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())
    assert [r.k for r in sorted(rows, key=lambda r: r.pos)] == want


def test_algebra(spark, ten):
    assert values(algebra.take(ten, 2)) == [0, 1] and values(algebra.skip(ten, 8)) == [8, 9]
    assert algebra.repeat(ten, 2).count() == 20 and values(algebra.repeat(ten, 2))[10] == 0
    assert values(algebra.concatenated([ten, ten]))[9:12] == [9, 0, 1]
    kept = algebra.filtered(ten, "label = 1", renumber=True)
    assert [(r.idx, r.x) for r in kept.orderBy("idx").collect()] == [(0, 1), (1, 3), (2, 5), (3, 7), (4, 9)]
    both = algebra.zipped(ten.select("idx", "x", F.lit(7).alias("label")), ten.select("idx", "label"))
    assert values(both, "label") == [0, 1] * 5
    chosen = spark.createDataFrame([(0, 9), (1, 9), (2, 0)], "pos long, idx long")
    assert values(algebra.subset(ten, chosen)) == [9, 9, 0]
    with pytest.raises(OutOfRange):
        algebra.subset(ten, spark.createDataFrame([(0, 10)], "pos long, idx long"))
    with pytest.raises(ShapeMismatch):
        algebra.zipped(ten, algebra.take(ten, 3))
    for bad in ("x,,label", "x,x", "y"):
        with pytest.raises(InvalidArgument):
            algebra.project(ten, bad)
    with pytest.raises(InvalidArgument):
        algebra.where_all(ten, [("x", "eq", "text")])


def test_predicates_never_match_nan_or_null_and_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([(0, NAN, "a"), (1, None, None), (2, 2.0, "b")], "idx long, x double, s string").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    assert values(algebra.where_all(df, [("x", "ne", 5.0)])) == [2.0]
    kept = algebra.where_all(df, [("s", "ge", "b")])
    assert values(kept, "s") == ["b"]
    assert "PushedFilters: [IsNotNull(s), GreaterThanOrEqual(s,b)]" in kept._jdf.queryExecution().executedPlan().toString()


def test_statistics(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((1.0, NAN, 3.0, None, INF))], "idx long, x double")
    row = stats.column_stats(df, ["x"]).first()
    assert (row.missing, row["count"], row["min"], row["max"]) == (2, 3, 1.0, 0.0)
    bins = stats.histogram(df.where("idx < 4"), "x", 2).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [1, 1]
    empty = stats.histogram(df.where("idx = 1"), "x", 2).orderBy("bin").collect()
    assert [(b.low, b["count"]) for b in empty] == [(0, 0), (0.5, 0)]


def test_quantiles_are_exact_where_bins_are_refined(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=9000), np.full(6000, 0.125), [1e9, -1e9]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert stats.quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0])["x"] == pytest.approx(np.quantile(x, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist(), abs=1e-12)


def test_transformers(spark):
    df = spark.createDataFrame([(0, 0.0, 2.0), (1, 2.0, 0.0), (2, 4.0, 4.0)], "idx long, a double, b double")
    scaled = preprocess.StandardScaler(["a", "b"]).fit(df)
    assert scaled.fitted["mean"] == [2, 2]
    assert values(preprocess.MinMaxScaler(["a"]).fit_transform(df), "a") == [0, 0.5, 1]
    assert values(preprocess.MaxAbsScaler(["a"]).fit_transform(df), "a") == [0, 0.5, 1]
    assert values(preprocess.MaxAbsScaler(["a"]).fit_transform(df.withColumn("a", F.col("a") / 8)), "a") == [0, 0.25, 0.5]
    assert values(preprocess.RobustScaler(["a"]).fit_transform(df), "a") == [-1, 0, 1]
    assert values(preprocess.Normalizer(["a", "b"], norm="l1").fit_transform(df), "a") == [0, 1, 0.5]
    again = preprocess.loaded(scaled.saved())
    assert values(again.transform(df), "a") == values(scaled.transform(df), "a")
    with pytest.raises(ShapeMismatch):
        scaled.transform(df.drop("b"))
    with pytest.raises(InvalidArgument):
        preprocess.StandardScaler(["a"]).transform(df)


def test_imputer_and_encoders(spark):
    df = spark.createDataFrame([(0, 1.0, 20), (1, NAN, 10), (2, 3.0, 10), (3, None, 30)], "idx long, x double, c int")
    assert values(preprocess.Imputer(["x"]).fit_transform(df)) == [1, 2, 3, 2]
    assert values(preprocess.Imputer(["x"], strategy="mode").fit_transform(df)) == [1, 1, 3, 1]
    assert values(preprocess.Imputer(["x"], strategy="constant", fill=9).fit_transform(df)) == [1, 9, 3, 9]
    codes = preprocess.LabelEncoder(["c"]).fit(df)
    assert values(codes.transform(df), "c") == [1, 0, 0, 2]
    assert values(preprocess.OneHotEncoder(["c"]).fit_transform(df), "onehot")[0] == [0, 1, 0]
    with pytest.raises(Exception, match="unseen category"):
        codes.transform(df.withColumn("c", F.lit(99))).collect()


def test_scaler_is_fitted_on_train_alone(spark):
    train, test = spark.createDataFrame([(0, 0.0), (1, 2.0)], "idx long, x double"), spark.createDataFrame([(0, 4.0)], "idx long, x double")
    assert values(preprocess.StandardScaler(["x"]).fit(train).transform(test)) == [3.0]


def test_random_steps_follow_the_position(spark, ten):
    step = transforms.random_apply(transforms.scalar(["x"], "add", 100), 0.5, 3)
    once, other = values(step(ten)), values(step(ten.repartition(5)))
    assert once == other and 0 < sum(v >= 100 for v in once) < 10
    picked = values(transforms.one_of([transforms.scalar(["x"], "add", 100), transforms.scalar(["x"], "add", 200)], 1)(ten))
    assert {int(v // 100) for v in picked} == {1, 2}
    with pytest.raises(InvalidArgument):
        transforms.create("nothing", ["x"])


def test_splits_keep_their_promises(spark, ten):
    parts = split.random_split(ten, "idx", [0.5, 0.3, 0.2], 1).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [5, 3, 2]
    skewed = spark.createDataFrame([(k, int(k >= 80)) for k in range(100)], "idx long, label int")
    strata = {(r.label, r.part): r["count"] for r in split.stratified_split(skewed, "idx", "label", 0.75, 4).groupBy("label", "part").count().collect()}
    assert strata == {(0, 0): 60, (0, 1): 20, (1, 0): 15, (1, 1): 5}
    folds = split.stratified_k_fold(skewed, "idx", "label", 4, 2).groupBy("fold", "label").count().collect()
    assert {(r.label, r["count"]) for r in folds} == {(0, 20), (1, 5)}
    groups = spark.createDataFrame([(k, k // 2) for k in range(6)], "idx long, g long")
    leaks = split.group_k_fold(groups, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count()
    assert leaks == 0
    assert split.time_series_blocks(11, 3, 1) == [(0, 3, 4, 6), (1, 6, 7, 9), (2, 9, 10, 11)]
    for bad in (lambda: split.random_split(ten, "idx", [0.5], 1), lambda: split.k_fold(ten, "idx", 11, 1), lambda: split.group_k_fold(groups, "g", 4)):
        with pytest.raises(InvalidArgument):
            bad()


def test_samplers(spark, ten):
    assert sorted(sampling.golden_random(8, 42)) == list(range(8)) and sampling.golden_random(8, 42) == [0, 1, 6, 7, 2, 4, 3, 5]
    assert len(sampling.golden_weighted([1, 2, 3], 20, 7)) == 20 and sorted(sampling.golden_weighted([1, 2, 3], 3, 7, False)) == [0, 1, 2]
    assert sorted(sampling.shuffle_buffer(range(20), 5, 1)) == list(range(20))
    ranks = [values(sampling.distributed(ten, r, 3), "idx", "pos") for r in range(3)]
    assert ranks == [[0, 3, 6, 9], [1, 4, 7, 0], [2, 5, 8, 1]]
    drawn = sampling.weighted_with_replacement(ten, "x", 4500, 3).groupBy("idx").count().collect()
    assert sum(r["count"] for r in drawn) == 4500 and all(abs(r["count"] - 100 * r.idx) < 100 for r in drawn)
    assert sampling.batched(ten, 3, True, "idx").count() == 9
    lengths = spark.createDataFrame(list(enumerate([5, 1, 3, 2, 4])), "idx long, n long")
    assert sorted(r.n for r in sampling.bucketed(lengths, "n", 2, 1).collect()) == [1, 2, 3, 4, 5]


def test_collation(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, 2.0], 7), (1, 0, [3.0], 8), (2, 1, [4.0, 5.0], 9)], "pos long, batch_id long, x array<double>, y int")
    first = batch.pad(rows, "x", "y").orderBy("batch_id").first()
    assert (first.inputs, first.mask, first.labels) == ([[1, 2], [3, 0]], [[1, 1], [1, 0]], [7, 8])
    with pytest.raises(Exception, match="differ in length"):
        batch.stack(rows, "x").collect()
    assert [len(r.inputs) for r in batch.batches(batch.ragged(rows, "x"))] == [2, 1]
