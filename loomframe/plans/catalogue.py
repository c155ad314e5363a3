"""Registered queries of the library's operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.positions import dense_index
from loomframe.operators import algebra, batch, preprocess, sampling, split, stats, transforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Decorator that registers a query, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """The table, or its key and the columns named, with positions in the order of its unique key."""
    rows = table(spark, sf_dir, name)
    return dense_index(rows.select(*dict.fromkeys((key, *columns))) if columns else rows, key)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def rounded_double(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it: scaled, halves away from zero, and zero keeps its sign. Spark's own goes by decimal digits and
    has no negative zero."""
    y = x * F.lit(10.0**digits)
    r = F.rint(y)
    r = F.when((y > 0) & (y - r == 0.5), r + 1.0).when((y < 0) & (y - r == -0.5), r - 1.0).otherwise(r)
    return F.when(F.abs(y) == float("inf"), x).otherwise(r / F.lit(10.0**digits))


# --- projection, filters, algebra --------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.project(table(spark, sf_dir, "lineitem"), "l_orderkey, l_quantity, l_extendedprice")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount <> 0.05 AND l_tax < 0.07 AND l_linenumber <= 5 AND l_shipdate IS NOT NULL")
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = algebra.where_all(table(spark, sf_dir, "lineitem"), [("l_quantity", "ge", 10), ("l_discount", "ne", 0.05), ("l_tax", "lt", 0.07), ("l_linenumber", "le", 5)])
    return kept.where("l_shipdate is not null").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '2' AND o_orderstatus <> 'F'")
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.where_all(table(spark, sf_dir, "orders"), [("o_orderpriority", "ge", "2"), ("o_orderstatus", "ne", "F")]).select("o_orderkey", "o_orderpriority")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, round(2 * o_totalprice, 6) AS doubled FROM orders")
def map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return algebra.mapped(rows, lambda df: df.withColumn("doubled", F.round(2 * F.col("o_totalprice"), 6))).select("idx", "o_orderkey", "doubled")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def filter_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.filtered(at(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", renumber=True).select("idx", "o_orderkey")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_custkey FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderstatus AS label FROM orders) SELECT a.idx, o_custkey, label FROM a JOIN b USING (idx)")
def zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return algebra.zipped(rows.select("idx", "o_custkey"), rows.select("idx", F.col("o_orderstatus").alias("label")))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name AS name FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey) - 1, r_name FROM region")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [at(spark, sf_dir, t, k).select("idx", F.col(n).alias("name")) for t, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))]
    return algebra.concatenated(parts)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.take(at(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), 100).select("idx", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100)")
def skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.skip(at(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), 100).select("idx", "o_orderkey")


@query("SELECT c * (SELECT count(*) FROM nation) + row_number() OVER (PARTITION BY c ORDER BY n_nationkey) - 1 AS idx, n_name FROM nation, range(3) t(c)")
def repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.repeat(at(spark, sf_dir, "nation", "n_nationkey"), 3).select("idx", "n_name")


@query("WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM orders) SELECT t.p AS idx, o_orderkey FROM range(500) t(p) JOIN o ON o.i = (t.p * 7) % 1000")
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") * 7 % 1000).alias("idx"))
    return algebra.subset(at(spark, sf_dir, "orders", "o_orderkey", "o_orderkey").select("idx", "o_orderkey"), chosen)


# --- statistics --------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max, CAST(count(*) - count({c}) AS BIGINT) AS missing, count({c}) AS count FROM lineitem" for c in NUMBERS))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.column_stats(table(spark, sf_dir, "lineitem"), NUMBERS), "mean", "std")


@query("SELECT quality AS label, count(*) AS count FROM labels GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_counts(table(spark, sf_dir, "labels"), "quality")


@query("WITH m AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) n FROM lineitem, m GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 20), 4) AS low, round(lo + (b + 1) * ((hi - lo) / 20), 4) AS high, coalesce(n, 0) AS count FROM range(20) r(b) CROSS JOIN m LEFT JOIN c ON c.bin = b")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20), "low", "high", digits=4)


# --- fit and transform -------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)


def _fitted(each: str, fit: str = "", where: str = "lineitem") -> str:
    """SQL for a transformer: ``each`` is the expression for column {c}, with {k} its number, ``fit`` the fitted values."""
    columns = ", ".join(f"round({each.format(c=c, k=k)}, 6) AS {c}" for k, c in enumerate(NUMBERS))
    values = ", ".join(fit.format(c=c, k=k) for k, c in enumerate(NUMBERS))
    return f"SELECT l_orderkey, l_linenumber, {columns} FROM {where}" + (f" CROSS JOIN (SELECT {values} FROM {where}) f" if fit else "")


@query(_fitted("({c} - m{k}) / s{k}", "avg({c}) AS m{k}, stddev_pop({c}) AS s{k}"))
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.StandardScaler(NUMBERS).fit_transform(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("-1 + 2 * (({c} - m{k}) / (s{k} - m{k}))", "min({c}) AS m{k}, max({c}) AS s{k}"))
def minmax_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.MinMaxScaler(NUMBERS, low=-1.0, high=1.0).fit_transform(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("({c} - m{k}) / s{k}", "quantile_cont({c}, 0.5) AS m{k}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s{k}"))
def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.RobustScaler(NUMBERS).fit_transform(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("{c} / greatest(1, m{k})", "max(abs({c})) AS m{k}"))
def maxabs_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.MaxAbsScaler(NUMBERS).fit_transform(_lines(spark, sf_dir)), *NUMBERS)


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in which some values are missing, some of them NaN."""
    rows = _lines(spark, sf_dir)
    odd = F.col("l_linenumber") == 3
    return rows.withColumns({c: F.when(odd, F.lit(float("nan"))).when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col(c)) for c in NUMBERS})


_HOLES = "(SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_linenumber NOT IN (3, 4) THEN {c} END AS {c}" for c in NUMBERS) + " FROM lineitem) h"
for _name, _fit in (("mean", "avg({c}) AS m{k}"), ("median", "quantile_cont({c}, 0.5) AS m{k}"), ("constant", "max(-1.0) AS m{k}")):

    def _impute(spark: SparkSession, sf_dir: str, strategy: str = _name) -> DataFrame:
        return rounded(preprocess.Imputer(NUMBERS, strategy=strategy, fill=-1.0).fit_transform(_holes(spark, sf_dir)), *NUMBERS)

    query(_fitted("coalesce({c}, m{k})", _fit, _HOLES), f"imputer_{_name}")(_impute)


@query(f"WITH {', '.join(f'm{k} AS (SELECT {c} AS v FROM {_HOLES} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)' for k, c in enumerate(NUMBERS))} SELECT l_orderkey, l_linenumber, {', '.join(f'round(coalesce({c}, m{k}.v), 6) AS {c}' for k, c in enumerate(NUMBERS))} FROM {_HOLES}, m0, m1, m2, m3")
def imputer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.Imputer(NUMBERS, strategy="mode").fit_transform(_holes(spark, sf_dir)), *NUMBERS)


@query(_fitted("CASE WHEN {c} > 0.05 THEN 1.0 ELSE 0.0 END"))
def binarizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.Binarizer(NUMBERS, threshold=0.05).fit_transform(_lines(spark, sf_dir)), *NUMBERS)


_NORMS = {"l1": " + ".join(f"abs({c})" for c in NUMBERS), "l2": "sqrt(" + " + ".join(f"{c} * {c}" for c in NUMBERS) + ")", "max": "greatest(" + ", ".join(f"abs({c})" for c in NUMBERS) + ")"}
for _name, _norm in _NORMS.items():

    def _normalize(spark: SparkSession, sf_dir: str, norm: str = _name) -> DataFrame:
        return rounded(preprocess.Normalizer(NUMBERS, norm=norm).fit_transform(_lines(spark, sf_dir)), *NUMBERS)

    query(_fitted("{c} / (CASE WHEN (" + _norm + ") = 0 THEN 1 ELSE " + _norm + " END)"), f"normalizer_{_name}")(_normalize)


@query("SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 5)) AS embedding FROM embeddings")
def normalizer_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.transform(preprocess.normalized("embedding"), lambda x: rounded_double(x, 5)).alias("embedding"))


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag FROM lineitem")
def label_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.LabelEncoder(["l_returnflag"]).fit_transform(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus FROM orders")
def ordinal_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.OrdinalEncoder(["o_orderpriority", "o_orderstatus"]).fit_transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query("WITH c AS (SELECT list(DISTINCT l_returnflag ORDER BY l_returnflag) a FROM lineitem), d AS (SELECT list(DISTINCT l_linestatus ORDER BY l_linestatus) b FROM lineitem) SELECT l_orderkey, l_linenumber, list_transform(a, lambda v: CAST(v = l_returnflag AS DOUBLE)) || list_transform(b, lambda v: CAST(v = l_linestatus AS DOUBLE)) AS onehot FROM lineitem, c, d")
def onehot_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.OneHotEncoder(["l_returnflag", "l_linestatus"]).fit_transform(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "onehot")


# --- element-wise transforms -------------------------------------------------------------------------------------


@query(_fitted("greatest(0.02, least({c}, 30.0))"))
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.clip(NUMBERS, 0.02, 30.0)(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("ln(1 + {c})"))
def log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.log1p(NUMBERS)(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("({c} - 1.5) / 2.5"))
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.standardize(NUMBERS, [1.5] * 4, [2.5] * 4)(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("({c} - 0.5) / 49.5"))
def minmax_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.minmax(NUMBERS, [0.5] * 4, [50.0] * 4)(_lines(spark, sf_dir)), *NUMBERS)


@query(_fitted("(({c} + 2) * 3 - 1) / 4"))
def scalar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [transforms.scalar(NUMBERS, op, a) for op, a in (("add", 2), ("mul", 3), ("sub", 1), ("div", 4))]
    return rounded(transforms.compose(*steps)(_lines(spark, sf_dir)), *NUMBERS)


_FUSED = "{c}"
for _step in ("greatest(0.0, least({}, 40000.0))", "ln(1 + {})", "({} - 2.0) / 3.0", "({} - 0.5) / 4.0"):  # each result is stored as float32
    _FUSED = f"CAST(CAST({_step.replace('{}', _FUSED)} AS FLOAT) AS DOUBLE)"


@query(_fitted(_FUSED).replace(", 6) AS", ", 4) AS"))
def compose_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [transforms.clip(NUMBERS, 0, 40000, "float32"), transforms.log1p(NUMBERS, "float32"), transforms.standardize(NUMBERS, [2.0] * 4, [3.0] * 4, "float32"), transforms.minmax(NUMBERS, [0.5] * 4, [4.5] * 4, "float32")]
    return rounded(transforms.compose(*steps)(_lines(spark, sf_dir)), *NUMBERS, digits=4)


_UNIT = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(f"SELECT o_orderkey, round(CASE WHEN {_UNIT.format(seed=3, key='o_orderkey')} < 0.3 THEN o_totalprice * 2 ELSE o_totalprice END, 6) AS o_totalprice FROM orders")
def random_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = transforms.random_apply(transforms.scalar(["o_totalprice"], "mul", 2), 0.3, 3, "o_orderkey")
    return rounded(step(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")), "o_totalprice")


@query(f"SELECT o_orderkey, round(CASE CAST(floor({_UNIT.format(seed=4, key='o_orderkey')} * 2) AS INTEGER) WHEN 0 THEN o_totalprice + 1 ELSE o_totalprice - 1 END, 6) AS o_totalprice FROM orders")
def one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = transforms.one_of([transforms.scalar(["o_totalprice"], "add", 1), transforms.scalar(["o_totalprice"], "sub", 1)], 4, "o_orderkey")
    return rounded(step(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")), "o_totalprice")


# --- orders and splits -------------------------------------------------------------------------------------------


def _random(seed: int, key: str, by: str = "") -> str:
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY md5('{seed}:' || {key}), {key}) - 1"


@query(f"SELECT o_orderkey, {_random(7, 'o_orderkey')} AS pos FROM orders")
def shuffle_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


_CUT = "CAST(floor({f} * (SELECT count(*) FROM orders) + 0.5) AS BIGINT)"


@query(f"SELECT o_orderkey, CAST(CASE WHEN {_random(11, 'o_orderkey')} < {_CUT.format(f=0.5)} THEN 0 WHEN {_random(11, 'o_orderkey')} < {_CUT.format(f=0.5)} + {_CUT.format(f=0.3)} THEN 1 ELSE 2 END AS INTEGER) AS part FROM orders")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [0.5, 0.3, 0.2], 11)


@query(f"SELECT o_orderkey, CASE WHEN {_random(5, 'o_orderkey')} < {_CUT.format(f=0.8)} THEN 'train' WHEN {_random(5, 'o_orderkey')} < {_CUT.format(f=0.8)} + {_CUT.format(f=0.1)} THEN 'val' ELSE 'test' END AS part FROM orders")
def train_val_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.train_val_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8, 0.1, 0.1, 5)


@query(f"SELECT doc_id, quality, CAST({_random(9, 'doc_id', 'quality')} >= greatest(1, least(floor(0.75 * n + 0.5), n - 1)) AS INTEGER) AS part FROM labels JOIN (SELECT quality AS q, count(*) n FROM labels GROUP BY 1) ON q = quality")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.75, 9)


@query(f"SELECT o_orderkey, CAST(({_random(2, 'o_orderkey')}) % 5 AS INTEGER) AS fold FROM orders")
def k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.k_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5, 2)


@query(f"SELECT doc_id, toxic, CAST(({_random(2, 'doc_id', 'toxic')}) % 4 AS INTEGER) AS fold FROM labels")
def stratified_k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_k_fold(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 4, 2)


@query("SELECT event_id, user_id, CAST((dense_rank() OVER (ORDER BY user_id) - 1) % 3 AS INTEGER) AS fold FROM events")
def group_k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_k_fold(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 3)


@query("WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx, count(*) OVER () AS n FROM events), b AS (SELECT f, n, (f + 1) * (n // 5) + least(f + 1, n % 5) AS te, (f + 2) * (n // 5) + least(f + 2, n % 5) AS ee FROM range(4) r(f), (SELECT count(*) n FROM events)) SELECT event_id, idx, CAST(f AS INTEGER) AS fold, CASE WHEN idx < te THEN 'train' ELSE 'test' END AS part FROM e JOIN b ON idx < te OR (idx >= te + 10 AND idx < ee)")
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.time_series_split(at(spark, sf_dir, "events", "event_id").select("event_id", "idx"), 4, 10)


_BUCKETED = "WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY n_chars, idx) - 1 AS rk FROM d), w AS (SELECT *, rk // 64 AS wi FROM r), p AS (SELECT *, wi * 64 + row_number() OVER (PARTITION BY wi ORDER BY md5('13:' || idx), idx) - 1 AS pos FROM w)"


@query(_BUCKETED + " SELECT doc_id, idx, pos, pos // 16 AS batch_id FROM p")
def bucket_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = at(spark, sf_dir, "documents", "doc_id").select("doc_id", "idx", "n_chars")
    return sampling.bucketed(rows, "n_chars", 16, 13).select("doc_id", "idx", "pos", "batch_id")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('8:' || o_orderkey), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) SELECT o_orderkey, p + k * n AS pos FROM o, range(2) r(k) WHERE p + k * n < n + (7 - n % 7) % 7 AND (p + k * n) % 7 = 3")
def distributed_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.distributed(table(spark, sf_dir, "orders").select("o_orderkey"), 3, 7, "o_orderkey", seed=8)


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY ln({_UNIT.format(seed=6, key='o_orderkey')} + 1.1102230246251565e-16) / o_totalprice DESC, o_orderkey LIMIT 200")
def weighted_sampler_noreplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_without_replacement(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 200, 6)


@query()
def weighted_sampler_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_with_replacement(at(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", 1000, 6)


@query("SELECT o_orderkey, idx // 32 AS batch_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders) WHERE idx // 32 < n // 32")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batched(at(spark, sf_dir, "orders", "o_orderkey", "o_orderkey").select("o_orderkey", "idx"), 32, True, "idx").select("o_orderkey", F.col("batch_id").cast("long").alias("batch_id"))


# --- collation ---------------------------------------------------------------------------------------------------

_VECTORS = "(SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batched(at(spark, sf_dir, "embeddings", "vec_id").withColumnRenamed("idx", "pos"), 32)


@query(f"SELECT pos // 32 AS batch_id, count(*) AS size, list(embedding ORDER BY pos) AS inputs, list(label ORDER BY pos) AS labels FROM {_VECTORS} GROUP BY 1")
def collate_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.stack(_vectors(spark, sf_dir), "embedding", "label")


_WORDS = "(SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS DOUBLE)) AS x, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_index(table(spark, sf_dir, "conversations"), "conv_id", "turn", name="pos")
    lengths = F.transform(F.split("text", " "), lambda w: F.char_length(w).cast("double"))
    return sampling.batched(rows.select("conv_id", "turn", "role", "pos", lengths.alias("x")), 16)


@query(f"SELECT pos // 16 AS batch_id, count(*) AS size, list(list_resize(x, m, 0.0) ORDER BY pos) AS inputs, list(list_resize(list_transform(x, lambda v: 1), m, 0) ORDER BY pos) AS mask, list(turn ORDER BY pos) AS labels FROM (SELECT *, max(len(x)) OVER (PARTITION BY pos // 16) AS m FROM {_WORDS}) GROUP BY 1")
def collate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pad(_turns(spark, sf_dir), "x", "turn")


@query(f"SELECT pos // 16 AS batch_id, count(*) AS size, list(x ORDER BY pos) AS inputs FROM {_WORDS} GROUP BY 1")
def collate_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.ragged(_turns(spark, sf_dir), "x")


@query(f"SELECT pos // 16 AS batch_id, list(role ORDER BY pos) AS role FROM (SELECT role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations) GROUP BY 1")
def collate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.metadata(_turns(spark, sf_dir), ["role"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale the lines: a scan, one aggregation, one projection."""
    return QUERIES["standard_scaler"](spark, sf_dir)

