"""Fit-and-transform preprocessing over numeric columns. A fit is one aggregation; a transform is column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidArgument, ShapeMismatch
from loomframe.functions import files, numeric
from loomframe.functions.numeric import present
from loomframe.operators import stats

KINDS: dict[str, type[Transformer]] = {}


@dataclass
class Transformer:
    """``columns`` are replaced by float64 columns of the same names, unless a transformer says otherwise."""

    columns: list[str]
    fitted: dict[str, list] = field(default_factory=dict)
    kind: ClassVar[str] = ""

    def __init_subclass__(cls) -> None:
        KINDS[cls.kind or cls.__name__] = cls

    def fit(self, df: DataFrame) -> Transformer:
        self._check(df)
        self.fitted = self._fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        if not self.fitted:
            raise InvalidArgument(f"{type(self).__name__} is not fitted")
        return self._transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _check(self, df: DataFrame) -> None:
        if missing := [c for c in self.columns if c not in df.columns]:
            raise ShapeMismatch(f"{type(self).__name__} needs column {missing[0]!r}")

    def _fit(self, df: DataFrame) -> dict[str, list]:
        return {"fitted": [True]}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._one(F.col(c).cast("double"), k) for k, c in enumerate(self.columns)})

    def _one(self, x: Column, k: int) -> Column:
        raise NotImplementedError

    def saved(self) -> str:
        """The transformer as text that ``loaded`` reads."""
        return json.dumps({"kind": self.kind or type(self).__name__} | asdict(self))

    def save(self, path: str) -> None:
        files.write(path, self.saved().encode())


def loaded(text: str) -> Transformer:
    """The transformer that ``saved`` wrote."""
    found = json.loads(text)
    kind = found.pop("kind", None)
    if kind not in KINDS:
        raise InvalidArgument(f"unknown transformer {kind!r}")
    return KINDS[kind](**found)


def load(path: str) -> Transformer:
    return loaded(files.read(path).decode())


def _agg(df: DataFrame, columns: list[str], **functions) -> dict[str, list]:
    row = df.agg(*(f(present(c)).alias(f"{n}{k}") for n, f in functions.items() for k, c in enumerate(columns))).first()
    return {n: [row[f"{n}{k}"] for k in range(len(columns))] for n in functions}


@dataclass
class StandardScaler(Transformer):
    with_mean: bool = True
    with_std: bool = True
    kind = "standard_scaler"

    def _fit(self, df: DataFrame) -> dict[str, list]:
        f = _agg(df, self.columns, mean=F.avg, scale=F.stddev_pop)
        return {"mean": [m or 0.0 for m in f["mean"]], "scale": [s or 1.0 for s in f["scale"]]}

    def _one(self, x: Column, k: int) -> Column:
        return numeric.standardize(x, self.fitted["mean"][k] if self.with_mean else 0.0, self.fitted["scale"][k] if self.with_std else 1.0)


@dataclass
class MinMaxScaler(Transformer):
    low: float = 0.0
    high: float = 1.0
    kind = "minmax_scaler"

    def __post_init__(self) -> None:
        if self.low >= self.high:
            raise InvalidArgument("minmax: low must be below high")

    def _fit(self, df: DataFrame) -> dict[str, list]:
        f = _agg(df, self.columns, min=F.min, max=F.max)
        return {"min": [0.0 if m is None else m for m in f["min"]], "max": [1.0 if m is None else m for m in f["max"]]}

    def _one(self, x: Column, k: int) -> Column:
        return numeric.minmax(x, self.fitted["min"][k], self.fitted["max"][k], (float(self.low), float(self.high)))


@dataclass
class RobustScaler(Transformer):
    kind = "robust_scaler"

    def _fit(self, df: DataFrame) -> dict[str, list]:
        q = stats.quantiles(df, self.columns, [0.25, 0.5, 0.75])
        found = [q[c] if q[c][0] is not None else [0.0, 0.0, 1.0] for c in self.columns]
        return {"median": [m for _, m, _ in found], "iqr": [(b - a) or 1.0 for a, _, b in found]}

    def _one(self, x: Column, k: int) -> Column:
        return numeric.standardize(x, self.fitted["median"][k], self.fitted["iqr"][k])


@dataclass
class MaxAbsScaler(Transformer):
    """Divides by the largest magnitude, but never by less than 1."""

    kind = "maxabs_scaler"

    def _fit(self, df: DataFrame) -> dict[str, list]:
        return {"scale": [max(1.0, m or 0.0) for m in _agg(df, self.columns, m=lambda x: F.max(F.abs(x)))["m"]]}

    def _one(self, x: Column, k: int) -> Column:
        return x / F.lit(self.fitted["scale"][k])


@dataclass
class Imputer(Transformer):
    """NaN and null become the column's mean, median, mode or a constant."""

    strategy: str = "mean"
    fill: float = 0.0
    kind = "imputer"

    def _fit(self, df: DataFrame) -> dict[str, list]:
        if self.strategy == "mean":
            found = _agg(df, self.columns, m=F.avg)["m"]
        elif self.strategy == "median":
            found = [v[0] for v in stats.quantiles(df, self.columns, [0.5]).values()]
        elif self.strategy == "mode":
            found = list(stats.modes(df, self.columns).values())
        elif self.strategy == "constant":
            found = [self.fill] * len(self.columns)
        else:
            raise InvalidArgument(f"unknown strategy {self.strategy!r}")
        return {"value": [float(self.fill) if v is None else float(v) for v in found]}

    def _one(self, x: Column, k: int) -> Column:
        return F.coalesce(present(x), F.lit(self.fitted["value"][k]))


@dataclass
class Binarizer(Transformer):
    threshold: float = 0.0
    kind = "binarizer"

    def _one(self, x: Column, k: int) -> Column:
        return numeric.binarize(x, self.threshold)


@dataclass
class Normalizer(Transformer):
    """Rows divided by their norm over the columns: l1, l2 or max; a norm of 0 counts as 1."""

    norm: str = "l2"
    kind = "normalizer"

    def _transform(self, df: DataFrame) -> DataFrame:
        sizes = [F.abs(F.col(c).cast("double")) for c in self.columns]
        if self.norm == "l1":
            norm = sum(sizes[1:], sizes[0])
        elif self.norm == "l2":
            norm = F.sqrt(sum((s * s for s in sizes[1:]), sizes[0] * sizes[0]))
        elif self.norm == "max":
            norm = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        else:
            raise InvalidArgument(f"unknown norm {self.norm!r}")
        held = df.withColumn("_norm", F.when(norm == 0, 1.0).otherwise(norm))
        return held.withColumns({c: F.col(c).cast("double") / F.col("_norm") for c in self.columns}).drop("_norm")


def normalized(vector: str | Column, norm: str = "l2") -> Column:
    """An array column divided by the norm of its values that are not null; null stays null."""
    v = F.transform(numeric.col(vector), lambda x: x.cast("double"))
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))
    size = {"l1": lambda: add(F.abs), "l2": lambda: F.sqrt(add(lambda x: x * x)), "max": lambda: F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))}
    if norm not in size:
        raise InvalidArgument(f"unknown norm {norm!r}")
    n = size[norm]()
    return F.transform(F.zip_with(v, F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(v)), lambda x, s: x / s), lambda x: x)


@dataclass
class _Coded(Transformer):
    """Categories are the sorted distinct present values of each column, at most MAX_CATEGORIES."""

    MAX_CATEGORIES: ClassVar[int] = 100_000
    kind = "_coded"

    def _fit(self, df: DataFrame) -> dict[str, list]:
        out = []
        for c in self.columns:
            rows = df.select(F.col(c).alias("v")).where("v is not null").distinct().limit(self.MAX_CATEGORIES + 1).collect()
            if len(rows) > self.MAX_CATEGORIES:
                raise InvalidArgument(f"{c!r} has more than {self.MAX_CATEGORIES} categories")
            out.append(sorted(r.v for r in rows))
        return {"categories": out}

    #: Up to so many categories are literals of an expression; more are a table that is broadcast, of MAX_CATEGORIES rows at most.
    LITERALS: ClassVar[int] = 64

    def _coded(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_code0``, ``_code1``, ...: 0-based places of the values; a value that the fit has not seen is an error."""
        for k, (c, values) in enumerate(zip(self.columns, self.fitted["categories"], strict=True)):
            if len(values) <= self.LITERALS:
                df = df.withColumn(f"_code{k}", F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1 if values else F.lit(None).cast("long"))
            else:
                table = df.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField(f"_code{k}", T.LongType()), T.StructField(f"_value{k}", df.schema[c].dataType)]))
                df = df.join(F.broadcast(table), F.col(c) == F.col(f"_value{k}"), "left").drop(f"_value{k}")
            told = F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
            df = df.withColumn(f"_code{k}", F.when(F.coalesce(f"_code{k}", F.lit(-1)) >= 0, F.col(f"_code{k}")).otherwise(told))
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._replaced(self._coded(df)).drop(*(f"_code{k}" for k in range(len(self.columns))))

    def _replaced(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class LabelEncoder(_Coded):
    """One column to codes of int64."""

    kind = "label_encoder"

    def _replaced(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(f"_code{k}").cast("long") for k, c in enumerate(self.columns)})


@dataclass
class OrdinalEncoder(_Coded):
    """Columns to codes of float64."""

    kind = "ordinal_encoder"

    def _replaced(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(f"_code{k}").cast("double") for k, c in enumerate(self.columns)})


@dataclass
class OneHotEncoder(_Coded):
    """All columns to one array ``output`` of indicator blocks in their order."""

    output: str = "onehot"
    kind = "onehot_encoder"

    def _replaced(self, df: DataFrame) -> DataFrame:
        block = lambda n, k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(f"_code{k}")).cast("double"))
        return df.withColumn(self.output, F.concat(*(block(len(v), k) for k, v in enumerate(self.fitted["categories"]))))
