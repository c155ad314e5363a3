"""Element types of tensors and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidArgument

#: Name: (bytes, Spark type). Unsigned types are held one step wider; half floats are read as float32.
DTYPES: dict[str, tuple[int, T.DataType]] = {
    "bool": (1, T.BooleanType()), "int8": (1, T.ByteType()), "int16": (2, T.ShortType()), "int32": (4, T.IntegerType()), "int64": (8, T.LongType()),
    "uint8": (1, T.ShortType()), "uint16": (2, T.IntegerType()), "uint32": (4, T.LongType()), "uint64": (8, T.DecimalType(20, 0)),
    "float16": (2, T.FloatType()), "bfloat16": (2, T.FloatType()), "float32": (4, T.FloatType()), "float64": (8, T.DoubleType()),
}
#: A tensor of any rank: its shape and its values in row order.
TENSOR = T.StructType([T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType()))])
_BITS = {"int8": 8, "int16": 16, "int32": 32, "uint8": 8, "uint16": 16, "uint32": 32}


def spark_type(dtype: str) -> T.DataType:
    """The Spark type of an element type."""
    if dtype not in DTYPES:
        raise InvalidArgument(f"unknown dtype {dtype!r}")
    return DTYPES[dtype][1]


def numel(shape: list[int]) -> int:
    """Number of elements; an empty shape has none, a scalar is [1]."""
    out = 1 if shape else 0
    for n in shape:
        out *= n
    return out


def converted(value: Column, dtype: str) -> Column:
    """``value`` as another element type, by way of a double: fractions are cut, integers wrap, bool is "not zero"."""
    x = value.cast("double")
    if dtype == "bool":
        return F.when(F.isnan(x), True).otherwise(x != 0)
    if dtype in ("float64", "float32", "float16", "bfloat16"):
        return x.cast(spark_type(dtype))
    if dtype == "uint64":
        cut = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(20,0)")
        return F.when(F.isnan(x), None).when(cut < 0, (cut + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(cut)
    whole = F.when(F.isnan(x), 0).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    if dtype == "int64":
        return whole.cast("long")
    bits = _BITS[dtype]
    wrapped = F.pmod(whole.cast("long"), F.lit(1 << bits))
    if not dtype.startswith("u"):
        wrapped = F.when(wrapped >= 1 << (bits - 1), wrapped - (1 << bits)).otherwise(wrapped)
    return wrapped.cast(spark_type(dtype))
