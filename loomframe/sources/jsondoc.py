"""JSON documents: lines or an array, fields by path, roles, categories and defaults.

Records are parsed once to VARIANT and each field is an expression on it: keys and indices by ``variant_get``, ``[*]`` by a transform
over an array of variants. Nothing runs in Python.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument, SourceError
from loomframe.functions.positions import dense_index, scan_index

ROLES = ("input", "label", "extra", "metadata")
_STEP = re.compile(r"([^.\[\]]+)|\[(\d+|\*)\]")


@dataclass
class Field:
    """``path``: dotted keys with [i] and [*]; ``rank``: nesting of arrays in the value at the path; ``categories``: texts that stand for 0, 1, 2, ..."""

    name: str
    role: str = "input"
    path: str = ""
    dtype: str = "double"
    rank: int = 0
    categories: list[str] = field(default_factory=list)
    default: float | None = None

    def __post_init__(self) -> None:
        self.path = self.path or self.name
        if self.role not in ROLES:
            raise InvalidArgument(f"unknown role {self.role!r}")


def steps(path: str) -> list[str | int]:
    """Keys, indices and "*" of a path."""
    out: list[str | int] = []
    at = 0
    for m in _STEP.finditer(path):
        if path[at : m.start()].strip("."):
            raise InvalidArgument(f"bad path {path!r}")
        out.append(m[1] if m[1] is not None else "*" if m[2] == "*" else int(m[2]))
        at = m.end()
    if at < len(path) or not out:
        raise InvalidArgument(f"bad path {path!r}")
    return out


def _dollar(parts: list[str | int]) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in parts)


def extract(value: Column, parts: list[str | int], kind: str) -> Column:
    """The value at a path as ``kind``; null where it is missing or of another type. Each [*] adds a leading dimension."""
    if "*" not in parts:
        return F.try_variant_get(value, _dollar(parts), kind) if parts else value.try_cast(kind)
    k = parts.index("*")
    items = F.try_variant_get(value, _dollar(parts[:k]), "array<variant>")
    return F.transform(items, lambda x: extract(x, parts[k + 1 :], kind) if parts[k + 1 :] else F.try_variant_get(x, "$", kind))


def _column(value: Column, f: Field) -> tuple[Column, Column]:
    """The field's value and whether the record lacks it."""
    parts = steps(f.path)
    if f.role == "metadata":
        text = F.try_variant_get(value, _dollar(parts), "string")
        return F.coalesce(text, F.lit("")), F.lit(False)
    if f.categories:
        text = F.try_variant_get(value, _dollar(parts), "string")
        place = F.array_position(F.array(*map(F.lit, f.categories)), text)
        return (place - 1).cast(f.dtype), F.coalesce(place, F.lit(0)) == 0
    kind = "array<" * f.rank + f.dtype + ">" * f.rank
    found = extract(value, parts, kind)
    if f.rank or "*" in parts:
        return found, found.isNull()
    truth = F.try_variant_get(value, _dollar(parts), "boolean")
    found = F.coalesce(found, truth.cast("int").cast(f.dtype))
    is_null = F.schema_of_variant(F.try_variant_get(value, _dollar(parts), "variant")) == "VOID"
    if f.dtype in ("float", "double"):
        found = F.coalesce(found, F.when(is_null, F.lit(float("nan")).cast(f.dtype)))
    if f.default is not None:
        found = F.coalesce(found, F.lit(f.default).cast(f.dtype))
    return found, found.isNull()


def fields_from_schema(schema: dict) -> list[Field]:
    """Fields of a JSON Schema; ``x-role`` and ``x-dtype`` say what it does not, enums of texts are categories."""
    out: list[Field] = []

    def walk(node: dict, path: str) -> None:
        kind = node.get("type")
        if kind == "object":
            for name, sub in node.get("properties", {}).items():
                walk(sub, f"{path}.{name}" if path else name)
            return
        rank = 0
        while node.get("type") == "array":
            node, rank = node.get("items", {}), rank + 1
        enum = [x for x in node.get("enum", ()) if isinstance(x, str)]
        text = node.get("type") == "string" and not enum
        out.append(Field(path, node.get("x-role", "metadata" if text else "input"), path, node.get("x-dtype", "bigint" if enum or node.get("type") == "integer" else "double"), rank, enum, node.get("default")))

    walk(schema, "")
    return out


def inferred(record: dict) -> list[Field]:
    """Fields of a first record: numbers and rectangular arrays are inputs, texts metadata, all others left out."""
    out: list[Field] = []

    def walk(value: object, path: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, str):
            out.append(Field(path, "metadata"))
        elif isinstance(value, bool | int | float):
            out.append(Field(path, "input"))
        elif isinstance(value, list):
            rank, inner = 0, value
            while isinstance(inner, list) and inner:
                inner, rank = inner[0], rank + 1
            if isinstance(inner, int | float):
                out.append(Field(path, "input", rank=rank))

    walk(record, "")
    return out


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the file is one array document: it begins with a bracket and nothing follows the array."""
    head = next((r.value.strip() for r in spark.read.text(path).where("length(trim(value)) > 0").take(1)), "")
    if not head.startswith("["):
        return False
    try:
        json.loads(head)
    except ValueError:
        return True  # the array goes on in the next line
    return spark.read.text(path).where("length(trim(value)) > 0").limit(2).count() == 1


def read(spark: SparkSession, path: str, fields: list[Field] | None = None, records_path: str | None = None, skip_invalid: bool = False) -> DataFrame:
    """(idx, each field by its name with dots as underscores, and input of all scalar inputs joined) of JSON records.

    A record that cannot be parsed or lacks a required field is an error that names its number, or is left out with ``skip_invalid``.
    """
    if records_path or is_array(spark, path):
        whole = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("_file"))
        doc = F.try_parse_json("value")
        items = F.try_variant_get(doc, _dollar(steps(records_path)) if records_path else "$", "array<variant>")
        rows = whole.select("_file", F.posexplode(items).alias("_pos", "v"))
        rows = dense_index(rows.select("_file", "_pos", F.to_json("v").alias("value")), "_file", "_pos").select("idx", "value")
    else:
        rows = scan_index(spark.read.text(path).where("length(trim(value)) > 0"))
    if fields is None:
        first = rows.orderBy("idx").limit(1).collect()
        if not first:
            raise SourceError(f"{path}: no records")
        fields = inferred(json.loads(first[0].value))
    rows = rows.withColumn("v", F.try_parse_json("value"))
    made = {f.name.replace(".", "_"): _column(F.col("v"), f) for f in fields}
    bad = F.col("v").isNull()
    for _, lacks in made.values():
        bad = bad | lacks
    rows = rows.withColumn("_bad", bad)
    if skip_invalid:
        rows = rows.where("not _bad")
    elif wrong := rows.where("_bad").orderBy("idx").limit(1).collect():
        raise SourceError(f"{path}: record {wrong[0].idx} is not valid")
    out = rows.select("idx", *(value.alias(name) for name, (value, _) in made.items()))
    scalars = [f.name.replace(".", "_") for f in fields if f.role == "input" and not f.rank and "*" not in f.path]
    return out.withColumn("input", F.array(*(F.col(c).cast("double") for c in scalars))) if len(scalars) > 1 else out


def stream_lines(spark: SparkSession, folder: str, fields: list[Field]) -> DataFrame:
    """The same fields of JSON lines in files that arrive in a folder, as a streaming DataFrame; invalid records are left out."""
    rows = spark.readStream.text(folder).where("length(trim(value)) > 0").withColumn("v", F.try_parse_json("value"))
    made = {f.name.replace(".", "_"): _column(F.col("v"), f) for f in fields}
    bad = F.col("v").isNull()
    for _, lacks in made.values():
        bad = bad | lacks
    return rows.where(~bad).select(*(value.alias(name) for name, (value, _) in made.items()))
