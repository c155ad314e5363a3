"""Pipelines from a document: source, preprocessors, transforms, loader; as JSON or as a small subset of YAML."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument, LoomError
from loomframe.functions import files
from loomframe.functions.positions import hash_index
from loomframe.functions.rng import order_key
from loomframe.operators import batch, preprocess, sampling, transforms
from loomframe.sources.registry import open_uri


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text in ("null", "~", ""):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _flow(text: str) -> object:
    """A value in one line: {a: 1, b: [2, 3]}, a list or a scalar."""
    text = text.strip()
    if not text or text[0] not in "[{":
        return _scalar(text)
    parts, depth, quote, held = [], 0, "", ""
    for ch in text[1:-1]:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        depth += (ch in "[{") - (ch in "]}") if not quote else 0
        if ch == "," and not depth and not quote:
            parts.append(held)
            held = ""
        else:
            held += ch
    parts = [p for p in [*parts, held] if p.strip()]
    if text[0] == "[":
        return [_flow(p) for p in parts]
    return {str(_scalar(k)): _flow(v) for k, _, v in (p.partition(":") for p in parts)}


def parse_yaml(text: str) -> object:
    """Nested maps and lists by indentation, with scalars and flow values; comments are left out."""
    lines = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if line.strip() and line.strip() != "---":
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise InvalidArgument("yaml: tabs cannot indent")
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, indent: int) -> tuple[object, int]:
        if lines[at][1].startswith("- "):
            items: list[object] = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                body = lines[at][1][1:].strip()
                inner = indent + len(lines[at][1]) - len(body)
                if ":" in body and body[0] not in "[{\"'":
                    lines[at] = (inner, body)
                    value, at = block(at, inner)
                else:
                    value, at = _flow(body), at + 1
                items.append(value)
            return items, at
        found: dict[str, object] = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise InvalidArgument(f"yaml: no colon in {lines[at][1]!r}")
            if rest.strip():
                found[str(_scalar(key))], at = _flow(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("- ")):
                found[str(_scalar(key))], at = block(at + 1, lines[at + 1][0])
            else:
                found[str(_scalar(key))], at = None, at + 1
        if at < len(lines) and lines[at][0] > indent:
            raise InvalidArgument(f"yaml: bad indentation at {lines[at][1]!r}")
        return found, at

    return block(0, lines[0][0])[0] if lines else {}


def parse(text: str) -> dict:
    """A document of either kind, known by its first character."""
    try:
        found = json.loads(text) if text.lstrip().startswith("{") else parse_yaml(text)
    except ValueError as e:
        raise InvalidArgument(f"pipeline document: {e}") from e
    if not isinstance(found, dict):
        raise InvalidArgument("pipeline document: not a map")
    return found


@dataclass
class Loader:
    """Rows (idx, features f0, f1, ..., label) and how to batch them."""

    rows: DataFrame
    columns: list[str]
    batch_size: int = 1
    shuffle: bool = False
    drop_last: bool = False
    seed: int = 0
    fitted: list[preprocess.Transformer] = field(default_factory=list)

    def epoch(self, number: int = 0) -> DataFrame:
        """The batches (batch_id, size, inputs, labels) of an epoch; a shuffled order depends on seed and epoch alone."""
        rows = self.rows.withColumn("input", F.array(*self.columns)) if self.columns else self.rows
        ordered = hash_index(rows, order_key(self.seed + number, F.col("idx").cast("string")), "idx") if self.shuffle else rows.withColumn("pos", F.col("idx"))
        return batch.stack(sampling.batched(ordered, self.batch_size, self.drop_last), "input", "label")

    def __iter__(self) -> Iterator[Row]:
        return batch.batches(self.epoch())


def unpacked(df: DataFrame, column: str = "input") -> tuple[DataFrame, list[str]]:
    """An array column of one width as columns f0, f1, ..."""
    width = df.agg(F.max(F.size(column))).first()[0] or 0
    names = [f"f{k}" for k in range(width)]
    return df.select(*(c for c in df.columns if c != column), *(F.get(column, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names))), names


def build(spark: SparkSession, document: dict) -> Loader:
    """The pipeline of a document. Preprocessors are fitted on unrounded values one after the other, and applied with a rounding to
    float32 after each; an error names the step."""
    source = document.get("source") or {}
    if not source.get("type") or not source.get("path"):
        raise InvalidArgument("pipeline: source needs type and path")
    try:
        rows, columns = unpacked(open_uri(spark, f"{source['type']}:{source['path']}", source.get("options")))
    except (LoomError, TypeError) as e:
        raise InvalidArgument(f"pipeline source {source['type']!r}: {e}") from e
    exact, fitted = rows, []
    for step in document.get("preprocessors") or []:
        kind = step.get("type")
        if kind not in preprocess.KINDS:
            raise InvalidArgument(f"pipeline preprocessor {kind!r}: unknown")
        made = preprocess.KINDS[kind](columns, **(step.get("params") or {})).fit(exact)
        exact = made.transform(exact)
        rows = made.transform(rows).withColumns({c: F.col(c).cast("float").cast("double") for c in columns})
        fitted.append(made)
    for step in document.get("transforms") or []:
        try:
            rows = transforms.create(step.get("type"), columns, step.get("params"))(rows)
        except LoomError as e:
            raise InvalidArgument(f"pipeline transform {step.get('type')!r}: {e}") from e
    options = document.get("loader") or {}
    known = {k: options[k] for k in ("batch_size", "shuffle", "drop_last", "seed") if k in options}
    return Loader(rows, columns, **known, fitted=fitted)


def from_file(spark: SparkSession, path: str) -> Loader:
    return build(spark, parse(files.read(path).decode()))


def save_snapshot(path: str, fitted: list[preprocess.Transformer], steps: list[dict]) -> None:
    """Fitted preprocessors and named transforms, to be applied again without a fit."""
    files.write(path, json.dumps({"version": 1, "preprocessors": [t.saved() for t in fitted], "transforms": steps}).encode())


def load_snapshot(path: str, columns: list[str]) -> transforms.Step:
    """One step that applies a snapshot."""
    found = json.loads(files.read(path))
    if found.get("version") != 1:
        raise InvalidArgument(f"{path}: unknown version")
    made = [preprocess.loaded(t).transform for t in found["preprocessors"]]
    return transforms.compose(*made, *(transforms.create(s["type"], columns, s.get("params")) for s in found["transforms"]))
