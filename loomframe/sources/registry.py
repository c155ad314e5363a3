"""Sources by scheme."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.errors import InvalidArgument
from loomframe.sources import binary, jsondoc, tabular

Opener = Callable[..., DataFrame]
SCHEMES: dict[str, Opener] = {}


def register(scheme: str) -> Callable[[Opener], Opener]:
    """Decorator that adds a source ``f(spark, path, **options)``; a scheme can be added once."""

    def add(f: Opener) -> Opener:
        if scheme in SCHEMES:
            raise InvalidArgument(f"scheme {scheme!r} is registered already")
        SCHEMES[scheme] = f
        return f

    return add


def _json(spark: SparkSession, path: str, fields: list[dict] | None = None, **options: object) -> DataFrame:
    return jsondoc.read(spark, path, [jsondoc.Field(**f) for f in fields] if fields else None, **options)


def _sqlite(spark: SparkSession, path: str, query: str, label_index: int | None = None) -> DataFrame:
    return tabular.sqlite(spark, path, query, label_index)


for _scheme, _opener in (
    ("csv", tabular.csv), ("json", _json), ("jsonl", tabular.jsonl_arrays), ("npy", binary.npy), ("npz", binary.npz), ("text", tabular.text_lines), ("wav", binary.wav), ("audio", binary.audio),
    ("webdataset", binary.web_dataset), ("parquet", tabular.parquet), ("feather", binary.arrow_ipc), ("ipc", binary.arrow_ipc), ("hdf5", tabular.hdf5), ("sqlite", _sqlite), ("copy", binary.copy_binary),
    ("video", binary.video), ("images", binary.image_folder), ("cifar", binary.cifar),
):
    register(_scheme)(_opener)


def load_plugin(module: str) -> list[str]:
    """Import a module that registers sources (or transforms) of its own; the schemes that it added."""
    before = set(SCHEMES)
    importlib.import_module(module)
    return sorted(set(SCHEMES) - before)


def open_uri(spark: SparkSession, uri: str, options: dict | None = None) -> DataFrame:
    """The source that ``scheme:path`` or ``scheme://path`` names."""
    scheme, colon, path = uri.partition(":")
    if not colon or scheme not in SCHEMES:
        raise InvalidArgument(f"unknown scheme in {uri!r}")
    return SCHEMES[scheme](spark, path.removeprefix("//"), **(options or {}))
