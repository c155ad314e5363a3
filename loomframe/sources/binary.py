"""Binary formats. Files are read by Spark's binaryFile source, so any store that Spark reads will do, and decoded where they are.

A file is decoded by one task; sources of many records are meant to be split into many files.
"""

from __future__ import annotations

import io
import itertools
import struct
import tarfile
import wave
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from loomframe.errors import InvalidArgument, SourceError
from loomframe.functions import files
from loomframe.functions.positions import dense_index
from loomframe.operators import image
from loomframe.sources import compression

NPY_TYPES = {"f4", "f8", "i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8", "b1"}
CHUNK = 1024


def decoded(spark: SparkSession, path: str, decode: Callable[[str, bytes], Iterator[tuple]], schema: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Rows that ``decode(path, bytes)`` yields for each file, with ``idx`` in the order of file names and rows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    types = to_arrow_schema(StructType.fromDDL(f"_file string, _at long, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                found = enumerate(decode(name, compression.opened(content, name)))
                while held := [(name, at, *row) for at, row in itertools.islice(found, CHUNK)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), types, strict=True)], schema=types)

    rows = files.mapInArrow(run, f"_file string, _at long, {schema}")
    return dense_index(rows, "_file", "_at").drop("_file", "_at")


def load_npy(data: bytes) -> np.ndarray:
    """An array of the known types in row order."""
    try:
        found = np.load(io.BytesIO(data), allow_pickle=False)
    except (ValueError, OSError, EOFError) as e:
        raise SourceError(f"npy: {e}") from e
    if found.dtype.str[1:] not in NPY_TYPES:
        raise SourceError(f"npy: type {found.dtype}")
    if found.ndim > 1 and found.flags.f_contiguous and not found.flags.c_contiguous:
        raise SourceError("npy: column order is not supported")
    return found.astype(found.dtype.newbyteorder("="))


def npy(spark: SparkSession, features: str, labels: str | None = None) -> DataFrame:
    """(idx, input, label) of a [N, F] array and, if given, a [N] array; without labels every label is 0."""

    def rows(_: str, data: bytes) -> Iterator[tuple]:
        found = load_npy(data)
        for row in found.reshape(len(found), -1):
            yield (row.astype(float).tolist(),)

    out = decoded(spark, features, rows, "input array<double>")
    if labels is None:
        return out.withColumn("label", F.lit(0.0))
    told = decoded(spark, labels, lambda _, data: ((float(x),) for x in load_npy(data).reshape(-1)), "label double")
    if out.count() != told.count():
        raise InvalidArgument("npy: features and labels differ in length")
    return out.join(told, "idx")


def npz(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, shape, data) of the arrays in zip files, stored or deflated."""

    def rows(_: str, data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                found = load_npy(z.read(name))
                yield name.removesuffix(".npy"), list(found.shape), found.reshape(-1).astype(float).tolist()

    return decoded(spark, path, rows, "name string, shape array<int>, data array<double>")


def _ipc_schema(spark: SparkSession, path: str) -> str:
    """The DDL of the first file's columns; only its schema comes to the driver."""
    first = spark.read.format("binaryFile").load(path).select("path", "content").limit(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with pa.ipc.open_file(pa.BufferReader(compression.opened(content, name))) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([f.schema.serialize().to_pybytes()])], ["schema"])

    found = first.mapInArrow(run, "schema binary").collect()
    if not found:
        raise SourceError(f"{path}: no file")
    return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(found[0].schema)))).toDDL()


def arrow_ipc(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of Arrow IPC files or Feather files; ``schema`` is the DDL of the columns to read, by default those of the first file. Null
    floats become NaN."""
    schema = schema or _ipc_schema(spark, path)
    if columns:
        schema = StructType([StructType.fromDDL(schema)[c] for c in columns]).toDDL()
    names = columns or StructType.fromDDL(schema).names

    def rows(_: str, data: bytes) -> Iterator[tuple]:
        try:
            with pa.ipc.open_file(pa.BufferReader(data)) as f:
                batches = [f.get_batch(k) for k in range(f.num_record_batches)]
        except pa.ArrowInvalid as e:
            raise SourceError(f"ipc: {e}") from e
        for batch in batches:
            made = [[float("nan") if v is None and pa.types.is_floating(batch.schema.field(n).type) else v for v in batch.column(batch.schema.names.index(n)).to_pylist()] for n in names]
            yield from zip(*made, strict=True)

    return decoded(spark, path, rows, schema)


def mnist(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """(idx, shape, input, label) of IDX files; input is the bytes of an image of [28, 28, 1] or as the file says."""

    def image_rows(path: str, data: bytes) -> Iterator[tuple]:
        magic, n, h, w = struct.unpack(">IIII", data[:16].ljust(16, b"\0"))
        if magic != 2051 or len(data) < 16 + n * h * w:
            raise SourceError(f"{path}: bad magic or cut off")
        for k in range(n):
            yield [h, w, 1], data[16 + k * h * w : 16 + (k + 1) * h * w]

    def label_rows(path: str, data: bytes) -> Iterator[tuple]:
        magic, n = struct.unpack(">II", data[:8].ljust(8, b"\0"))
        if magic != 2049 or len(data) < 8 + n:
            raise SourceError(f"{path}: bad magic or cut off")
        yield from ((int(b),) for b in data[8 : 8 + n])

    a, b = decoded(spark, images, image_rows, "shape array<int>, input binary"), decoded(spark, labels, label_rows, "label long")
    if a.count() != b.count():
        raise SourceError("mnist: images and labels differ in number")
    return a.join(b, "idx")


def cifar(spark: SparkSession, path: str, classes: int = 10) -> DataFrame:
    """(idx, shape, input, label) of CIFAR-10 or CIFAR-100 files; planes become pixels, of two labels the fine one counts."""
    if classes not in (10, 100):
        raise InvalidArgument("cifar: classes must be 10 or 100")
    head = 1 if classes == 10 else 2

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        if len(data) % (head + 3072):
            raise SourceError(f"{name}: cut off")
        for at in range(0, len(data), head + 3072):
            pixels = np.frombuffer(data, np.uint8, 3072, at + head).reshape(3, 32, 32).transpose(1, 2, 0)
            yield [32, 32, 3], pixels.tobytes(), data[at + head - 1]

    return decoded(spark, path, rows, "shape array<int>, input binary, label long")


def web_dataset(spark: SparkSession, path: str, key: str = "stem") -> DataFrame:
    """(idx, key, shape, input, label) of tar shards: members of one stem are a sample, .cls is its label, an image its input.

    With ``key="stem"`` folders are ignored and the last image of a stem wins; ``key="path"`` keeps the folders.
    """
    if key not in ("stem", "path"):
        raise InvalidArgument("web_dataset: key is stem or path")

    def rows(_: str, data: bytes) -> Iterator[tuple]:
        samples: dict[str, dict] = {}
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for member in tar:
                if not member.isfile():
                    continue
                folder, _, base = member.name.rpartition("/")
                stem, _, suffix = base.partition(".")
                sample = samples.setdefault(stem if key == "stem" or not folder else f"{folder}/{stem}", {})
                body = tar.extractfile(member).read()
                if suffix == "cls":
                    sample["label"] = int(body.decode().strip())
                elif suffix.lower() in image.SUFFIXES:
                    sample["image"] = image.decode(body)
        for name in sorted(samples):
            found = samples[name].get("image")
            if found is not None:
                yield name, list(found.shape), found.tobytes(), samples[name].get("label", -1)

    return decoded(spark, path, rows, "key string, shape array<int>, input binary, label long")


def image_folder(spark: SparkSession, root: str, recursive: bool = False, channels: str = "keep", skip_bad: bool = False) -> DataFrame:
    """(idx, path, class, shape, input, label) of root/class/*.ext; labels number the sorted class folders, empty ones too."""
    suffixes = "{" + ",".join(sorted(image.SUFFIXES | {s.upper() for s in image.SUFFIXES})) + "}"

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            found = image.decode(data, channels)
        except SourceError:
            if skip_bad:
                return
            raise
        yield path, list(found.shape), found.tobytes()

    out = decoded(spark, root if recursive else f"{root.rstrip('/')}/*", rows, "path string, shape array<int>, input binary", recursive, f"*.{suffixes}")
    below = F.regexp_replace("path", r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    out = out.withColumn("class", F.split(below, "/")[0])
    classes = {name: k for k, name in enumerate(files.folders(root))}
    table = spark.createDataFrame(list(classes.items()) or [("", 0)], "class string, label long")
    return out.join(F.broadcast(table), "class")


def load_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, [frames, channels] of float32) of PCM16 or float32 RIFF files."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise SourceError("wav: not a RIFF file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            if (kind, bits) == (1, 16):
                return rate, (np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2") / 32768).astype(np.float32).reshape(-1, channels)
            if (kind, bits) == (3, 32):
                return rate, np.frombuffer(body[: len(body) // (4 * channels) * 4 * channels], "<f4").reshape(-1, channels)
            raise SourceError(f"wav: format {kind} of {bits} bits")
        at += 8 + size + size % 2
    raise SourceError("wav: no data")


def fit_frames(x: np.ndarray, frames: int | None, pad: float = 0.0) -> np.ndarray:
    """Cut or padded to so many frames."""
    if frames is None:
        return x
    return np.concatenate([x[:frames], np.full((max(0, frames - len(x)), x.shape[1]), pad, np.float32)])


def wav(spark: SparkSession, path: str, frames: int | None = None, pad: float = 0.0) -> DataFrame:
    """(idx, path, rate, shape, input) of WAV files."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        rate, x = load_wav(data)
        x = fit_frames(x, frames, pad)
        yield name, rate, list(x.shape), x.reshape(-1).astype(float).tolist()

    return decoded(spark, path, rows, "path string, rate int, shape array<int>, input array<double>")


def audio(spark: SparkSession, path: str, frames: int | None = None, pad: float = 0.0) -> DataFrame:
    """(idx, path, rate, shape, input) of audio files, known by their first bytes. Only WAV can be decoded here; others are errors
    that name their format."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        if (kind := sniffed(data)) != "wav":
            raise SourceError(f"{name}: no decoder for {kind} audio")
        rate, x = load_wav(data)
        x = fit_frames(x, frames, pad)
        yield name, rate, list(x.shape), x.reshape(-1).astype(float).tolist()

    return decoded(spark, path, rows, "path string, rate int, shape array<int>, input array<double>")


def video(spark: SparkSession, path: str) -> DataFrame:
    """Frames of videos: no decoder is available."""
    raise SourceError("video is not supported")


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """A PCM16 file of samples in [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


COPY_SIGNATURE = b"PGCOPY\n\xff\r\n\x00"
COPY_TYPES = {"int16": ">h", "int32": ">i", "int64": ">q", "float32": ">f", "float64": ">d", "bool": ">?"}
MAX_FIELD = 16 << 20


def copy_rows(data: bytes, types: list[str]) -> Iterator[tuple]:
    """Tuples of a PostgreSQL COPY BINARY payload. Null floats become NaN, null texts empty, other nulls are errors."""
    if data[:11] != COPY_SIGNATURE or len(data) < 19:
        raise SourceError("copy: bad signature")
    at = 19 + struct.unpack(">I", data[15:19])[0]
    while True:
        if at + 2 > len(data):
            raise SourceError("copy: cut off")
        n = struct.unpack(">h", data[at : at + 2])[0]
        at += 2
        if n == -1:
            return
        if n != len(types):
            raise SourceError(f"copy: {n} fields instead of {len(types)}")
        row: list[object] = []
        for kind in types:
            size = struct.unpack(">i", data[at : at + 4].rjust(4, b"\0"))[0]
            at += 4
            if size == -1:
                if kind in ("float32", "float64"):
                    row.append(float("nan"))
                elif kind == "text":
                    row.append("")
                else:
                    raise SourceError(f"copy: null in a field of type {kind}")
                continue
            if size < 0 or size > MAX_FIELD or at + size > len(data):
                raise SourceError("copy: bad field size")
            body = data[at : at + size]
            at += size
            if kind == "text":
                row.append(body.decode())
            elif kind not in COPY_TYPES or struct.calcsize(COPY_TYPES[kind]) != size:
                raise SourceError(f"copy: {size} bytes for type {kind}")
            else:
                row.append(struct.unpack(COPY_TYPES[kind], body)[0])
        yield tuple(row)


def copy_binary(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(idx, each column) of COPY BINARY files; ``columns`` are (name, type) with types of COPY_TYPES or text."""
    ddl = {"int16": "long", "int32": "long", "int64": "long", "bool": "boolean", "float32": "double", "float64": "double", "text": "string"}
    types = [t for _, t in columns]
    if unknown := [t for t in types if t not in ddl]:
        raise InvalidArgument(f"unknown type {unknown[0]!r}")
    return decoded(spark, path, lambda _, data: copy_rows(data, types), ", ".join(f"{n} {ddl[t]}" for n, t in columns))


#: First bytes of media files, in the order in which they are tried: (offset, bytes, name). Fixed values.
MEDIA = (
    (0, b"\xff\xd8\xff", "jpeg"), (0, b"\x89PNG\r\n\x1a\n", "png"), (0, b"GIF8", "gif"), (0, b"BM", "bmp"), (8, b"WEBP", "webp"), (0, b"II*\x00", "tiff"), (0, b"MM\x00*", "tiff"),
    (8, b"WAVE", "wav"), (0, b"fLaC", "flac"), (0, b"OggS", "ogg"), (0, b"ID3", "mp3"), (0, b"\xff\xfb", "mp3"), (4, b"ftypavif", "avif"), (4, b"ftyp", "mp4"),
)


def sniffed(data: bytes) -> str:
    """The format that the first bytes show, or unknown."""
    return next((name for at, magic, name in MEDIA if data[at : at + len(magic)] == magic), "unknown")


def media_format(content: Column) -> Column:
    """The format that the first bytes show, or unknown."""
    out = F.lit("unknown")
    for at, magic, name in reversed(MEDIA):
        out = F.when(F.substring(content, at + 1, len(magic)) == F.lit(magic), name).otherwise(out)
    return out
