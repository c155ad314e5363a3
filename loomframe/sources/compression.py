"""Compressed bytes, known by their first bytes or else by the file's suffix."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import pyarrow as pa

from loomframe.errors import SourceError

MAGIC = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"\x04\x22\x4d\x18", "lz4"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))
SUFFIX = {".gz": "gzip", ".gzip": "gzip", ".zst": "zstd", ".zstd": "zstd", ".lz4": "lz4", ".bz2": "bzip2", ".xz": "xz", ".zz": "zlib", ".zlib": "zlib"}


def sniff(data: bytes, path: str = "") -> str | None:
    """The codec's name, or None for plain bytes."""
    for magic, name in MAGIC:
        if data.startswith(magic):
            return name
    return next((name for suffix, name in SUFFIX.items() if path.endswith(suffix)), None)


def decompress(data: bytes, codec: str | None) -> bytes:
    """All members of the stream."""
    try:
        if codec is None:
            return data
        if codec == "gzip":
            return gzip.decompress(data)
        if codec == "bzip2":
            return bz2.decompress(data)
        if codec == "xz":
            return lzma.decompress(data)
        if codec == "zlib":
            return zlib.decompress(data)
        if codec in ("zstd", "lz4"):
            with pa.CompressedInputStream(pa.BufferReader(data), codec) as f:
                return f.read()
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, pa.ArrowException) as e:
        raise SourceError(f"{codec} stream: {e}") from e
    raise SourceError(f"unknown codec {codec!r}")


def compress(data: bytes, codec: str) -> bytes:
    """One compressed stream."""
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    if codec == "bzip2":
        return bz2.compress(data)
    if codec == "xz":
        return lzma.compress(data)
    if codec == "zlib":
        return zlib.compress(data)
    if codec in ("zstd", "lz4"):
        out = pa.BufferOutputStream()
        with pa.CompressedOutputStream(out, codec) as f:
            f.write(data)
        return out.getvalue().to_pybytes()
    raise SourceError(f"unknown codec {codec!r}")


def opened(data: bytes, path: str = "") -> bytes:
    """``data`` decompressed if it is compressed."""
    return decompress(data, sniff(data, path))
