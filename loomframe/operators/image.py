"""Images as arrays [height, width, channels] of uint8, decoded and transformed in numpy where the rows are.

A chain of steps is fused by hand: one Arrow pass decodes nothing twice and stores nothing between steps. Random steps draw from a
counter generator keyed by (seed, row position, step), so results do not depend on partitions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomframe.errors import InvalidArgument, ShapeMismatch, SourceError
from loomframe.functions.rng import philox

SUFFIXES = {"png", "bmp", "ppm", "pgm", "jpg", "jpeg", "gif", "tga", "tif", "tiff", "webp"}
Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if head is None or head[2] != 8 or head[6]:
        raise SourceError("png: only 8 bits a channel without interlacing are read")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    before = np.zeros(w * channels, np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + before
        elif kind in (1, 3, 4):
            for x in range(w * channels):
                a = line[x - channels] if x >= channels else 0
                b, c = before[x], before[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        before = line & 255
        out[y] = before
    out = out.reshape(h, w, channels)
    return palette[out[..., 0]] if head[3] == 3 and palette is not None else out


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack("<I", data[10:14])
    w, h, _, bits, packed = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise SourceError("bmp: only 24 or 32 bits without compression are read")
    row = (w * bits // 8 + 3) // 4 * 4
    x = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (x[::-1] if h > 0 else x)[..., [2, 1, 0]].copy()


def _pnm(data: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    w, h, top = words
    channels = {b"P5": 1, b"P6": 3}[data[:2]]
    if top != 255:
        raise SourceError("pnm: only 8 bits are read")
    return np.frombuffer(data, np.uint8, w * h * channels, at + 1).reshape(h, w, channels).copy()


def _tiff(data: bytes) -> np.ndarray:
    order = "<" if data[:2] == b"II" else ">"
    at, = struct.unpack(order + "I", data[4:8])
    tags: dict[int, list[int]] = {}
    n, = struct.unpack(order + "H", data[at : at + 2])
    for k in range(n):
        tag, kind, count, _ = struct.unpack(order + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
        size = {1: 1, 3: 2, 4: 4}.get(kind, 0)
        if size:
            where = at + 10 + 12 * k if size * count <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = list(struct.unpack(order + {1: "B", 2: "H", 4: "I"}[size] * count, data[where : where + size * count]))
    w, h, channels = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    if set(tags.get(258, [8])) != {8} or tags.get(259, [1])[0] != 1:
        raise SourceError("tiff: only 8 bits without compression are read")
    body = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(body, np.uint8, w * h * channels).reshape(h, w, channels).copy()


def decode(data: bytes, channels: str = "keep") -> np.ndarray:
    """An image of PNG, BMP, PPM, PGM or TIFF bytes; channels keep, gray, rgb or rgba. Other formats raise SourceError."""
    readers = ((b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"P5", _pnm), (b"P6", _pnm), (b"II*\0", _tiff), (b"MM\0*", _tiff))
    reader = next((r for magic, r in readers if data.startswith(magic)), None)
    if reader is None:
        raise SourceError("image: no decoder for this format")
    try:
        return with_channels(reader(data), channels)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        raise SourceError(f"image: {e}") from e


def encode_png(x: np.ndarray) -> bytes:
    """PNG bytes of an image of 1, 3 or 4 channels."""
    h, w, c = x.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def gray(x: np.ndarray, channels: int = 1) -> np.ndarray:
    """Luma .2989 R + .5870 G + .1140 B, rounded."""
    y = x[..., 0] if x.shape[2] < 3 else np.clip(np.floor(x[..., 0] * 0.2989 + x[..., 1] * 0.5870 + x[..., 2] * 0.1140 + 0.5), 0, 255).astype(np.uint8)
    return np.repeat(y[..., None], channels, axis=2)


def with_channels(x: np.ndarray, channels: str) -> np.ndarray:
    if channels == "keep":
        return x
    if channels == "gray":
        return gray(x)
    rgb = x[..., :3] if x.shape[2] >= 3 else np.repeat(x[..., :1], 3, axis=2)
    if channels == "rgb":
        return rgb
    if channels == "rgba":
        alpha = x[..., 3:] if x.shape[2] == 4 else np.full((*x.shape[:2], 1), 255, np.uint8)
        return np.concatenate([rgb, alpha], axis=2)
    raise InvalidArgument(f"unknown channels {channels!r}")


def _axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def resize(h: int, w: int, how: str = "bilinear") -> Step:
    """To [h, w]: bilinear between half-pixel centres, or nearest."""
    if h < 1 or w < 1 or how not in ("bilinear", "nearest"):
        raise InvalidArgument("resize: bad size or interpolation")

    def run(x: np.ndarray, draws: np.ndarray) -> np.ndarray:
        if x.shape[:2] == (h, w):
            return x
        if how == "nearest":
            return x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]
        y0, y1, fy = _axis(x.shape[0], h)
        x0, x1, fx = _axis(x.shape[1], w)
        v = x.astype(np.float64)
        top = v[y0][:, x0] + (v[y0][:, x1] - v[y0][:, x0]) * fx[None, :, None]
        low = v[y1][:, x0] + (v[y1][:, x1] - v[y1][:, x0]) * fx[None, :, None]
        out = top + (low - top) * fy[:, None, None]
        return np.floor(out + 0.5).astype(np.uint8) if x.dtype == np.uint8 else out.astype(x.dtype)

    return run


def center_crop(h: int, w: int) -> Step:
    def run(x: np.ndarray, draws: np.ndarray) -> np.ndarray:
        if x.shape[0] < h or x.shape[1] < w:
            raise ShapeMismatch(f"crop of {h}x{w} from {x.shape[0]}x{x.shape[1]}")
        y, z = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
        return x[y : y + h, z : z + w]

    return run


def random_crop(h: int, w: int) -> Step:
    def run(x: np.ndarray, draws: np.ndarray) -> np.ndarray:
        if x.shape[0] < h or x.shape[1] < w:
            raise ShapeMismatch(f"crop of {h}x{w} from {x.shape[0]}x{x.shape[1]}")
        y, z = int(draws[0]) % (x.shape[0] - h + 1), int(draws[1]) % (x.shape[1] - w + 1)
        return x[y : y + h, z : z + w]

    return run


def random_flip(p: float = 0.5, vertical: bool = False) -> Step:
    return lambda x, draws: (x[::-1] if vertical else x[:, ::-1]) if int(draws[2 + vertical]) / 2**32 < p else x


def grayscale(channels: int = 1) -> Step:
    return lambda x, draws: gray(x, channels)


def padded(p: int, fill: int = 0) -> Step:
    return lambda x, draws: np.pad(x, ((p, p), (p, p), (0, 0)), constant_values=fill)


def to_tensor() -> Step:
    """[channels, height, width] of float32 in [0, 1]."""
    return lambda x, draws: (x.transpose(2, 0, 1) / np.float32(255)).astype(np.float32)


def normalize(mean: list[float], std: list[float]) -> Step:
    """(x - mean) / std of each channel; an image of bytes becomes a tensor first."""

    def run(x: np.ndarray, draws: np.ndarray) -> np.ndarray:
        x = to_tensor()(x, draws) if x.dtype == np.uint8 else x
        if len(mean) != len(x) or len(std) != len(x):
            raise ShapeMismatch("normalize: channels differ")
        return ((x - np.array(mean, np.float32)[:, None, None]) / np.array(std, np.float32)[:, None, None]).astype(np.float32)

    return run


def fused(*steps: Step) -> Step:
    def run(x: np.ndarray, draws: np.ndarray) -> np.ndarray:
        for k, step in enumerate(steps):
            x = step(x, draws[k])
        return x

    return run


def apply(df: DataFrame, *steps: Step, seed: int = 0) -> DataFrame:
    """(idx, shape, data, label) of images (idx, shape, input, label) after the steps: one pass, draws keyed by seed, idx and step."""
    chain = fused(*steps)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64]
                idx = part["idx"].to_numpy(np.uint64)
                counters = (np.stack([idx & np.uint64(0xFFFFFFFF), idx >> np.uint64(32), np.full_like(idx, k), np.zeros_like(idx)], axis=1) for k in range(len(steps)))
                draws = np.stack([philox(c, (seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF)) for c in counters] or [np.zeros((len(idx), 4), np.uint32)], axis=1)
                made = [chain(np.frombuffer(b, np.uint8).reshape(tuple(s)), d) for b, s, d in zip(part["input"], part["shape"], draws, strict=True)]
                yield pd.DataFrame({"idx": part["idx"], "shape": [list(m.shape) for m in made], "data": [m.reshape(-1).astype(np.float32) for m in made], "label": part["label"]})

    return df.select("idx", "shape", "input", "label").mapInPandas(run, "idx long, shape array<int>, data array<float>, label long")
