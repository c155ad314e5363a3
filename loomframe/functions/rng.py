"""Random number generators that depend on a seed and a position alone, never on partitions.

Golden mode uses sequential generators on the driver for small index lists; portable mode hashes the position and scales to any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.errors import InvalidArgument

_M64 = (1 << 64) - 1


class Pcg32:
    """PCG-XSH-RR with 64 bits of state (O'Neill 2014), on stream 54 by default."""

    def __init__(self, seed: int, stream: int = 54):
        self.inc = (stream << 1 | 1) & _M64
        self.state = 0
        self.next()
        self.state = (self.state + seed) & _M64
        self.next()

    def next(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.inc) & _M64
        word, turn = ((old >> 18 ^ old) >> 27) & 0xFFFFFFFF, old >> 59
        return (word >> turn | word << (-turn & 31)) & 0xFFFFFFFF

    def below(self, bound: int) -> int:
        """Uniform in [0, bound), by multiplication and rejection (Lemire 2019)."""
        if bound <= 0:
            raise InvalidArgument("bound must be positive")
        product = self.next() * bound
        if (product & 0xFFFFFFFF) < bound:
            floor = (1 << 32) % bound
            while (product & 0xFFFFFFFF) < floor:
                product = self.next() * bound
        return product >> 32

    def uniform24(self) -> float:
        return (self.next() >> 8) / (1 << 24)

    def uniform53(self) -> float:
        high, low = self.next() >> 5, self.next() >> 6
        return (high * (1 << 26) + low) / (1 << 53)

    def permutation(self, n: int) -> list[int]:
        """A Fisher-Yates shuffle of 0..n-1, from the last place down."""
        out = list(range(n))
        for last in range(n - 1, 0, -1):
            k = self.below(last + 1)
            out[last], out[k] = out[k], out[last]
        return out


def splitmix64(x: np.ndarray | int) -> np.ndarray:
    """The finaliser of splitmix64 (Steele and others 2014) over uint64."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mixed(a: int, b: int, c: int) -> int:
    """One seed from three numbers. The added number is a fixed value."""
    inner = int(splitmix64(a ^ int(splitmix64(b))))
    return int(splitmix64(inner ^ int(splitmix64((c + 0x632BE59BD9B4E019) & _M64))))


def philox(counter: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Philox 4x32-10 (Salmon and others 2011): rows of four uint32 counters to rows of four uint32."""
    c = [np.asarray(counter[..., k], dtype=np.uint64) for k in range(4)]
    k0, k1 = key
    low = np.uint64(0xFFFFFFFF)
    for _ in range(10):
        a, b = c[0] * np.uint64(0xD2511F53), c[2] * np.uint64(0xCD9E8D57)
        c = [(b >> np.uint64(32)) ^ c[1] ^ np.uint64(k0), b & low, (a >> np.uint64(32)) ^ c[3] ^ np.uint64(k1), a & low]
        k0, k1 = (k0 + 0x9E3779B9) & 0xFFFFFFFF, (k1 + 0xBB67AE85) & 0xFFFFFFFF
    return np.stack(c, axis=-1).astype(np.uint32)


class Feistel:
    """A permutation of [0, n) in constant memory: four rounds over the least even number of bits, walking until inside."""

    def __init__(self, n: int, seed: int):
        self.n = n
        bits = max(2, (max(n - 1, 0).bit_length() + 1) // 2 * 2)
        self.half = bits // 2
        self.keys = [int(splitmix64((seed + r * 0x9E3779B97F4A7C15) & _M64)) for r in range(4)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> half, x & mask
        for key in self.keys:
            left, right = right, left ^ (splitmix64(right ^ np.uint64(key)) & mask)
        return left << half | right

    def __call__(self, x: np.ndarray | int) -> np.ndarray:
        if self.n <= 1:
            return np.zeros_like(np.asarray(x, dtype=np.uint64))
        out = self._once(np.asarray(x, dtype=np.uint64))
        while (outside := out >= np.uint64(self.n)).any():
            out = np.where(outside, self._once(out), out)
        return out


def fnv1a64(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & _M64
    return h


def order_key(seed: int, *key: str | Column) -> Column:
    """A text to sort by: a random order that depends on the seed and the key alone, the same in any SQL engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in key)).cast("binary"))


def unit(seed: int, *key: str | Column) -> Column:
    """Uniform in [0, 1), from the first 52 bits of the order key."""
    return F.conv(F.substring(order_key(seed, *key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
