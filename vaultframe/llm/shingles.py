"""Word shingle sets as 64-bit hashes, and their b-bit MinHash signatures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from .common import LOWER

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles of the text with A-Z lowered.

    Words are runs of bytes other than space and 0x09-0x0D. With fewer words the whole
    sequence is one shingle; without words the set is empty.
    """
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), n)], np.uint64)
    x = h[: n - width + 1]
    for j in range(1, width):
        x = mixed(x * _M1 + h[j : n - width + 1 + j])
    return np.unique(x)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed 64-bit numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(a), int(b)


class Signer:
    """``size`` symbols of 16 bits: each is cut from the least of the set's re-hashed values.

    Values are re-hashed in 32 bits, which processors multiply several at a time; two
    shingles of one set share them once in 2 ** 32 pairs.
    """

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.xor, self.mul = (rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))

    def _hashed(self, s: np.ndarray) -> np.ndarray:
        x = ((s >> _S).astype(np.uint32)[:, None] ^ self.xor) * self.mul
        x ^= x >> np.uint32(15)
        return x

    def _symbols(self, least: np.ndarray) -> np.ndarray:
        return (mixed(least.astype(np.uint64) * _M1) >> np.uint64(48)).astype(np.uint16)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.xor), 2**32 - 1, np.uint32)
        for at in range(0, len(s), 2048):
            np.minimum(least, self._hashed(s[at : at + 2048]).min(0), out=least)
        return self._symbols(least)

    def each(self, parts: Sequence[np.ndarray]) -> np.ndarray:
        """A row of symbols for each of ``parts``, none of them empty, taken together."""
        every, size = (np.concatenate(parts) >> _S).astype(np.uint32), np.array([len(p) for p in parts])
        least, ends, at = np.empty((len(self.xor), len(parts)), np.uint32), np.cumsum(size), 0
        while at < len(parts):  # as many as a core's cache holds; a symbol's values follow each other
            lo = ends[at] - size[at]
            end = max(at + 1, int(np.searchsorted(ends, lo + 16384, "right")))
            x, begin = every[lo : ends[end - 1]], ends[at:end] - size[at:end] - lo
            y, z = np.empty_like(x), np.empty_like(x)
            for j in range(len(self.xor)):
                np.multiply(np.bitwise_xor(x, self.xor[j], out=y), self.mul[j], out=y)
                np.bitwise_xor(y, np.right_shift(y, np.uint32(15), out=z), out=y)
                np.minimum.reduceat(y, begin, out=least[j, at:end])
            at = end
        return self._symbols(np.ascontiguousarray(least.T))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
