"""Words of many texts at once, as numpy arrays.

Texts are UTF-8. Words are maximal runs of bytes other than space, tab, line
feed, vertical tab, form feed and carriage return; those bytes never occur
inside a longer UTF-8 sequence, so byte runs and character runs agree.

Hashes are 64-bit polynomials over random byte values, modulo 2^64, with a
final mix. All values are fixed, so that every task gives the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
_BYTE_VALUES[_IS_SPACE] = 0


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            # Twice as many as before, up to a whole chunk: short texts need few.
            n = max(n, min(2 * len(self.up), CHUNK_BYTES + 1))
            for name, step in (("up", self.base), ("down", self.inverse)):
                values = np.full(n, step, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))


_OVER_BYTES = _Powers(0x9E3779B97F4A7C15)
_OVER_WORDS = _Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Texts:
    """A few texts laid end to end: text i is bytes offsets[i] to offsets[i + 1] of `data`."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_IS_SPACE[self.data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = self.offsets[:-1]
            before[cuts[cuts < len(inside)]] = False
            after[-1] = False
            cuts = self.offsets[1:] - 1
            after[cuts[cuts >= 0]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        """First byte of each word."""
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        """Byte after each word."""
        return self._bounds[1]

    @cached_property
    def first(self) -> np.ndarray:
        """Text i has words first[i] to first[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        _OVER_BYTES.grow(len(self.data))
        h = np.add.reduceat(_BYTE_VALUES[self.data] * _OVER_BYTES.up[: len(self.data)], self.starts)
        return mix(h * _OVER_BYTES.down[self.starts])

    def windows_from(self, k: int) -> np.ndarray:
        """Whether k words of one text start at each word."""
        return np.arange(len(self.starts)) + k <= np.repeat(self.first[1:], self.n_words)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values of h; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    _OVER_WORDS.grow(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _OVER_WORDS.up[: len(h)], out=total[1:])
    n = len(h) - k + 1
    return mix((total[k:] - total[:-k]) * _OVER_WORDS.down[:n])


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of all values of h in order."""
    return window_hashes(h, len(h))[0] ^ np.uint64(len(h))


def texts(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """Consecutive texts of a string column, about `limit` bytes at a time: first row, texts.

    Null is the empty text. A text longer than the limit comes alone.
    """
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        yield lo, Texts(_LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    width = 1
    while 2 * width <= k:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (k - width)], values[k - width :]) if k > width else values
