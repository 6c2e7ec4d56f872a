"""Character n-grams of many texts at once, as hashed bucket numbers.

Letters are folded to lower case (ASCII and Latin-1), everything else is a
separator. An n-gram lies inside one word; its first and last place may be
the separator before and after the word, which marks the word's edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from weekwise.llm.words import Texts

SEPARATOR = 32
_FOLD = np.full(256, SEPARATOR, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
# Digits and signs that stand in for letters in disguised words.
_LOOKALIKE = _FOLD.copy()
for _sign, _letter in zip("0134578@", "oieastba"):
    _LOOKALIKE[ord(_sign)] = ord(_letter)
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@dataclass
class Letters:
    """Folded bytes of texts, each text followed by one separator."""

    texts: Texts
    lookalikes: bool = False

    @cached_property
    def codes(self) -> np.ndarray:
        data = self.texts.data
        codes = (_LOOKALIKE if self.lookalikes else _FOLD)[data]
        if len(data):
            capital = np.zeros(len(data), bool)
            capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            codes[capital] += 0x20
        return np.insert(codes, self.texts.offsets[1:], SEPARATOR)

    @cached_property
    def offsets(self) -> np.ndarray:
        """Text i is codes[offsets[i]:offsets[i + 1]], its separator included."""
        return self.texts.offsets + np.arange(len(self.texts.offsets))

    @cached_property
    def separators(self) -> np.ndarray:
        return self.codes == SEPARATOR

    @cached_property
    def starts(self) -> np.ndarray:
        """First byte of each word."""
        s = self.separators
        return np.flatnonzero(~s & np.r_[True, s[:-1]]) if len(s) else np.zeros(0, np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        """Text i has words first[i] to first[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    def buckets(self, n: int, bits: int) -> np.ndarray:
        """1 + bucket of the n-gram at each place, 0 where there is none; n is 3 to 5."""
        c, s = self.codes, self.separators
        size = len(c) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        h = np.zeros(size, np.uint32)
        broken = np.zeros(size, bool)
        for j in range(n):
            h += (c[j : j + size].astype(np.uint32) + np.uint32(n)) * _FACTORS[j]
            if 0 < j < n - 1:
                broken |= s[j : j + size]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - bits)
        out = h.astype(np.int64) + 1
        out[broken] = 0
        return out
