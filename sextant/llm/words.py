"""Words of whole Arrow batches as 64-bit hashes, found on the texts' bytes without a Python object for each.

A word is a run of bytes other than the separators; A-Z are lowered. A word's hash is a polynomial in its bytes modulo
2**64, mixed with its length; words above LONG bytes are hashed one by one by xxh3. Null texts have no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
LONG, CHUNK = 64, 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE, CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)
#: Tab to carriage return, and the space.
BLANKS = np.zeros(256, bool)
BLANKS[[*range(9, 14), 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(29))


def content(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins (and the last ends) in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(apart: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the runs of False in `apart` that lie within one text."""
    inside = ~apart
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= apart[:-1]
    ends[:-1] &= apart[1:]
    own = at[(at > 0) & (at < len(apart))]
    begins[own] = inside[own]
    ends[own - 1] = inside[own - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of the bytes; equal bytes, equal hash; never 0."""
    out = np.zeros(len(begins), U)
    size = ends - begins
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + CHUNK, "right")))
        if b == a + 1 and size[a] > LONG:
            a = b
            continue
        first = begins[a]
        part = low[first : ends[b - 1]].astype(U)
        part += U(1)
        part *= _POWER[: len(part)]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=sums[1:])
        x, y = begins[a:b] - first, ends[a:b] - first
        out[a:b] = (sums[y] - sums[x]) * _INVERSE[x]
        a = b
    out ^= size.astype(U) * U(0xD6E8FEB86659FD93)
    out = mix(out)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(low[begins[k] : ends[k]].tobytes())
    return np.maximum(out, U(1))


@dataclass
class Words:
    """All words of a batch: their bytes' places in `low`, their hashes, and how many each text has."""

    low: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    hash: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, column) -> Words:
        data, at = content(column)
        begins, ends = spans(BLANKS[data], at)
        low = LOWER[data]
        return cls(low, begins, ends, hashes(low, begins, ends), np.diff(np.searchsorted(begins, at)))

    def text(self, k: int) -> str:
        return self.low[self.begins[k] : self.ends[k]].tobytes().decode("utf-8", "replace")

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


class Table:
    """Numbers for 64-bit hashes in an open-addressed array: at most half of its places are taken, later keys are not kept."""

    def __init__(self, bits: int = 20):
        self.mask = U((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)
        self.left = 1 << (bits - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for unknown keys."""
        at = (keys & self.mask).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            held, own = self.keys[at[open_]], keys[open_]
            hit = held == own
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different new keys with their numbers, as far as there is room."""
        keys, values = keys[: self.left], values[: self.left]
        self.left -= len(keys)
        at = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & int(self.mask)
