"""Vectorised word spans and substring hashes over the byte buffer of an Arrow string column.

A block is the UTF-8 bytes of consecutive documents. Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``.
Substring hashes are polynomial over a random table, modulo 2**64, so that the hash of any span comes from two prefix
sums; a final mixing step spreads them over all bits. Two different spans share a hash with chance 2**-64.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
STRETCH = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that makes every output bit depend on every input bit (one to one)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def space_mask(data: np.ndarray) -> np.ndarray:
    """True at ``[\\x20\\x09-\\x0D]``."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, most_rows: int = 60_000):
    """Slices of a string column as (first row, byte array, row offsets into it); null rows are empty.

    A slice ends at the row that reaches ``limit`` bytes, so one very long document is a slice of its own, or after
    ``most_rows`` rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    rows = len(column)
    if rows == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=rows + 1 + column.offset)[column.offset:]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="left"))
        j = min(max(j, i + 1), i + most_rows, rows)
        yield i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of every word; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    letter = ~space_mask(data)
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] |= letter[cut]
    end[cut - 1] |= letter[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class SpanHash:
    """Hashes of byte spans of a block from prefix sums; ``seed`` picks the table."""

    def __init__(self, seed: int = 1):
        self.table = _splitmix(256, seed)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int):
        if len(self.power) < n:
            n = max(n, BLOCK_BYTES + 1)
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.power = np.full(n, _BASE, np.uint64)
            self.power[0] = 1
            np.cumprod(self.power, out=self.power)
            self.inverse = np.full(n, inv, np.uint64)
            self.inverse[0] = 1
            np.cumprod(self.inverse, out=self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        for i in range(0, len(data), STRETCH):  # in place, stretch by stretch: else three more arrays of eight times the data
            part = data[i:i + STRETCH]
            np.multiply(self.table[part], self.power[i:i + len(part)], out=out[1 + i:1 + i + len(part)])
        np.cumsum(out[1:], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.prefix(data), starts, ends)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (rows are not looked at)."""
    out = words[: max(len(words) - size + 1, 0)].copy()
    for k in range(1, size):
        out = combine(out, words[k:k + len(out)])
    return out
