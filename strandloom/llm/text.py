"""Whole-batch tokenising with NumPy.

Words are found on UTF-8 bytes.  Both word definitions used here only name ASCII
bytes as delimiters, so every byte from 0x80 on belongs to a word and bytes and
code points give the same words.  A word's 64-bit hash is a polynomial in random
byte values modulo 2**64, finished with a bijective mixer; two given words
collide with odds near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLANK = 0x20
_CHUNK = 1 << 20  # bytes tokenised at a time; a longer text is a chunk of its own


def byte_table(lower: bool = False, alnum: bool = False) -> np.ndarray:
    """256 bytes: delimiters become a blank, A-Z lower case if asked.

    ``alnum``: words are digits, lower-case a-z and everything beyond ASCII, else
    all but ``\\x20\\x09-\\x0D``.
    """
    table = np.arange(256, dtype=np.uint8)
    if lower or alnum:
        table[65:91] += 32
    if alnum:
        keep = np.zeros(256, dtype=bool)
        keep[48:58] = keep[97:123] = keep[128:] = True
        keep = keep[table]
        table[~keep] = _BLANK
    else:
        table[9:14] = _BLANK
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2B  # odd, and one less is twice an odd number
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(max(n, _CHUNK) + 1, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[:] = out
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of consecutive rows: ``first[i]:first[i+1]`` are those of row i."""

    row: int  # the batch row of the first document
    first: np.ndarray
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  # uint8, after the byte table


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def tokenise(column: pa.Array, table: np.ndarray, hashed: bool = True) -> Iterator[Words]:
    """Words of a binary column, in chunks of whole rows of about a megabyte."""
    offsets, data = binary_parts(column)
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _CHUNK, side="right")) - 1)
        base = offsets[low]
        part = table[data[base : offsets[high]]]
        bounds = offsets[low : high + 1] - base
        yield _words(low, part, bounds, hashed)
        low = high


def _words(row: int, part: np.ndarray, bounds: np.ndarray, hashed: bool) -> Words:
    inside = part != _BLANK
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(part)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = edges[edges > 0] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    if not hashed:
        return Words(row, first, start, end, np.zeros(0, np.uint64), part)
    power, inverse = _power_tables(len(part))
    sums = _VALUES[part]
    sums *= power[: len(part)]
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(sums, out=total[1:])
    codes = (total[end] - total[start]) * inverse[start]
    return Words(row, first, start, end, mix(codes + (end - start).astype(np.uint64)), part)


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive codes, wherever they stand (rows are not told apart)."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= np.uint64(_BASE)
        out += codes[i : i + count]
    return mix(out)
