"""Vectorised reading of text columns: Arrow buffers -> words -> 64-bit hashes.

The kernels of several operators work on whole Arrow batches as flat byte
arrays.  Words are maximal runs of bytes other than space and 0x09-0x0D; in
UTF-8 those bytes never lie inside a character, so bytes and code points agree
on where a word ends.  Only A-Z are lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK64 = (1 << 64) - 1
_RNG = np.random.default_rng(20240229)
_MAX_WORD = 4096
STRETCH = 1 << 20         # bytes hashed at a time
#: multilinear hash: one random odd factor per byte position, one random value per byte
_POS = _RNG.integers(0, 2 ** 63, _MAX_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RNG.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHINGLE = _RNG.integers(0, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string column: row i is ``data[offsets[i]:offsets[i+1]]``.
    A null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null(b"" if "binary" in str(col.type) else "")
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """``(hash, row, start, end)`` of every word of the rows, in order.  The
    bytes are taken in stretches that end at white space, so the working memory
    does not grow with the rows (but for a longer word)."""
    found, a = [], 0
    while a < len(data):
        b = min(len(data), a + STRETCH)
        while b < len(data):
            gap = np.flatnonzero(_SPACE[data[b:b + STRETCH]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(len(data), b + STRETCH)
        near = offsets[np.searchsorted(offsets, a, "left"):np.searchsorted(offsets, b, "left")]
        h, start, end = _stretch_words(data[a:b], near - a, lower)
        start = start + a
        found.append((h, np.searchsorted(offsets, start, "right") - 1, start, end + a))
        a = b
    if not found:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretch_words(data: np.ndarray, row_starts: np.ndarray, lower: bool):
    """``(hash, start, end)`` of the words of one stretch."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[row_starts] |= inside[row_starts]      # a row end also ends a word
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return np.zeros(0, np.uint64), empty, empty
    length = np.add.reduceat(inside, start, dtype=np.int64)
    pos = np.arange(n, dtype=np.int64)
    pos -= np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [n]))))
    np.minimum(pos, _MAX_WORD - 1, out=pos)
    value = (_LOWER_BYTE if lower else _BYTE)[data] * _POS[pos]
    value[~inside] = 0
    h = mix64(np.add.reduceat(value, start) + length.astype(np.uint64))
    for i in np.flatnonzero(length > _MAX_WORD):
        raw = data[start[i]:start[i] + length[i]].tobytes()
        raw = raw.lower() if lower else raw
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return h, start, start + length


def shingles(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of the runs of ``size`` words of each row; a row with
    fewer words gives its whole sequence as one."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    same = np.ones(n, bool)
    short = np.zeros(n, np.uint64)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    for j in range(size):
        acc[:n - j] += h[j:] * _SHINGLE[j]
        if j:
            same[n - j:] = False
            same[:n - j] &= row[j:] == row[:n - j]
        in_row = np.zeros(n, bool)
        in_row[:n - j] = row[j:] == row[:n - j]
        short[:n - j] += np.where(in_row[:n - j], h[j:] * _SHINGLE[j], np.uint64(0))
    few = first & ~same
    keep = same | few
    value = np.where(same, acc, short + np.uint64(0x5851F42D4C957F2D))
    return mix64(value[keep]), row[keep]
