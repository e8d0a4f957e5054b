"""Vectorised work on blocks of UTF-8 texts: words and rolling hashes as numpy arrays.

A block is one ``uint8`` array of all bytes with the offsets of its documents, taken
from an Arrow column without making Python strings. A word's hash is a difference of
prefix sums of ``byte * R^i`` modulo 2^64, shifted back by ``R^-start``, so every word
(and every window of words) costs a constant number of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 21
_R = 0x9E3779B97F4A7C15
_S = 0xC2B2AE3D27D4EB4F
_tables: dict[tuple[int, bool], np.ndarray] = {}

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What ends a word of letters and digits; bytes of non-ASCII characters count as letters.
NON_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    key = (base, inverse)
    if key not in _tables or len(_tables[key]) < n:
        size = max(n, (1 << 19) + 1)
        step = np.full(size, pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        step[0] = 1
        made = np.multiply.accumulate(step)
        if size > 2 * BLOCK_BYTES:
            return made  # one very long text: not kept
        _tables[key] = made
    return _tables[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(offsets: np.ndarray, data: np.ndarray, ends_word: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each document (one more than rows)."""
    solid = ~ends_word[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def _prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _powers(base, len(values)), out=total[1:])
    return np.cumsum(total, out=total)


def _spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return (total[ends] - total[starts]) * _powers(base, len(total), True)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the words of one block that start and end there, for each array of ends."""
    values = data.astype(np.uint64)
    values += np.uint64(1)
    total = _prefix_sums(values, _R)
    del values
    return [mix(_spans(total, starts, e, _R) + (e - starts).astype(np.uint64) * np.uint64(_S)) for e in ends]


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and 64-bit hash of every window of ``size`` words inside one document."""
    at = np.arange(len(hashes))
    ends = np.repeat(first[1:], np.diff(first))
    at = at[at + size <= ends]
    return at, mix(_spans(_prefix_sums(hashes, _S), at, at + size, _S))
