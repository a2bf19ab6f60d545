"""Word hashes of many texts at once, in numpy.

A word is a run of bytes outside white space (0x20, 0x09 to 0x0D), with A to Z
lower-cased. Its hash is a polynomial over random byte values modulo 2**64,
taken from prefix sums, then mixed. Work goes in pieces of bounded size; only a
text that is longer than a piece makes a larger one.

``starts`` takes words of letters and digits instead (any other ASCII byte ends
one), lower-cases Latin-1 letters too, and hashes the beginnings of each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_bytes = np.arange(256)
IS_SPACE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE_LOW = np.where(IS_SPACE, np.uint64(0), _VALUE[LOWER])
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole texts with about size bytes."""
    raw, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _bounds(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of solid bytes, cut where texts meet."""
    n = len(solid)
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    cut = offs[(offs > 0) & (offs < n)]
    begin[cut] = solid[cut]
    finish[cut - 1] = solid[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def _hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): of all words in order; words of text i are first[i]:first[i + 1]."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offs), np.int64)
    start, end = _bounds(~IS_SPACE[raw], offs)
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE_LOW[raw] * up[:n], out=total[1:])
    return _hash(total, down, start, end), start, end, np.searchsorted(start, offs)


_LETTER = (_bytes >= 128) | np.isin(_bytes, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def starts(raw: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a row for each word, its whole hash and those of its first bytes, by length (0 if it isn't longer)."""
    n = len(raw)
    if not n:
        return np.zeros((0, 1 + len(lengths)), np.uint64), np.zeros(len(offs), np.int64)
    start, end = _bounds(_LETTER[raw], offs)
    up, down = _power(n)
    raw = LOWER[raw]
    accent = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    raw[accent] += 0x20
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:n], out=total[1:])
    out = [_hash(total, down, start, end)]
    for k in lengths:
        out.append(np.where(end - start > k, _hash(total, down, start, np.minimum(start + k, n)), np.uint64(0)))
    return np.stack(out, axis=1), np.searchsorted(start, offs)
