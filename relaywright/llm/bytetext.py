"""Vectorised work on the UTF-8 bytes of a block of texts, inside Arrow tasks.

A block is one uint8 array with the texts end to end, and their offsets. Hashes are
polynomials modulo 2**64 over table values of bytes, read off prefix sums, so that the hash of
any stretch costs two lookups.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _ODD
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def table(seed: int, fold=lambda b: b) -> np.ndarray:
    """A value for each byte; bytes that `fold` maps alike get the same."""
    return np.array([_mixed(seed * 1_000_003 + fold(b)) for b in range(256)], dtype=U64)


def lower_ascii(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


#: Space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, seed: int):
        self.base = _mixed(seed) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self._up = np.ones(1, dtype=U64)
        self._down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, min(2 * n, BLOCK_BYTES + 1024))
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                x = np.full(size, b, dtype=U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self._up[:n], self._down[:n]


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    up, _ = powers.upto(len(values))
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values * up, dtype=U64, out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end]; equal stretches give equal hashes wherever they stand."""
    _, down = powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and its offsets."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, at = as_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space; none spans two texts."""
    n = len(data)
    solid = np.zeros(n + 2, dtype=bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    starts = solid[1:] & ~solid[:-1]
    ends = solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    both = inner[(inner > 0) & (inner < n)]
    both = both[solid[both] & solid[both + 1]]
    starts[both] = ends[both] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that holds each position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def unsigned(column: np.ndarray) -> pa.Array:
    """uint64 hashes as the long column that Spark has."""
    return pa.array(column.view(np.int64))


def give_back() -> None:
    """Hands freed memory back to the system at the end of a task: Python workers are kept for the next, which may be of another kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
