"""Array helpers shared by the operators' Arrow tasks: slices of a batch, the
bytes below a string column, ragged gathers and span hashes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, byte offsets) of runs of rows with about
    `limit` bytes of text; a longer text is a run of its own. Nulls are empty."""
    column = pc.fill_null(batch.column(col).cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets; empty runs give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWER_BITS = 12


@functools.cache
def _power_steps(base: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i modulo 2^64 for i below 2^_POWER_BITS, and base^(i 2^_POWER_BITS) for i < steps."""
    out = []
    for factor, n in ((base, 1 << _POWER_BITS), (pow(base, 1 << _POWER_BITS, 1 << 64), steps)):
        powers = np.full(n, factor, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def _steps(n: int) -> int:
    """Long steps that reach n places, as a power of two, so that few tables are kept."""
    return 1 << max(4, int(n >> _POWER_BITS).bit_length())


def _powers(n: int) -> np.ndarray:
    """_BASE^i modulo 2^64 for i < n, put together from two short tables: a worker keeps no table as long as its data."""
    short, long = _power_steps(_BASE, _steps(n))
    return (long[: (n >> _POWER_BITS) + 1, None] * short).ravel()[:n]


def _inverse_powers(at: np.ndarray, n: int) -> np.ndarray:
    """_BASE^-i modulo 2^64 at the given i <= n; an odd base has an inverse."""
    short, long = _power_steps(pow(_BASE, -1, 1 << 64), _steps(n))
    return long[at >> _POWER_BITS] * short[at & ((1 << _POWER_BITS) - 1)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal spans, equal hashes, wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data)), out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * _inverse_powers(starts, len(data)) + lengths * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of 64-bit values: equal runs, equal hashes, wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values)), out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * _inverse_powers(starts, len(values)) + lengths * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii() -> bytes:
    """A table for bytes.translate: A-Z to a-z, all else as it is."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
