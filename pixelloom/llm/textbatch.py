"""Vectorised views of a batch of texts: packed UTF-8 bytes, words, lines and their 64-bit hashes.

Texts of an Arrow batch are taken in runs of about half a megabyte, so memory follows the longest text and not the
batch. A hash of a slice comes from prefix sums of random byte values times powers of an odd base; a finaliser
mixes it with the slice's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of texts; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, to, data[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        row = to


def _powers(n: int, held: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n; only tables for common sizes stay."""
    if len(held[0]) >= n:
        return held[0], held[1]
    size = max(n, 2 * RUN_BYTES)
    up, down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
    for a in (up, down):
        a[0] = 1
        np.cumprod(a, out=a)
    if size <= 4 * RUN_BYTES:
        held[:] = [up, down]
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of slices of data."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of bytes that are not blank, within one text."""
    inside = ~BLANK[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the pieces between newlines; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.arange(len(offsets) - 1)
    at = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    row_s, row_e = np.concatenate([rows, at]), np.concatenate([rows, at])
    a, b = np.lexsort((starts, row_s)), np.lexsort((ends, row_e))
    return starts[a], ends[b], row_s[a]


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words within a text, and the first word of each."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, factor = np.zeros(n, np.uint64), 1
    for k in range(width):
        out += h[k : k + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mixed(out[at]), at
