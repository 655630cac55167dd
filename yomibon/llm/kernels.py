"""Vectorised helpers for text in Arrow batches: lower-casing, words, word hashes and shingles on UTF-8 bytes.

The word class splits at ASCII bytes only, so bytes decide it: digits, letters and all bytes from
0x80 on are part of words. Texts are taken in pieces of about `PIECE` bytes to bound the memory that
the arrays take; a longer text is a piece by itself, never cut. What they took is given back to the
system at the end of a task, as workers live on (`tidy`).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import worker_cache

#: Bytes of text at a time; the arrays of words and shingles take about fifty times as much.
PIECE = 1 << 19

_bytes = np.arange(256)
LOWERED = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
IN_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
#: An odd multiplier, for polynomial hashes modulo 2**64.
RADIX = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Gives Arrow's and the C library's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def tidy(run: Callable) -> Callable:
    """The task function; before it the memos that other stages left in the worker go, and after its last batch free
    memory goes back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in list(worker_cache().values()):
            if hasattr(kept, "forget"):
                kept.forget()
        yield from run(batches)
        release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `size` bytes; a null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    inside = IN_WORD[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = lowered[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(int(lengths.max()), RADIX), dtype=np.uint64)))
    return mix(np.add.reduceat(values * powers[within], firsts) + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of `size` words of a row; a row of fewer words, but not none, is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, rows
    whole = np.zeros(n, bool)
    if n >= size:
        whole[: n - size + 1] = rows[: n - size + 1] == rows[size - 1 :]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = rows[1:] != rows[:-1]
    short = first & ~whole
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        part = np.zeros(n, np.uint64)
        part[: n - k] = hashes[k:] * np.uint64(pow(int(RADIX), k, 1 << 64))
        if k:
            other = np.ones(n, bool)
            other[: n - k] = rows[: n - k] != rows[k:]
            part[other] = 0
        total += part
    taken = whole | short
    return mix(total[taken]), rows[taken]


def grouped(rows: np.ndarray, n: int) -> np.ndarray:
    """The bounds of each row's run in sorted `rows`: n + 1 offsets."""
    return np.searchsorted(rows, np.arange(n + 1))
