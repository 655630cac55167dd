"""Offsets across two versions of a text: equal runs by rare anchors and, between these, a longest common subsequence.

A text pair of any length is aligned in whole: pieces that stand once in both versions anchor long texts, so that their
cost is near linear; what is left between anchors is aligned exactly, in rows of bits. Parts without an anchor that are
too large for their rows to be kept are halved, each half being aligned with the part of the other text that goes with
it best, so memory stays linear and no part is given up.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np

#: Cells up to which the rows of bits are kept (an eighth of a byte each); larger parts are anchored or halved.
CELLS = 1 << 22
#: Lengths of the pieces that are looked for as anchors, the longest first.
PIECES = (32, 12)
BASE = np.uint64(0x9E3779B97F4A7C15)


class OffsetMap(NamedTuple):
    """Equal runs of two texts in ascending order: run i is source[a[i] : a[i] + n[i]] and target[b[i] : b[i] + n[i]]."""

    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    source: int
    target: int

    @property
    def changes(self) -> int:
        """Characters that go plus characters that come."""
        return self.source + self.target - 2 * int(self.n.sum())

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds in the source and in the target of all pieces, equal and changed ones by turns, and which are equal."""
        ends = np.stack([self.a, self.a + self.n], axis=1).ravel(), np.stack([self.b, self.b + self.n], axis=1).ravel()
        at = [np.concatenate([[0], x, [size]]) for x, size in zip(ends, (self.source, self.target), strict=True)]
        return at[0], at[1], np.arange(len(at[0]) - 1) % 2 == 1

    def mapped(self, offsets) -> np.ndarray:
        """Offsets in the target -> offsets in the source: equal pieces one to one, changed ones in proportion. An offset
        between two pieces belongs to the first; those outside the target map to the source's ends."""
        at = np.asarray(offsets, dtype=np.int64)
        src, tgt, equal = self.pieces()
        i = np.minimum(np.searchsorted(tgt[1:], at, side="left"), len(equal) - 1)
        low, a, b = tgt[i], src[i], src[i + 1]
        width = np.maximum(tgt[i + 1] - low, 1)
        spread = np.rint(a + (at - low) / width * (b - a)).astype(np.int64)
        found = np.where(equal[i], a + at - low, np.clip(spread, a, b))
        return np.where(at <= 0, 0, np.where(at > self.target, self.source, found))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements are the same, in doubling steps."""
    size, done, step = min(len(x), len(y)), 0, 64
    while done < size:
        end = min(size, done + step)
        other = np.flatnonzero(x[done:end] != y[done:end])
        if len(other):
            return done + int(other[0])
        done, step = end, step * 2
    return size


def hashed(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each piece of so many elements."""
    places = len(x) - size + 1
    found = np.zeros(places, dtype=np.uint64)
    for k in range(size):
        found = found * BASE + x[k : k + places]
    return found


def longest_rise(values: np.ndarray) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values.tolist()):
        k = bisect_left(tails, value)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1] = [value]
        ends[k : k + 1] = [i]
    found, i = [], ends[-1] if ends else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def anchors(x: np.ndarray, y: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Equal runs (a, b, n) in the order of both texts, of pieces that each text has once; neighbouring pieces are one run."""
    if min(len(x), len(y)) < size:
        return []
    once = []
    for text in (x, y):
        value, first, count = np.unique(hashed(text, size), return_index=True, return_counts=True)
        once.append((value[count == 1], first[count == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    a, b = once[0][1][i], once[1][1][j]
    order = np.argsort(a)
    a, b = a[order], b[order]
    for k in range(size):  # equal hashes are checked
        same = x[a + k] == y[b + k]
        a, b = a[same], b[same]
    chain = longest_rise(b)
    a, b = a[chain], b[chain]
    found: list[tuple[int, int, int]] = []
    breaks = np.flatnonzero((np.diff(a) > size) | (np.diff(a - b) != 0)) + 1
    for part in np.split(np.arange(len(a)), breaks) if len(a) else []:
        at, to, n = int(a[part[0]]), int(b[part[0]]), int(a[part[-1]] - a[part[0]]) + size
        if found:  # runs of other shifts may overlap: the later one begins behind the earlier one
            over = max(found[-1][0] + found[-1][2] - at, found[-1][1] + found[-1][2] - to, 0)
            at, to, n = at + over, to + over, n - over
        if n > 0:
            found.append((at, to, n))
    return found


def rows_of(x: np.ndarray, y: np.ndarray, keep: bool) -> list[int]:
    """Rows of bits, one for each element of x (or the last row alone): where a row has a zero, the longest common
    subsequence of x so far with y grows by that element of y."""
    places: dict[int, int] = {}
    values, where = np.unique(y, return_inverse=True)
    for k, value in enumerate(values.tolist()):
        places[value] = int.from_bytes(np.packbits(where == k, bitorder="little").tobytes(), "little")
    full = (1 << len(y)) - 1
    row, rows = full, []
    for value in x.tolist():
        hit = row & places.get(value, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def growth(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each beginning of y, the empty one first."""
    row = rows_of(x, y, keep=False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def traced(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal runs of a longest common subsequence, by walking its rows back."""
    width = len(y) // 8 + 1
    rows = [(1 << len(y)) - 1, *rows_of(x, y, keep=True)]
    rows = [row.to_bytes(width, "little") for row in rows]
    i, j, found = len(x), len(y), []
    while i and j:
        byte, bit = (j - 1) >> 3, (j - 1) & 7
        if rows[i][byte] >> bit & 1:
            j -= 1
        elif not rows[i - 1][byte] >> bit & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j, 1))
    return found[::-1]


def aligned(source: str, target: str) -> OffsetMap:
    """The equal runs of two versions of a text."""
    x, y = codes(source), codes(target)
    runs: list[tuple[int, int, int]] = []
    parts = [(0, len(x), 0, len(y), 0)]  # bounds in both texts and the next length of pieces
    while parts:
        a, a_end, b, b_end, level = parts.pop()
        n = common(x[a:a_end], y[b:b_end])
        if n:
            runs.append((a, b, n))
            a, b = a + n, b + n
        n = common(x[a:a_end][::-1], y[b:b_end][::-1])
        if n:
            a_end, b_end = a_end - n, b_end - n
            runs.append((a_end, b_end, n))
        if a == a_end or b == b_end:
            continue
        own, other = x[a:a_end], y[b:b_end]
        if len(own) == 1 or len(own) * len(other) <= CELLS:
            runs += [(a + i, b + j, k) for i, j, k in traced(own, other)]
        elif level < len(PIECES):
            last = (a, b)
            for i, j, k in anchors(own, other, PIECES[level]):
                runs.append((a + i, b + j, k))
                parts.append((last[0], a + i, last[1], b + j, level))
                last = (a + i + k, b + j + k)
            found = last != (a, b)
            parts.append((last[0], a_end, last[1], b_end, level if found else level + 1))
        else:
            half = len(own) // 2
            cut = int(np.argmax(growth(own[:half], other) + growth(own[half:][::-1], other[::-1])[::-1]))
            parts += [(a, a + half, b, b + cut, level), (a + half, a_end, b + cut, b_end, level)]
    return merged(runs, len(x), len(y))


def merged(runs: list[tuple[int, int, int]], source: int, target: int) -> OffsetMap:
    """Runs in order, those that go on where the one before ends being one."""
    rows = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
    a, b, n = rows.T
    goes_on = (a[1:] == a[:-1] + n[:-1]) & (b[1:] == b[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate([[True] * bool(len(a)), ~goes_on]))
    return OffsetMap(a[first], b[first], np.add.reduceat(n, first) if len(first) else n, source, target)
