"""Words, word hashes and shingle hashes of whole Arrow columns of text, vectorised.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is a
polynomial over the hashes of its bytes, a shingle's one over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = (0x20, *range(0x09, 0x0E))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (an invertible finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


class Words:
    """Words of some rows: ``first[i]:first[i + 1]`` are row i's, ``start``/``end`` their byte places
    in ``data`` (lower case), ``hash`` their 64-bit hashes; ``row0`` is the first row's number."""

    def __init__(self, row0: int, offsets: np.ndarray, data: np.ndarray, powers: "Powers", letters: np.ndarray | None = None):
        self.row0, self.rows = row0, len(offsets) - 1
        self.data = lower_table()[data]
        if letters is None:
            letters = np.ones(256, dtype=bool)
            letters[list(_SPACES)] = False
        inside = letters[self.data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = powers.upto(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(powers.byte[self.data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-word shingles in order, and each row's first. A row of fewer words has its
        whole sequence as its one shingle; a row without words has none."""
        counts = self.lengths()
        per_row = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
        first = np.zeros(self.rows + 1, dtype=np.int64)
        np.cumsum(per_row, out=first[1:])
        row = np.repeat(np.arange(self.rows), per_row)
        at = self.first[:-1][row] + np.arange(first[-1]) - first[:-1][row]
        width = np.minimum(counts, n)[row]
        value = width.astype(np.uint64)
        for k in range(n):
            word = self.hash[np.minimum(at + k, max(len(self.hash) - 1, 0))] if len(self.hash) else value
            value = np.where(k < width, mix(value * np.uint64(_BASE) + word), value)
        return value, first


class Powers:
    """Powers of the base and of its inverse, and a random value for each byte, made once per task."""

    def __init__(self):
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self._up = np.ones(1, dtype=np.uint64)
        self._down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n + 1:
            self._up, self._down = (self._row(b, n + 1) for b in (_BASE, _INVERSE))
        return self._up, self._down

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        values = np.full(n, base, dtype=np.uint64)
        values[0] = 1
        return np.multiply.accumulate(values)


def word_slices(
    column: pa.Array, powers: Powers, letters: np.ndarray | None = None, size: int = SLICE_BYTES
) -> Iterator[Words]:
    """The words of a column, some rows (about ``size`` bytes) at a time; with ``letters`` (a flag for each
    byte) words are runs of those bytes."""
    offsets, data = byte_column(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + size, side="left"))
        last = min(max(last, row + 1), rows)
        part = offsets[row : last + 1]
        yield Words(row, part - part[0], data[part[0] : part[-1]], powers, letters)
        row = last


def word_pieces(
    column: pa.Array, powers: Powers, carry: int, letters: np.ndarray | None = None, size: int = SLICE_BYTES
) -> Iterator[tuple[Words, bool]]:
    """As ``word_slices``, but a row of more than ``size`` bytes comes in pieces, cut between words. A piece that goes
    on with a row begins with the last ``carry`` words of the piece before, and is marked."""
    offsets, data = byte_column(column)
    if letters is None:
        letters = np.ones(256, dtype=bool)
        letters[list(_SPACES)] = False
    inside = letters[lower_table()]
    row, rows = 0, len(offsets) - 1
    while row < rows:
        if offsets[row + 1] - offsets[row] <= size:
            last = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
            last = min(max(last, row + 1), rows)
            part = offsets[row : last + 1]
            yield Words(row, part - part[0], data[part[0] : part[-1]], powers, letters), False
            row = last
            continue
        at, end, width, goes_on = int(offsets[row]), int(offsets[row + 1]), size, False
        while True:
            stop = _between_words(data, inside, min(at + width, end), end)
            words = Words(row, np.array([0, stop - at], dtype=np.int64), data[at:stop], powers, letters)
            if stop < end and len(words.start) <= carry:
                width *= 2  # too few words to go on from
                continue
            yield words, goes_on
            if stop == end:
                break
            at, width, goes_on = (at + int(words.start[-carry]) if carry else stop), size, True
        row += 1


class Shingles:
    """Shingle hashes of some rows in order: ``first[i]:first[i + 1]`` are row i's, ``row0`` is the first row's number."""

    def __init__(self, row0: int, values: np.ndarray, first: np.ndarray):
        self.row0, self.rows, self.values, self.first = row0, len(first) - 1, values, first


def shingle_slices(column: pa.Array, powers: Powers, n: int, size: int = SLICE_BYTES) -> Iterator[Shingles]:
    """The ``n``-word shingles of a column, some rows at a time. Of a long row only the hashes are held, its words piece by
    piece."""
    held: list[np.ndarray] = []
    row0 = 0
    for words, goes_on in word_pieces(column, powers, n - 1, size=size):
        values, first = words.shingles(n)
        if not goes_on and held:
            yield Shingles(row0, np.concatenate(held), np.array([0, sum(map(len, held))], dtype=np.int64))
            held = []
        if words.rows == 1:
            row0 = words.row0
            held.append(values)
        else:
            yield Shingles(words.row0, values, first)
    if held:
        yield Shingles(row0, np.concatenate(held), np.array([0, sum(map(len, held))], dtype=np.int64))


def _between_words(data: np.ndarray, inside: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on that is not within a word."""
    while at < end:
        ahead = np.flatnonzero(~inside[data[at - 1 : min(at + 4096, end)]])
        if len(ahead):
            return at + int(ahead[0])
        at += 4096
    return end


def row_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and each row's first."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((values, row))
    values = values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[fresh], minlength=rows)
    starts = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(counts, out=starts[1:])
    return values[fresh], starts


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary per row: its part of ``values``."""
    width = values.dtype.itemsize
    offsets = (first * width).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())
