"""Search of texts for many plain patterns at once, vectorised over the bytes of Arrow columns.

Every pattern is filed under one window of its bytes (a gram); a gram found in a text says where the pattern would begin, and
its bytes are compared there. A text is so read once, whatever its length and the number of patterns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers need not have this package: what runs there is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 1 << 20  # bytes whose grams are held at once
BITS = 18
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of ``n`` bytes."""
    out = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
    for k in range(n):
        out *= FACTOR
        out += data[k : k + len(out)]
        out += np.uint64(1)
    return out


def _filter_place(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * FACTOR) >> np.uint64(64 - BITS)


class Grams:
    """Patterns, each filed under that of its ``n``-byte windows that fewest patterns share; shorter ones under themselves."""

    def __init__(self, patterns: list[str], n: int):
        held = [p.encode() for p in patterns]
        self.data = np.frombuffer(b"".join(held), np.uint8)
        self.size = np.array([len(p) for p in held], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.at = np.zeros(len(held), dtype=np.int64)  # of its gram in the pattern
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(np.minimum(self.size, n)).tolist():
            mine = np.flatnonzero(self.size == width if width < n else self.size >= n)
            many = self.size[mine] - width + 1
            owner = np.repeat(mine, many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hashes = gram_hashes(self.data, width)[self.first[owner] + at]
            _, of, shared = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.lexsort((at, shared[of], owner))
            rarest = order[np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1]))]
            self.at[owner[rarest]] = at[rarest]
            rarest = rarest[np.argsort(hashes[rarest], kind="stable")]
            grams, first = np.unique(hashes[rarest], return_index=True)
            passes = np.zeros(1 << BITS, dtype=bool)
            passes[_filter_place(grams)] = True
            self.tables.append((width, grams, np.append(first, len(rarest)), owner[rarest], passes))

    def found(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and pattern, each pair once, of all patterns in the rows of a column."""
        pairs = [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(data), STEP):
            for width, grams, first, owner, passes in self.tables:
                hashes = gram_hashes(data[lo : lo + STEP + width - 1], width)
                at = np.flatnonzero(passes[_filter_place(hashes)])
                place = np.minimum(np.searchsorted(grams, hashes[at]), len(grams) - 1)
                known = grams[place] == hashes[at]
                at, place = at[known] + lo, place[known]
                many = first[place + 1] - first[place]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pattern, at = owner[np.repeat(first[place], many) + nth], np.repeat(at, many)
                row = np.searchsorted(offsets, at, side="right") - 1
                begin = at - self.at[pattern]
                inside = (begin >= offsets[row]) & (begin + self.size[pattern] <= offsets[row + 1])
                row, pattern, begin = row[inside], pattern[inside], begin[inside]
                equal = self._equal(data, begin, pattern)
                pairs.append(np.unique(row[equal] * len(self.size) + pattern[equal]))
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.size)))

    def _equal(self, data: np.ndarray, begin: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Which patterns stand where they would begin, a byte of all of them at a time."""
        left, k, equal = np.arange(len(begin)), 0, []
        while len(left):
            left = left[data[begin[left] + k] == self.data[self.first[pattern[left]] + k]]
            k += 1
            whole = self.size[pattern[left]] == k
            equal.append(left[whole])
            left = left[~whole]
        return np.concatenate(equal) if equal else left


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a text column; null reads as empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], held


def search(filed, names: list[str]):
    """For ``mapInArrow``: of rows whose last column is the text, the other columns and each pattern in it. ``filed`` is a broadcast of
    patterns and their ``Grams``."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, grams = filed.value
        patterns = pa.array(patterns, pa.string())
        for batch in batches:
            row, pattern = grams.found(*text_bytes(batch.column(len(names) - 1)))
            kept = [c.take(pa.array(row)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, patterns.take(pa.array(pattern))], names)

    return searched
