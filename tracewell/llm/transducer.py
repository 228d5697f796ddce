"""Minimal acyclic transducers: sorted terms to their ordinals and back.

States with the same future are one state, so common endings are stored once. Every arc carries how many terms come
before those through it; a term's ordinal is the sum over its path. Terms are byte strings.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """``key`` holds the arcs as ``state * 256 + byte`` in ascending order, ``target`` and ``skip`` their target states
    and counts; ``final`` marks accepting states, ``terms`` counts the terms. State 0 is the root."""

    def __init__(self, key: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray, terms: int):
        self.key, self.target, self.skip, self.final, self.terms = key, target, skip, final, terms
        self.first = np.searchsorted(key, np.arange(len(final) + 1, dtype=np.int64) << 8)

    def to_bytes(self) -> bytes:
        parts = (self.key.astype(np.int64), self.target.astype(np.int32), self.skip.astype(np.int32), self.final.astype(np.uint8))
        head = np.array([self.terms, len(self.key), len(self.final)], dtype=np.int64)
        return b"".join([head.tobytes(), *(p.tobytes() for p in parts)])

    @classmethod
    def from_bytes(cls, data: bytes) -> "Transducer":
        terms, arcs, states = np.frombuffer(data, dtype=np.int64, count=3).tolist()
        at, parts = 24, []
        for kind, count in ((np.int64, arcs), (np.int32, arcs), (np.int32, arcs), (np.uint8, states)):
            parts.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += count * np.dtype(kind).itemsize
        return cls(parts[0], parts[1], parts[2], parts[3].astype(bool), terms)

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each of the byte strings ``data[start:end]``, -1 where it is not a term. All of them go one
        byte further at a time."""
        found = np.full(len(start), -1, dtype=np.int64)
        live, at = np.arange(len(start)), start.astype(np.int64)
        state, total = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        while len(live):
            done = at == end[live]
            if done.any():
                here = live[done]
                found[here] = np.where(self.final[state[done]], total[done], -1)
                live, at, state, total = live[~done], at[~done], state[~done], total[~done]
            if not len(live) or not len(self.key):
                break
            want = (state << 8) | data[at]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[arc] == want
            arc = arc[ok]
            live, at = live[ok], at[ok] + 1
            total = total[ok] + self.skip[arc]
            state = self.target[arc].astype(np.int64)
        return found

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal below ``terms``."""
        out, state = bytearray(), 0
        while not (self.final[state] and ordinal == 0):
            lo, hi = int(self.first[state]), int(self.first[state + 1])
            arc = lo + int(np.searchsorted(self.skip[lo:hi], ordinal, side="right")) - 1
            ordinal -= int(self.skip[arc])
            out.append(int(self.key[arc] & 255))
            state = int(self.target[arc])
        return bytes(out)


def build(terms: Iterable[bytes]) -> Transducer:
    """From distinct terms in ascending order of their bytes, one at a time: what a term does not share with the next is
    finished, and a finished state that equals an earlier one becomes it."""
    # a state under construction: [final, [[byte, target], ...]]; a finished one: its number in ``states``
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    number: dict[tuple, int] = {}
    path: list[list] = [[False, []]]
    previous, count = b"", 0

    def finish(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            made = (final, tuple(map(tuple, arcs)))
            if made not in number:
                number[made] = len(states)
                states.append(made)
            path[-1][1][-1][1] = number[made]

    for term in terms:
        shared, most = 0, min(len(previous), len(term))
        while shared < most and previous[shared] == term[shared]:
            shared += 1
        finish(shared)
        for byte in term[shared:]:
            path[-1][1].append([byte, -1])
            path.append([False, []])
        path[-1][0] = True
        previous, count = term, count + 1
    finish(0)
    states.append((path[0][0], tuple(map(tuple, path[0][1]))))

    # targets come before the states that lead to them
    held = [0] * len(states)
    key, target, skip = [], [], []
    root = len(states) - 1
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        at = root - s  # the root becomes 0
        for byte, to in arcs:
            key.append((at << 8) | byte)
            target.append(root - to)
            skip.append(before)
            before += held[to]
        held[s] = before
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    final = np.array([f for f, _ in reversed(states)], dtype=bool)
    return Transducer(
        np.array(key, dtype=np.int64)[order], np.array(target, dtype=np.int64)[order],
        np.array(skip, dtype=np.int64)[order], final, count)
