"""String literals of a text that comes in chunks.

A literal is ``'…'`` or ``"…"``, found from left to right; it may span chunks, and a quote that nothing closes is passed over.
Where a chunk begins is not known when it is read, so its summary says what it holds in each of three cases: outside
literals, inside a single-quoted and inside a double-quoted one. ``Literals`` takes summaries in order.

An opened literal may turn out never to be closed. Then no quote of its kind follows, and what counts is pairs of the
other kind after it; those are counted along while it is open.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Workers need not have this package: what runs there is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUOTES = re.compile("['\"]")
_OTHER = {"'": '"', '"': "'"}


def _tail(at: list[int], begin: int, end: int, limit: int) -> dict:
    """Quotes of one kind in ``[begin, end)``: how many, the first and the last, and short pairs from the first or the second on."""
    at = [x - begin for x in at if x >= begin]
    short = [sum(b - a < limit for a, b in zip(at[i::2], at[i + 1 :: 2])) for i in (0, 1)]
    return {"k": len(at), "first": at[0] if at else None, "last": at[-1] if at else None, "short": short, "size": end - begin}


def summary(text: str, limit: int) -> str:
    """What a chunk holds for each way it may begin; literals of up to ``limit`` characters are short."""
    found = [(m.start(), m.group()) for m in _QUOTES.finditer(text)]
    places = {q: [i for i, c in found if c == q] for q in _OTHER}

    def outside(index: int) -> dict:
        n = short = 0
        opened = None
        for i, c in found[index:]:
            if opened is None:
                opened = (i, c)
            elif c == opened[1]:
                n += 1
                short += i - opened[0] < limit
                opened = None
        if opened is None:
            return {"n": n, "short": short, "mode": None}
        return {"n": n, "short": short, "mode": opened[1], "tail": _tail(places[_OTHER[opened[1]]], opened[0], len(text), limit)}

    cases = {"": {"closes": 0, "then": outside(0)}}
    for quote in _OTHER:
        index = next((k for k, (_, c) in enumerate(found) if c == quote), None)
        if index is None:
            cases[quote] = {"closes": None, "tail": _tail(places[_OTHER[quote]], 0, len(text), limit)}
        else:
            cases[quote] = {"closes": found[index][0] + 1, "then": outside(index + 1)}
    return json.dumps(cases)


class Literals:
    """Counts over chunks in order, as if they were one text joined by single line feeds."""

    def __init__(self, limit: int):
        self.limit, self.n, self.short = limit, 0, 0
        self.mode, self.held, self.chunks = None, 0, 0
        self.k = self.pairs = self.short_pairs = self.since = 0

    def add(self, chunk: str) -> None:
        cases = json.loads(chunk)
        if self.chunks:  # the line feed between
            self.held += 1
            self.since += 1
        self.chunks += 1
        case = cases[self.mode or ""]
        if case["closes"] is None:
            self._go_on(case["tail"])
            self.held += case["tail"]["size"]
            return
        if self.mode:
            self.n += 1
            self.short += self.held + case["closes"] <= self.limit
        then = case["then"]
        self.n += then["n"]
        self.short += then["short"]
        self.mode = then["mode"]
        self.k = self.pairs = self.short_pairs = self.since = 0
        if self.mode:
            self.held = then["tail"]["size"]
            self._go_on(then["tail"])

    def _go_on(self, tail: dict) -> None:
        """Quotes of the other kind inside the open literal."""
        k, odd = tail["k"], self.k % 2
        if odd and k:
            self.pairs += 1
            self.short_pairs += self.since + tail["first"] + 1 <= self.limit
        elif odd:
            self.since += tail["size"]
        rest = k - odd if k else 0
        self.pairs += rest // 2
        self.short_pairs += tail["short"][odd] if k else 0
        self.k += k
        if k and self.k % 2:
            self.since = tail["size"] - tail["last"]

    def counts(self) -> tuple[int, int]:
        """Literals and short ones."""
        if self.mode is None:
            return self.n, self.short
        return self.n + self.pairs, self.short + self.short_pairs


def summaries(limit: int):
    """A function of a column of chunks (null: none)."""

    @F.pandas_udf("string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: None if t is None else summary(t, limit))

    return of


def merged(limit: int):
    """A function of a column of a text's parts in order, ``array<struct<…, begins, ends, quotes>>``: its literals, the short ones,
    and how often a part that ``ends`` as a call does is followed by one that ``begins`` with its bracket."""

    @F.pandas_udf("literals bigint, short bigint, joins bigint")
    def of(parts: pd.Series) -> pd.DataFrame:
        out = []
        for chunks in parts:
            held, joins, before = Literals(limit), 0, False
            for p in chunks:
                held.add(p["quotes"])
                joins += bool(before and p["begins"])
                before = p["ends"]
            out.append((*held.counts(), joins))
        return pd.DataFrame(out, columns=["literals", "short", "joins"])

    return of
