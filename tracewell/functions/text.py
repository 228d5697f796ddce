"""Text helpers as SQL expression text."""

from __future__ import annotations

from collections.abc import Callable

from tracewell.functions.sql import Sql, case, contains, fold, let, struct, text
from tracewell.options import TRUNCATION_MARK

# The code points str.strip() takes away.
_BLANK_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
BLANKS = "".join(chr(c) for low, high in _BLANK_RANGES for c in range(low, high + 1))


def lstrip(c: Sql) -> Sql:
    return f"trim(LEADING {text(BLANKS)} FROM {c})"


def rstrip(c: Sql) -> Sql:
    return f"trim(TRAILING {text(BLANKS)} FROM {c})"


def strip(c: Sql) -> Sql:
    return f"trim(BOTH {text(BLANKS)} FROM {c})"


def has_text(c: Sql) -> Sql:
    return f"({lstrip(c)} <> '')"


def truncate(c: Sql, limit: int) -> Sql:
    cut = lambda t: case(
        (f"length({t}) > {limit}", f"concat(substring({t}, 1, {limit}), {text(TRUNCATION_MARK)})"), default=t
    )
    return let(c, cut)


def occurrences(c: Sql, token: str) -> Sql:
    """Non-overlapping occurrences of an ASCII literal."""
    gap = f"(octet_length({c}) - octet_length(replace({c}, {text(token)}, '')))"
    count = gap if len(token) == 1 else f"({gap} div {len(token)})"
    return case((contains(c, token), f"CAST({count} AS INT)"), default="0")


def csv_value(c: Sql, limit: int | None = None, remove_line_feed: bool = True) -> Sql:
    """Quote one value for the ``;`` report. The cut counts the doubled quotes."""
    doubled = f"""replace(coalesce({c}, ''), '"', '""')"""
    if remove_line_feed:
        doubled = f"translate({doubled}, {text(chr(10) + chr(13))}, '  ')"

    def quote(t: Sql) -> Sql:
        cut = t if limit is None else truncate(t, limit)
        return case((f"{t} = ''", "''"), default=f"""concat('"', {cut}, '"')""")

    return let(strip(doubled), quote)


def split_lines(c: Sql) -> Sql:
    """Universal newlines; a final newline starts no further line and '' has no line."""
    unix = case((contains(c, "\r"), f"regexp_replace({c}, {text(chr(13) + chr(10) + '?')}, {text(chr(10))})"), default=c)
    newline = text("\n")
    whole = lambda t: case(
        (f"endswith({t}, {newline})", f"substring({t}, 1, length({t}) - 1)"), default=t
    )
    lines = f"split({let(unix, whole)}, {newline})"
    return case((f"{c} = ''", "CAST(array() AS array<string>)"), default=lines)


def decode_text(content: Sql) -> Sql:
    """UTF-8 for the whole value, or else Latin-1 for the whole value."""
    return case(
        (f"is_valid_utf8(CAST({content} AS STRING))", f"decode({content}, 'UTF-8')"),
        default=f"decode({content}, 'ISO-8859-1')",
    )


def prefix_length(
    items: Sql, weight: Callable[[Sql], Sql], max_items: int, max_weight: int, items_before: Sql = "0", weight_before: Sql = "0L"
) -> Sql:
    """How many leading items fit: one fits while fewer than ``max_items`` items and less than
    ``max_weight`` came before it. A single fold, so it is linear in the array."""
    return fold(
        items,
        struct(n=items_before, w=weight_before),
        lambda acc, x: case(
            (
                f"{acc}.n < {max_items} AND {acc}.w < {max_weight}",
                struct(n=f"{acc}.n + 1", w=f"{acc}.w + {weight(x)}"),
            ),
            default=acc,
        ),
        lambda acc: f"{acc}.n" if items_before == "0" else f"{acc}.n - {items_before}",
    )
