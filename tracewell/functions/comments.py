"""Comment stripping for one line, and the masks that carry comment state across lines.

A line is a struct ``(line_no, raw, code)``. Each dialect is given as

* ``*_code(raw, code)``: the line once its comments are cut, '' when nothing is left, and
* ``*_symbol(code)``: one letter telling what the line does to the comment state.

The letters of a file form a short string, one per line, in which a stretch of comment is a
plain regular expression. That keeps multi-line state inside the file's own row: no window,
no sort, no exchange.
"""

from __future__ import annotations

from tracewell.functions.sql import Sql, any_of, case, contains, let, struct, text, transform
from tracewell.functions.text import lstrip, occurrences, rstrip

# A '#' that no complete quoted piece covers. Possessive, so long lines do not recurse.
_HASH_OUTSIDE_QUOTES = r"""(?s)\A((?:[^'"#]++|'[^']*+'|"[^"]*+")*+)#.*\z"""
_TRIPLE_ON_ONE_LINE = r"""(?s)("{3}|'{3}).*?\1"""
_BLOCK_ON_ONE_LINE = r"(?s)/\*.*?\*/"


def cut_hash(code: Sql) -> Sql:
    rx = text(_HASH_OUTSIDE_QUOTES)
    return case(
        (f"{contains(code, '#')} AND rlike({code}, {rx})", rstrip(f"regexp_extract({code}, {rx}, 1)")), default=code
    )


def _starts_with_hash(raw: Sql) -> Sql:
    return f"startswith({lstrip(raw)}, '#')"


def shell_code(raw: Sql, code: Sql) -> Sql:
    return case((_starts_with_hash(raw), "''"), default=cut_hash(code))


def _has_triple(code: Sql) -> Sql:
    return any_of([contains(code, '"""'), contains(code, "'''")])


def python_code(raw: Sql, code: Sql) -> Sql:
    pair = any_of([f"({contains(code, q)} AND {occurrences(code, q)} >= 2)" for q in ('"""', "'''")])
    inline = case((pair, f"regexp_replace({code}, {text(_TRIPLE_ON_ONE_LINE)}, '')"), default=code)
    return case((_starts_with_hash(raw), "''"), default=let(inline, cut_hash))


def python_symbol(code: Sql) -> Sql:
    """n: nothing, d / s: flips the double / single triple-quote state, b: flips both."""
    counts = struct(d=f"{occurrences(code, chr(34) * 3)} % 2 = 1", s=f"{occurrences(code, chr(39) * 3)} % 2 = 1")
    symbol = lambda n: case((f"{n}.d AND {n}.s", "'b'"), (f"{n}.d", "'d'"), (f"{n}.s", "'s'"), default="'n'")
    return case((_has_triple(code), let(counts, symbol)), default="'n'")


def _without_blocks(code: Sql) -> Sql:
    # without a closing mark the expression would try every opening one in vain
    both = f"{contains(code, '/*')} AND {contains(code, '*/')}"
    return case((both, f"regexp_replace({code}, {text(_BLOCK_ON_ONE_LINE)}, '')"), default=code)


def block_code(raw: Sql, code: Sql) -> Sql:
    return f"substring_index({_without_blocks(code)}, '//', 1)"


def block_symbol(code: Sql) -> Sql:
    """n: nothing, o: opens a block, c: closes one, b: has both."""
    opens, closes = contains(_without_blocks(code), "/*"), contains(code, "*/")
    marks = struct(o=f"({contains(code, '/*')} AND {opens})", c=closes)
    return let(marks, lambda m: case((f"{m}.o AND {m}.c", "'b'"), (f"{m}.o", "'o'"), (f"{m}.c", "'c'"), default="'n'"))


def _runs_to_mask(symbols: Sql, run: str, hidden: str) -> Sql:
    """Cut ``symbols`` into runs; '1' for every line in a run's ``hidden`` part, '0' elsewhere."""

    def mask(r: Sql) -> Sql:
        count = f"length(regexp_extract({r}, {text(hidden)}, 0))"
        return let(count, lambda n: f"concat(repeat('1', {n}), repeat('0', length({r}) - {n}))")

    runs = f"regexp_extract_all({symbols}, {text(run)}, 0)"
    return f"split(array_join({transform(runs, mask)}, ''), '')"


def _going_on(symbols: Sql, inside: Sql | None, opener: str, mask) -> Sql:
    """The mask of lines that may begin inside a comment: as if a line had opened it before them."""
    if inside is None:
        return mask(symbols)
    opened = f"concat('{opener}', {symbols})"
    return case((inside, f"slice({mask(opened)}, 2, length({symbols}))"), default=mask(symbols))


def block_mask(symbols: Sql, inside: Sql | None = None) -> Sql:
    """An opening line hides itself and all up to and including the next line that closes."""
    hidden = "[ob][on]*+[bc]?"
    return _going_on(symbols, inside and f"{inside}.b", "o", lambda s: _runs_to_mask(s, f"{hidden}|[nc]++", f"^{hidden}"))


def python_mask(symbols: Sql, inside: Sql | None = None) -> Sql:
    """A line is hidden while either state is on after it; the line that ends both shows."""
    double = _going_on(symbols, inside and f"{inside}.d", "d", lambda s: _runs_to_mask(s, "[db][ns]*+[db]?|[ns]++", "^[db][ns]*+"))
    single = _going_on(symbols, inside and f"{inside}.s", "s", lambda s: _runs_to_mask(s, "[sb][nd]*+[sb]?|[nd]++", "^[sb][nd]*+"))
    return f"zip_with({double}, {single}, (d, s) -> greatest(d, s))"


# What lines do to the comment state, for lines that come after others: whether a block comment is open after them if none
# was before (``open``) and if one was (``still``), and whether they flip the triple-quote states (``d``, ``s``).
NO_CHANGE = struct(open="false", still="true", d="false", s="false")


def block_change(symbols: Sql) -> Sql:
    closed = "(?:[ob][on]*+[bc]|[nc]++)*+[ob][on]*+"
    return struct(
        open=f"rlike({symbols}, '^{closed}$')", still=f"rlike({symbols}, '^[on]*+(?:[bc]{closed})?$')", d="false", s="false")


def python_change(symbols: Sql) -> Sql:
    odd = lambda letters: f"(length({symbols}) - length(translate({symbols}, '{letters}', ''))) % 2 = 1"
    return struct(open="false", still="true", d=odd("db"), s=odd("sb"))


def symbols_of(lines: Sql) -> Sql:
    return f"array_join({transform(lines, lambda x: f'{x}.sym')}, '')"
