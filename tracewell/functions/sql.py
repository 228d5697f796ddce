"""Spark SQL expression text.

Operators build each projection as one SQL expression and hand it to ``F.expr``. A scan's
expressions have thousands of nodes (rules times checks); as text they are parsed in one call,
while Column objects would cross to the JVM once per node.

Every helper takes and returns expression text.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

Sql = str
_numbers = itertools.count()


def check_session(spark) -> None:
    """Expression text relies on how literals are read."""
    if str(spark.conf.get("spark.sql.parser.escapedStringLiterals", "false")).lower() == "true":
        raise ValueError("spark.sql.parser.escapedStringLiterals must be false: it changes every literal of a scan")


def text(value: str) -> Sql:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> Sql:
    return f"{float(value)!r}D"


def _var() -> str:
    return f"v{next(_numbers)}"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and use it many times in ``body``."""
    v = _var()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def interpreted(expression: Sql) -> Sql:
    """The same value from Spark's expression interpreter. Hundreds of tests on one row outgrow a
    generated method (64 KB); lambda bodies are not compiled into one."""
    return let("0", lambda _: expression)


def transform(items: Sql, body: Callable[[Sql], Sql]) -> Sql:
    v = _var()
    return f"transform({items}, {v} -> {body(v)})"


def where(items: Sql, test: Callable[[Sql], Sql]) -> Sql:
    v = _var()
    return f"filter({items}, {v} -> {test(v)})"


def fold(items: Sql, start: Sql, step: Callable[[Sql, Sql], Sql], finish: Callable[[Sql], Sql]) -> Sql:
    acc, x, done = _var(), _var(), _var()
    return f"aggregate({items}, {start}, ({acc}, {x}) -> {step(acc, x)}, {done} -> {finish(done)})"


def struct(**fields: Sql) -> Sql:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def case(*branches: tuple[Sql, Sql], default: Sql | None = None) -> Sql:
    if not branches:
        return default or "NULL"
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"(CASE {whens} END)" if default is None else f"(CASE {whens} ELSE {default} END)"


def any_of(tests: Iterable[Sql]) -> Sql:
    tests = list(tests)
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def all_of(tests: Iterable[Sql]) -> Sql:
    tests = list(tests)
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def is_in(c: Sql, values: Iterable[str]) -> Sql:
    values = list(values)
    return f"({c} IN ({', '.join(map(text, values))}))" if values else "false"


def array(values: Iterable[Sql], type_if_empty: str) -> Sql:
    values = list(values)
    return f"array({', '.join(values)})" if values else f"CAST(array() AS array<{type_if_empty}>)"


def present(values: Iterable[Sql], type_if_empty: str) -> Sql:
    """An array of the values that are not null."""
    values = list(values)
    return f"array_compact({array(values, type_if_empty)})" if values else array([], type_if_empty)


def contains(c: Sql, token: str) -> Sql:
    return f"contains({c}, {text(token)})"


def first(items: Sql) -> Sql:
    return f"try_element_at({items}, 1)"
