"""Patterns that only Python can say: a second evaluator, beside Spark's regex functions.

Lines that hold none of the literals a pattern needs stay in the JVM; the others go to Python in Arrow batches. What was
found is a column, which the expressions of a scan look up like any other test. A scan without such patterns has no Python.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.regex import Line, folds, may_match, needs_python, with_line
from tracewell.functions.sql import Sql, any_of, case, struct, transform, where

# Workers need not have this package: what runs there is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Pattern = tuple[str, bool]  # and whether case is ignored


def only_python(patterns) -> list[Pattern]:
    """Those of ``(pattern, ignore_case)`` without a Java spelling, each once."""
    return [p for p in dict.fromkeys(patterns) if needs_python(*p)]


def _guard(line: Line, patterns: list[Pattern]) -> Sql:
    guards = [may_match(line, *p) for p in patterns]
    return "true" if None in guards else any_of(guards)


def _compiled(patterns: list[Pattern]) -> list[re.Pattern]:
    return [re.compile(p, re.IGNORECASE if ignore else 0) for p, ignore in patterns]


def _of_files(patterns: list[Pattern]):
    @F.pandas_udf("array<array<int>>")
    def found(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = _compiled(patterns)
        for part in rows:
            yield pd.Series([[[x["no"] for x in lines if c.search(x["text"])] for c in compiled] for lines in part], dtype=object)

    return found


def _of_lines(patterns: list[Pattern]):
    @F.pandas_udf("array<int>")
    def found(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = _compiled(patterns)
        for part in rows:
            yield pd.Series([[] if t is None else [i for i, c in enumerate(compiled) if c.search(t)] for t in part], dtype=object)

    return found


def with_found_lines(files: DataFrame, field: str, patterns: list[Pattern]) -> tuple[DataFrame, Callable[[Sql], Callable]]:
    """Adds, for each pattern, the numbers of the ``kept`` lines in whose ``field`` (``code`` or ``raw``) it is found. The second
    result makes the look-up for a line, given its number."""
    if not patterns:
        return files, lambda number: None
    column = f"_python_{field}"
    tested = where("kept", lambda x: with_line(f"{x}.{field}", lambda line: _guard(line, patterns)))
    sent = transform(tested, lambda x: struct(no=f"{x}.line_no", text=f"{x}.{field}"))
    place = {p: i for i, p in enumerate(patterns)}
    look_up = lambda number: lambda pattern, ignore: f"array_contains({column}[{place[pattern, ignore]}], {number})"
    return files.withColumn(column, _of_files(patterns)(F.expr(sent))), look_up


def with_found(rows: DataFrame, patterns: list[Pattern], line: Line) -> tuple[DataFrame, Line]:
    """For one line a row: the rows with what Python found, and the line with the look-up."""
    if not patterns:
        return rows, line
    place = {p: i for i, p in enumerate(patterns)}
    sent = F.expr(case((_guard(line, patterns), line.text)))
    look_up = lambda pattern, ignore: f"array_contains(_python, {place[pattern, ignore]})"
    return rows.withColumn("_python", _of_lines(patterns)(sent)), Line(line.text, line.lower, line.folds, look_up)
