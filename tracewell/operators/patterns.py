"""Plain and regular-expression indicators on kept lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewell.functions.grams import Grams, search
from tracewell.functions.python_regex import Pattern, only_python, with_found
from tracewell.functions.regex import Line, folds, matches
from tracewell.functions.sql import Sql, array, case, contains, interpreted, present, text, where
from tracewell.functions.text import strip, truncate
from tracewell.operators.hits import HIT_COLUMNS, ORIGIN_COLUMNS, hit_struct
from tracewell.options import ScanOptions
from tracewell.sources.packs import Pack, Packs

BROADCAST_BYTES = 8 << 20
ROW_BYTES = 64  # of a row besides its texts
COMPILED_TESTS = 40
FILTER_BITS = 20  # of the filter of filed grams (128 KB)
FILTER_FILL = 8  # bits for each gram at least; with fewer a filter lets too much through


def pattern_tests(line: Line, pack: Pack) -> list[Sql]:
    """One boolean per pattern, plain ones first."""
    plain = [contains(line.lower, p.lower()) for p in pack.plain]
    return plain + [matches(line, p, ignore_case=True) for p in pack.regex]


def first_match(line: Line, pack: Pack) -> Sql:
    """Index of the first pattern that matches, null if none does."""
    tests = pattern_tests(line, pack)
    return case(*[(t, str(i)) for i, t in enumerate(tests)], default="CAST(NULL AS INT)")


def every_match(line: Line, pack: Pack) -> Sql:
    """Indexes of all patterns that match."""
    return present([case((t, str(i))) for i, t in enumerate(pattern_tests(line, pack))], "int")


def by_kind(packs: Packs, build: Callable[[Pack], Sql]) -> Sql:
    """``build`` of the pack that serves the file."""
    return case(*[(f"scan_kind = {text(kind)}", build(pack)) for kind, pack in packs.by_kind().items()])


def compiled_or_not(tests: int, expression: Sql) -> Sql:
    return expression if tests <= COMPILED_TESTS else interpreted(expression)


def pattern_hit(line: Sql, index: Sql, packs: Packs, o: ScanOptions) -> Sql:
    def name(pack: Pack) -> Sql:
        return f"try_element_at({array(map(text, pack.patterns), 'string')}, {index} + 1)"

    return hit_struct(
        stage="pattern",
        hits="1",
        pattern_or_rule=by_kind(packs, name),
        type_or_severity=by_kind(packs, lambda pack: case((f"{index} < {len(pack.plain)}", "'normal'"), default="'regex'")),
        line_number=f"{line}.line_no",
        line=truncate(strip(f"{line}.raw"), o.max_line_length),
    )


def with_line_columns(lines: DataFrame, patterns: list[Pattern] = ()) -> tuple[DataFrame, Line]:
    """Adds what tests of a line share, of ``patterns`` those that need Python."""
    rows = lines.withColumns({"_lower": F.lower("code"), "_folds": F.expr(folds("code"))})
    return with_found(rows, only_python(patterns), Line("code", "_lower", "_folds"))


def regex_patterns(packs: Packs) -> list[Pattern]:
    return [(p, True) for pack in packs.by_kind().values() for p in pack.regex]


def pattern_hits(lines: DataFrame, packs: Packs, o: ScanOptions, mode: str = "first") -> DataFrame:
    """Hits on ``kept_lines``. ``first``: at most one per line, the first pattern in list order;
    ``all``: one per matching pattern."""
    rows, line = with_line_columns(lines, regex_patterns(packs))
    tests = sum(len(pack.patterns) for pack in packs.by_kind().values())
    if mode == "first":
        index = compiled_or_not(tests, by_kind(packs, lambda pack: first_match(line, pack)))
    elif mode == "all":
        index = f"explode_outer({compiled_or_not(tests, by_kind(packs, lambda pack: every_match(line, pack)))})"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    found = rows.select("path", "scope", "scan_kind", F.struct("line_no", "raw").alias("_line"), F.expr(index).alias("_i"))
    hits = found.filter("_i IS NOT NULL").select(
        F.col("path").alias("file"), "scope", F.expr(pattern_hit("_line", "_i", packs, o)).alias("h")
    )
    return hits.select("file", "scope", "h.*").select(*HIT_COLUMNS, *ORIGIN_COLUMNS)


def pattern_table_hits(
    lines: DataFrame, patterns: DataFrame, n: int = 4, broadcast_bytes: int | None = BROADCAST_BYTES
) -> DataFrame:
    """All plain matches of a pattern table too large to compile, as ``(file_id, line_no, pattern)``.

    Every pattern is filed under the one of its ``n``-grams that fewest patterns share. A pattern table of up to
    ``broadcast_bytes`` (its own size, measured; None: never) goes to the lines, which then do not move at all: grams are those of
    the bytes, and each one filed is compared where it stands, so a line costs its length (``functions.grams``).
    Otherwise candidates are pairs of a line's place and a gram under which something is filed; no text travels with them. Grams that nothing is filed under
    mostly never become rows: a bitmap of the filed grams' hashes, of fixed size, is part of the plan (unless the table has
    so many that it would be full). Candidates meet the patterns by gram, where adaptive execution splits the partitions of common
    grams, patterns are collected per line, and each line is joined once, by place, and settles them with
    ``contains``. A pattern shorter than ``n`` is filed under itself, by its length.
    """
    wanted = patterns.select("pattern", F.lower("pattern").alias("_p")).where("_p <> ''").distinct()
    texts = lines.select("file_id", "line_no", F.lower("code").alias("_lc"))
    columns = ["file_id", "line_no", "pattern"]
    if broadcast_bytes is not None:
        held = wanted.agg(F.coalesce(F.sum(F.octet_length("_p") * 2 + n + ROW_BYTES), F.lit(0))).first()[0]
        if held <= broadcast_bytes:
            rows = wanted.collect()
            filed = lines.sparkSession.sparkContext.broadcast(([r["pattern"] for r in rows], Grams([r["_p"] for r in rows], n)))
            schema = StructType([*texts.schema.fields[:2], StructField("pattern", StringType())])
            return texts.mapInArrow(search(filed, columns), schema)
    long = wanted.filter(F.length("_p") >= n).select("pattern", "_p", _grams("_p", n).alias("_g"))
    share = long.groupBy("_g").agg(F.count("*").alias("_w"))
    rarest = long.join(share, "_g").groupBy("pattern", "_p").agg(F.min_by("_g", F.struct("_w", "_g")).alias("_g"))
    filed = rarest.unionByName(wanted.filter(F.length("_p") < n).withColumn("_g", F.col("_p")))
    sizes = [r[0] for r in wanted.filter(F.length("_p") < n).select(F.length("_p")).distinct().collect()]

    passes = gram_filter(filed)
    grams = lambda *kept: texts.select(*kept, _grams("_lc", *sorted({n, *sizes}), passes=passes).alias("_g"))
    places = grams("file_id", "line_no").join(filed.select("_g", "pattern", "_p"), "_g")
    found = places.groupBy("file_id", "line_no").agg(F.collect_set(F.struct("pattern", "_p")).alias("_c"))
    met = texts.join(found, ["file_id", "line_no"])
    return met.select(
        "file_id", "line_no", F.explode(F.filter("_c", lambda c: F.contains("_lc", c["_p"]))).alias("_c")
    ).select("file_id", "line_no", F.col("_c.pattern").alias("pattern"))


def gram_filter(filed: DataFrame) -> Callable[[Sql], Sql] | None:
    """A test that all filed grams ``_g`` pass and few others; None where there are too many grams for one."""
    mask = (1 << FILTER_BITS) - 1
    place = F.xxhash64("_g").bitwiseAND(F.lit(mask))
    words = filed.select(place.alias("p")).distinct().groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"), F.count("*").alias("n")).collect()
    if sum(r["n"] for r in words) > (1 << FILTER_BITS) // FILTER_FILL:
        return None
    held = [0] * (1 << FILTER_BITS - 6)
    for r in words:
        held[r["word"]] = r["bits"]
    bitmap = f"CAST(split('{','.join(map(str, held))}', ',') AS array<bigint>)"
    word = lambda g: f"{bitmap}[CAST(shiftright(xxhash64({g}) & {mask}L, 6) AS INT)]"
    return lambda g: f"shiftright({word(g)}, CAST(xxhash64({g}) & 63L AS INT)) & 1L = 1L"


def _grams(c: str, *sizes: int, passes: Callable[[Sql], Sql] | None = None):
    """Distinct windows of the given sizes that pass, each size in one pass over the text."""
    windows = f"concat({', '.join(f'regexp_extract_all({c}, {text(f"(?s)(?=(.{{{n}}}))")}, 1)' for n in sizes)})"
    return F.expr(f"explode_outer(array_distinct({where(windows, passes) if passes else windows}))")
