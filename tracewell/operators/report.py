"""Reports over hits: pivot, counts, CSV values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.sql import Sql, case, text
from tracewell.functions.text import csv_value
from tracewell.operators.files import relevant_files
from tracewell.options import TRUNCATION_MARK, ScanOptions

SCOPES = ["project", "local_cache", "global_cache"]
STAGES = ["filename", "pattern", "line_rule", "file_rule"]


def _position(c: str, order: list[str]) -> Sql:
    return f"array_position(array({', '.join(map(text, order))}), {c})"


def pivot(hits: DataFrame) -> DataFrame:
    """Hit records per pattern or rule, with the type seen first (scope, file, stage, line, rule).
    Aggregates before its only exchange, so a pattern that dominates costs no more than others."""
    place = f"struct({_position('scope', SCOPES)}, file, {_position('stage', STAGES)}, line_number, seq)"
    return hits.groupBy("pattern_or_rule").agg(
        F.expr(f"min_by(type_or_severity, {place})").alias("type_or_severity"), F.count("*").alias("hits")
    )


def pivot_partial(hits: DataFrame) -> DataFrame:
    """What a run's hits add to a pivot over runs: ``(pattern_or_rule, seen_first, hits)``."""
    seen = f"""struct({_position('scope', SCOPES)} AS scope_place, file, {_position('stage', STAGES)} AS stage_place, line_number, seq,
        type_or_severity)"""
    return hits.groupBy("pattern_or_rule").agg(F.expr(f"min({seen})").alias("seen_first"), F.count("*").alias("hits"))


def merged_pivot(partials: DataFrame) -> DataFrame:
    """The pivot of all runs' hits, from their partials."""
    merged = partials.groupBy("pattern_or_rule").agg(F.min("seen_first").alias("seen_first"), F.sum("hits").alias("hits"))
    return merged.select("pattern_or_rule", "seen_first.type_or_severity", "hits")


def merged_scopes(summaries: DataFrame) -> DataFrame:
    """The scope summary of all runs, from theirs (each file in one run)."""
    counts = [c for c in summaries.columns if c not in ("scope", "run")]
    return summaries.groupBy("scope").agg(*[F.sum(c).alias(c) for c in counts])


def scope_summary(hits: DataFrame, files: DataFrame, o: ScanOptions) -> DataFrame:
    """Per scope: hits of each stage, all hits, and relevant files."""
    counts = hits.groupBy("scope").agg(
        *[F.count_if(F.col("stage") == s).alias(f"{s}_hits") for s in STAGES], F.count("*").alias("total_hits")
    )
    scanned = relevant_files(files, o).groupBy("scope").agg(F.count("*").alias("files_scanned"))
    zeros = {c: 0 for c in [f"{s}_hits" for s in STAGES] + ["total_hits", "files_scanned"]}
    return scanned.join(counts, "scope", "full_outer").fillna(zeros)


def csv_columns(hits: DataFrame, o: ScanOptions) -> DataFrame:
    """The report's columns as they stand in the file. The line of a pattern hit is cut after its
    quotes are doubled; as it was cut before that already, length tells whether it was longer."""
    n = o.max_line_length
    doubled = f"""replace(substring(line, 1, {n}), '"', '""')"""
    long_line = f"""concat('"', substring({doubled}, 1, {n}), {text(TRUNCATION_MARK)}, '"')"""
    line = case(
        (f"stage = 'pattern' AND length(line) > {n}", long_line),
        ("stage = 'pattern'", csv_value("line", n)),
        default=csv_value("line", remove_line_feed=False),
    )
    quoted = lambda c: F.expr(csv_value(c)).alias(c)
    return hits.select(
        quoted("file"), "hits", quoted("pattern_or_rule"), quoted("type_or_severity"), quoted("rule_id"),
        quoted("rule_type"), "line_number", F.expr(line).alias("line"),
    )

