"""The scan: files in, findings out, in one pass over the files and without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewell.functions.sql import case, check_session
from tracewell.operators.file_rules import file_rule_hit_array, needs_text, with_file_text
from tracewell.operators.files import filename_hits, relevant_files, with_text
from tracewell.operators.hits import all_hits, explode_hits
from tracewell.operators.line_rules import NO_HITS, line_rule_hit_array, pattern_hit_array, with_marks
from tracewell.operators.lines import with_kept_lines
from tracewell.options import ScanOptions
from tracewell.sources.packs import Packs
from tracewell.sources.rules import Rule

FILE_COLUMNS = ["file_id", "scope", "path", "basename", "ext", "parent"]


def file_columns(o: ScanOptions) -> list[str]:
    return FILE_COLUMNS + [o.context_column] * bool(o.context_column)


def prepare(files: DataFrame, o: ScanOptions) -> DataFrame:
    """Relevant files with their kept lines."""
    check_session(files.sparkSession)
    relevant = relevant_files(files, o)
    return with_kept_lines(with_text(relevant).select(*file_columns(o), "scan_kind", "text"), o)


def scan_prepared(prepared: DataFrame, packs: Packs, rules: list[Rule], o: ScanOptions) -> DataFrame:
    step = with_marks(prepared, packs, rules, o)
    if needs_text(rules, o):
        step = with_file_text(step, o)
    file_hits = file_rule_hit_array(rules, o)
    if o.signature_gate:
        file_hits = case(("exists(marks, m -> m.pattern IS NOT NULL)", NO_HITS), default=file_hits)
    parts = [pattern_hit_array(packs, o), line_rule_hit_array(rules, o), file_hits]
    return explode_hits(step, f"concat({', '.join(parts)})")


def scan(files: DataFrame, packs: Packs, rules: list[Rule] = (), o: ScanOptions = ScanOptions()) -> DataFrame:
    """Pattern, line-rule and file-rule hits of ``files(file_id, scope, path, basename, ext,
    parent, content|text)`` and what ``o.context_column`` names. Lazy, stateless and free of exchanges, so it also runs on a stream."""
    return scan_prepared(prepare(files, o), packs, list(rules), o)


def scan_with_filenames(
    files: DataFrame,
    packs: Packs,
    rules: list[Rule] = (),
    o: ScanOptions = ScanOptions(),
    listing: DataFrame | None = None,
) -> DataFrame:
    """All hits. ``listing`` (files without content) serves the filename stage when given."""
    return all_hits(filename_hits(files if listing is None else listing, list(packs.names)), scan(files, packs, rules, o))
