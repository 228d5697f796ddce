"""File rules: keyword lines, string building and identifier shape over a file's kept lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import checks
from tracewell.functions.sql import Sql, case, first, fold, is_in, let, present, text, transform, where
from tracewell.functions.text import prefix_length, strip, truncate
from tracewell.operators.hits import HIT_TYPE, hit_struct
from tracewell.operators.line_rules import applies, file_rules, obfuscated_strings
from tracewell.operators.lines import file_text
from tracewell.options import ScanOptions
from tracewell.sources.rules import Rule

# Texts of the report.
FILE_RULE_PREFIX = "[heuristic file match]: "
STRINGS_EVIDENCE = "[Check file – content omitted]"
VARS_EVIDENCE = "[File content omitted]"
MINIFIED_EVIDENCE = "[File content omitted – likely contains bundled or minified code]"
MATCHED_HEADER = "Matched lines:\n"
PREVIEW_HEADER = "Preview of matched lines (max. {n}):\n"


def is_minified(o: ScanOptions) -> Sql:
    """A script of one or two lines whose mean length is over the limit."""
    total = fold("kept", "0L", lambda acc, x: f"{acc} + length({x}.raw)", lambda acc: acc)
    return is_minified_of("size(kept)", total, o)


def is_minified_of(lines: Sql, chars: Sql, o: ScanOptions) -> Sql:
    return (
        f"({is_in('ext', o.script_extensions)} AND {lines} BETWEEN 1 AND 2 "
        f"AND {chars} / {lines} > {o.max_minified_line_avg_length})"
    )


def keyword_lines(i: int, o: ScanOptions) -> Sql:
    """Distinct cut originals that meet file rule ``i``, in order of first appearance, up to the
    limits."""
    found = where("marks", lambda m: f"array_contains({m}.file_rules, {i})")
    cut = f"array_distinct({transform(found, lambda x: truncate(f'{x}.raw', o.max_line_rule_hit_length))})"
    if o.no_bail_out:
        return cut
    fits = lambda d: prefix_length(d, lambda t: f"length({t})", o.max_lines_file_scan, o.max_chars_file_scan)
    return let(cut, lambda d: f"slice({d}, 1, {fits(d)})")


def keyword_preview(found: Sql, o: ScanOptions) -> Sql:
    return preview_of(found, f"size({found})", is_minified(o), o)


def preview_of(found: Sql, count: Sql, minified: Sql, o: ScanOptions) -> Sql:
    """Of ``count`` lines, of which ``found`` has those to show at least."""
    n = o.max_preview_lines_file
    lines = transform(f"slice({found}, 1, {n})", lambda t: truncate(strip(t), o.max_line_rule_hit_length))
    header = case(
        (f"{count} > {n}", text(PREVIEW_HEADER.format(n=n))),
        (f"{count} > 1", text(MATCHED_HEADER)),
        default="''",
    )
    preview = f"concat({header}, array_join({lines}, {text(chr(10))}))"
    return case((minified, text(MINIFIED_EVIDENCE)), default=preview)


def text_for_rules(o: ScanOptions) -> Sql:
    return file_text("kept", None if o.no_bail_out else o.max_chars_file_scan)


def with_file_text(files: DataFrame, o: ScanOptions) -> DataFrame:
    return files.withColumn("file_text", F.expr(text_for_rules(o)))


def needs_text(rules: list[Rule], o: ScanOptions) -> bool:
    return any(r.type != "keyword_combination" for r in file_rules(rules, o))


def file_rule_hit_array(rules: list[Rule], o: ScanOptions) -> Sql:
    """Hits of all file rules of a file, from ``kept``, ``marks`` and, if ``needs_text``,
    ``file_text``."""

    def hit(i: int, rule: Rule) -> Sql:
        def build(hits: Sql, line: Sql) -> Sql:
            return hit_struct(
                stage="file_rule",
                hits=hits,
                pattern_or_rule=text(FILE_RULE_PREFIX + rule.name),
                type_or_severity=text(rule.severity),
                rule_id=text(rule.id),
                rule_type=text(rule.type),
                line_number="0",
                line=line,
                seq=i,
            )

        if rule.type == "keyword_combination":
            matched = lambda found: build(f"size({found})", keyword_preview(found, o))
            result = let(keyword_lines(i, o), lambda found: case((f"size({found}) > 0", matched(found))))
        elif rule.type == "obfuscation_strings":
            result = case((obfuscated_strings(rule, "file_text"), build("1", text(STRINGS_EVIDENCE))))
        else:
            result = case((checks.obfuscated_vars("file_text", rule.parameters), build("1", text(VARS_EVIDENCE))))
        file_test = applies(rule, o)
        if file_test is None or rule.type == "keyword_combination":  # marks were made with the test
            return result
        return case((file_test, result))

    ordered = file_rules(rules, o)
    hits = present([hit(i, r) for i, r in enumerate(ordered)], HIT_TYPE)
    fallback = [str(i) for i, r in enumerate(ordered) if r.only_if_no_match]
    if o.file_gate == "evaluated" or o.all_matches or not fallback:
        return hits
    # As documented: a fallback rule counts only when no earlier file rule matched.
    late = lambda h, all_hits: f"{h}.seq IN ({', '.join(fallback)}) AND {h}.seq <> {first(all_hits)}.seq"
    return let(hits, lambda hs: where(hs, lambda h: f"NOT ({late(h, hs)})"))
