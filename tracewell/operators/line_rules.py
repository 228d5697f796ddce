"""Line rules: which rules fire on which lines, the fallback gate, thresholds and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import checks
from tracewell.functions.python_regex import Pattern, only_python, with_found_lines
from tracewell.functions.regex import Line, folds, with_line
from tracewell.functions.sql import Sql, all_of, array, case, first, is_in, let, present, struct, text, transform, where
from tracewell.functions.text import strip, truncate
from tracewell.operators.hits import HIT_TYPE, hit_struct
from tracewell.operators.patterns import by_kind, compiled_or_not, first_match, pattern_hit, regex_patterns, with_line_columns
from tracewell.options import ScanOptions
from tracewell.sources.packs import Packs
from tracewell.sources.rules import Rule, order_rules

LINE_RULE_PREFIX = "[heuristic threshold reached]: "
NO_HITS = f"CAST(array() AS array<{HIT_TYPE}>)"


def applies(rule: Rule, o: ScanOptions) -> Sql | None:
    """File-level condition for a rule; None where it applies to every file."""
    exts = rule.extensions(o.extension_groups)
    tests = [] if exts is None else [is_in("ext", exts)]
    contexts = rule.applies_to.get("scan_context")
    if rule.scope == "file" and o.context_column and contexts:
        given = o.context_column if o.scan_context is None else f"coalesce({o.context_column}, {text(o.scan_context)})"
        tests.append(f"({given} IS NULL OR {is_in(given, contexts)})")
    return all_of(tests) if tests else None


def line_check(rule: Rule, line: Line) -> Sql:
    p = rule.parameters
    if rule.type == "string_length":
        return checks.string_length(line.text, p.get("min_length", 0))
    if rule.type == "base64_suspect":
        return checks.base64_suspect(line.text, p.get("min_length", 0))
    if rule.type == "hex_suspect":
        return checks.hex_suspect(line.text, p.get("min_length", 0))
    if rule.type == "path_access":
        return checks.path_access(line.text, p.get("paths", []))
    if rule.type == "keyword_combination":
        return checks.keyword_combination(line, rule.keyword_groups(), rule.keyword_threshold())
    if rule.type == "obfuscation_strings":
        return obfuscated_strings(rule, line.text)
    raise ValueError(f"rule {rule.id!r}: {rule.type!r} is not a line check")


def obfuscated_strings(rule: Rule, c: Sql) -> Sql:
    p = rule.parameters
    literals = int(p.get("min_string_literals", checks.MIN_STRING_LITERALS))
    score = checks.obfuscation_score(c, "ext", p.get("weights"), literals)
    return f"({score} >= {float(p.get('min_score', checks.MIN_SCORE))}D)"


def line_rules(rules: list[Rule], o: ScanOptions) -> list[Rule]:
    return [r for r in order_rules(rules, o.level) if r.scope == "line"]


def file_rules(rules: list[Rule], o: ScanOptions) -> list[Rule]:
    found = [r for r in order_rules(rules, o.level) if r.scope == "file"]
    return found if o.context_column else [r for r in found if r.in_context(o.scan_context)]


def rule_patterns(rules: list[Rule]) -> list[Pattern]:
    keywords = (k for r in rules if r.type == "keyword_combination" for group in r.keyword_groups() for k in group)
    return [(k.value, k.ignore_case) for k in keywords if k.kind == "regex"]


def fired_rules(ordered: list[Rule], o: ScanOptions, line: Line) -> Sql:
    """Positions (in ``ordered``) of the rules that fire on a line, ascending."""

    def fired(i: int, rule: Rule) -> Sql:
        test, file_test = line_check(rule, line), applies(rule, o)
        return case((test if file_test is None else f"{file_test} AND {test}", str(i)))

    return present([fired(i, r) for i, r in enumerate(ordered)], "int")


def line_rule_events(lines: DataFrame, rules: list[Rule], o: ScanOptions) -> DataFrame:
    """Raw events, before the gate: one row per kept line and rule that fires on it."""
    ordered = line_rules(rules, o)
    rows, line = with_line_columns(lines, rule_patterns(ordered))
    positions = compiled_or_not(len(ordered), fired_rules(ordered, o, line))
    fired = rows.select("file_id", "line_no", "raw", F.expr(f"explode_outer({positions})").alias("i"))
    fired = fired.filter("i IS NOT NULL")
    pick = lambda values: F.expr(f"try_element_at({array(map(text, values), 'string')}, i + 1)")
    return fired.select(
        "file_id",
        pick(r.id for r in ordered).alias("rule_id"),
        (F.col("i") + 1).alias("rule_order"),
        "line_no",
        pick(r.severity for r in ordered).alias("severity"),
        "raw",
    )


def keyword_file_rules(rules: list[Rule], o: ScanOptions) -> list[tuple[int, Rule]]:
    """File rules that look at one line at a time, with their place among the file rules."""
    return [(i, r) for i, r in enumerate(file_rules(rules, o)) if r.type == "keyword_combination"]


def _fired_file_rules(found: list[tuple[int, Rule]], o: ScanOptions, line: Line) -> Sql:
    def fired(i: int, rule: Rule) -> Sql:
        test = checks.keyword_combination(line, rule.keyword_groups(), rule.keyword_threshold())
        file_test = applies(rule, o)
        return case((test if file_test is None else f"{file_test} AND {test}", str(i)))

    return present([fired(i, r) for i, r in found], "int")


def with_marks(files: DataFrame, packs: Packs | None, rules: list[Rule], o: ScanOptions) -> DataFrame:
    """Adds ``marks``: the few kept lines of the file on which something fires, each with its
    pattern index (null for none), its line rules' positions, and those of keyword file rules, which
    test the original line. One pass over the lines; everything after it works on the marks."""
    ordered, by_file = line_rules(rules, o), keyword_file_rules(rules, o)
    columns = files.columns
    files, in_code = with_found_lines(
        files, "code", only_python([*(regex_patterns(packs) if packs else []), *rule_patterns(ordered)]))
    files, in_raw = with_found_lines(files, "raw", only_python(rule_patterns([r for _, r in by_file])))

    def mark(x: Sql) -> Sql:
        def tested(line: Line) -> Sql:
            pattern = "CAST(NULL AS INT)" if packs is None else by_kind(packs, lambda pack: first_match(line, pack))
            lower = case((f"{x}.raw = {x}.code", line.lower), default=f"lower({x}.raw)")
            original = lambda v: _fired_file_rules(by_file, o, Line(f"{x}.raw", v, folds(f"{x}.raw"), in_raw(f"{x}.line_no")))
            return struct(
                line_no=f"{x}.line_no",
                raw=f"{x}.raw",
                pattern=pattern,
                rules=fired_rules(ordered, o, line),
                file_rules=let(lower, original) if by_file else "CAST(array() AS array<int>)",
            )

        return with_line(f"{x}.code", tested, in_code(f"{x}.line_no"))

    fires = lambda m: f"{m}.pattern IS NOT NULL OR size({m}.rules) > 0 OR size({m}.file_rules) > 0"
    return files.select(*columns, F.expr(where(transform("kept", mark), fires)).alias("marks"))


def pattern_hit_array(packs: Packs, o: ScanOptions) -> Sql:
    found = where("marks", lambda m: f"{m}.pattern IS NOT NULL")
    return transform(found, lambda m: pattern_hit(m, f"{m}.pattern", packs, o))


def events(marks: Sql, o: ScanOptions) -> Sql:
    unsigned = lambda m: f" AND {m}.pattern IS NULL" if o.signature_gate else ""
    return where(marks, lambda m: f"size({m}.rules) > 0{unsigned(m)}")


def gated(rule: Rule, i: int, fired: Sql, o: ScanOptions) -> Sql:
    """The events of one rule that count. A fallback rule is not tried once any line rule has
    fired in the file, so it keeps its event only if that is the file's very first one."""
    if rule.only_if_no_match and not o.all_matches:
        is_first = f"{first(f'{first(fired)}.rules')} = {i}"
        return f"slice({fired}, 1, {case((is_first, '1'), default='0')})"
    return where(fired, lambda m: f"array_contains({m}.rules, {i})")


def evidence(found: Sql, o: ScanOptions) -> Sql:
    """Matched lines in order, numbered when there are several."""
    cut = lambda m: truncate(strip(f"{m}.raw"), o.max_line_rule_hit_length)
    numbered = transform(found, lambda m: f"concat({m}.line_no, ': ', {cut(m)})")
    return case(
        (f"size({found}) > 1", f"array_join({numbered}, {text(chr(10))})"), default=cut(first(found))
    )


def line_rule_hit_array(rules: list[Rule], o: ScanOptions) -> Sql:
    """Hits of all line rules of a file, from its ``marks``."""
    ordered = line_rules(rules, o)

    def hit(i: int, rule: Rule, fired: Sql) -> Sql:
        def build(found: Sql) -> Sql:
            built = hit_struct(
                stage="line_rule",
                hits=f"size({found})",
                pattern_or_rule=text(LINE_RULE_PREFIX + rule.name),
                type_or_severity=text(rule.severity),
                rule_id=text(rule.id),
                rule_type=text(rule.type),
                line_number=f"{first(found)}.line_no",
                line=evidence(found, o),
                seq=i,
            )
            return case((f"size({found}) >= {max(1, rule.heuristic_threshold)}", built))

        return let(gated(rule, i, fired, o), build)

    def hits_of(fired: Sql) -> Sql:
        hits = present([hit(i, r, fired) for i, r in enumerate(ordered)], HIT_TYPE)
        return case((f"size({fired}) > 0", hits), default=NO_HITS)

    return let(events("marks", o), hits_of) if ordered else NO_HITS


def gated_event_rows(files: DataFrame, rules: list[Rule], o: ScanOptions) -> DataFrame:
    """Events that count, one row each, from ``marks``."""
    ordered = line_rules(rules, o)

    def of_rule(i: int, rule: Rule, fired: Sql) -> Sql:
        row = lambda m: struct(
            rule_id=text(rule.id), rule_order=str(i + 1), line_no=f"{m}.line_no",
            severity=text(rule.severity), raw=f"{m}.raw",
        )
        return transform(gated(rule, i, fired, o), row)

    all_rules = lambda fired: f"flatten(array({', '.join(of_rule(i, r, fired) for i, r in enumerate(ordered))}))"
    rows = files.select("file_id", F.expr(f"inline_outer({let(events('marks', o), all_rules)})"))
    return rows.filter("rule_id IS NOT NULL")
