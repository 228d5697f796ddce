"""The scan of files in pieces, with the hits that whole files give.

What a line means can depend on lines before it: the comment state, its number, how many lines a scan that bails out has
kept. Each of these is a small summary of a piece (how it changes the comment state, how many lines and characters it has), composed
in order over a file's pieces by windows; the windows see a row for each piece, never its text. What comes before a piece
then goes to it as columns of its descriptor, and it is read with them.

What a rule says of a file is merged from what it says of the pieces: events are counted, the first one decides the
fallback gate, distinct lines are told apart by a grouping on the line, texts are counted and scored. No task holds a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import checks
from tracewell.functions.quotes import merged as merged_literals, summaries
from tracewell.functions.sql import Sql, all_of, array, case, contains, first, is_in, struct, text, transform
from tracewell.functions.text import split_lines, strip, truncate
from tracewell.operators import lines as lo
from tracewell.operators.file_rules import (
    FILE_RULE_PREFIX, STRINGS_EVIDENCE, VARS_EVIDENCE, is_minified_of, preview_of,
)
from tracewell.operators.hits import HIT_COLUMNS, ORIGIN_COLUMNS, explode_hits, hit_struct
from tracewell.operators.line_rules import (
    LINE_RULE_PREFIX, applies, events, file_rules, keyword_file_rules, line_rules, pattern_hit_array, with_marks,
)
from tracewell.options import ScanOptions
from tracewell.sources.packs import Packs
from tracewell.sources.pieces import Pieces
from tracewell.sources.rules import Rule
from tracewell.sources.tables import kept_for_good

KEY = ["file_id", "piece"]


def _upto(last: int):
    """A file's pieces in order, up to the one before (-1) or the piece itself (0)."""
    return Window.partitionBy("file_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, last)


def _sum_before(c: str):
    return F.coalesce(F.sum(c).over(_upto(-1)), F.lit(0))


def with_encoding(pieces: Pieces) -> tuple[DataFrame, DataFrame]:
    """``(descriptors with utf8, errors)``: a file is UTF-8 if all its pieces are. A file with a piece that cannot be read
    is an error as a whole."""
    seen = pieces.read(pieces.descriptors).select(
        "file_id", F.col("content").isNull().alias("lost"), F.expr("is_valid_utf8(CAST(content AS STRING))").alias("utf8"))
    by_file = kept_for_good(seen.groupBy("file_id").agg(F.max("lost").alias("lost"), F.every(F.coalesce("utf8", F.lit(True))).alias("utf8")))
    errors = by_file.where("lost").select("file_id", F.lit("unreadable").alias("reason"))
    return pieces.descriptors.join(by_file.where("NOT lost").select("file_id", "utf8"), "file_id"), errors


def _with_lines(rows: DataFrame, o: ScanOptions, rounds: int, last_cut: bool = False) -> DataFrame:
    """Adds ``_lines`` as they are after so many rounds of comments; with ``last_cut`` the next round's comments are cut
    on each line, but nothing is hidden yet."""
    decoded = "CASE WHEN utf8 THEN decode(content, 'UTF-8') ELSE decode(content, 'ISO-8859-1') END"
    others = [c for c in rows.columns if c != "content"]
    step = rows.select(*others, F.expr(decoded).alias("_text"))
    step = step.select(*others, F.expr(lo._numbered(split_lines("_text"))).alias("_lines"))
    plans = lo.comment_rounds(o)
    for i, plan in enumerate(plans[: rounds + last_cut]):
        step = step.select(*others, F.expr(lo._cut_comments("_lines", plan)).alias("_lines"))
        if i < rounds:
            step = step.select(*others, F.expr(lo._without_hidden("_lines", lo._masks("_lines", plan, f"_in{i}"))).alias("_lines"))
    return step


def _composed(changes: DataFrame, name: str) -> DataFrame:
    """The state before each piece, ``name`` being ``struct<b, d, s>``. A piece leaves block comments open, closed, as they
    were or the other way round; since the last piece that settles it, only the last kind matters."""
    flips = "CAST(change.open AND NOT change.still AS INT)"
    step = changes.withColumn("_flips", F.expr(flips))
    step = step.withColumn("_p", F.sum("_flips").over(_upto(0)))
    settled = F.expr("CASE WHEN change.open = change.still THEN pmod(CAST(change.open AS INT) + _p, 2) END")
    last = F.last(settled, ignorenulls=True).over(_upto(-1))
    odd = lambda c: F.coalesce(F.sum(F.expr(f"CAST(change.{c} AS INT)")).over(_upto(-1)), F.lit(0)) % 2 == 1
    state = F.struct(
        ((F.coalesce(last, F.lit(0)) + _sum_before("_flips")) % 2 == 1).alias("b"), odd("d").alias("d"), odd("s").alias("s"))
    return step.withColumn(name, state).drop("_flips", "_p", "change")


def with_states(pieces: Pieces, encoded: DataFrame, o: ScanOptions) -> DataFrame:
    """Descriptors with the number of lines before each piece, and the comment state there in each round."""
    found = encoded
    for i, plan in enumerate(lo.comment_rounds(o) or [{}]):
        step = _with_lines(pieces.read(found), o, i, last_cut=True)
        columns = [*KEY, F.expr(lo.comment_change("_lines", plan)).alias("change")]
        if i == 0:
            columns.append(F.size("_lines").cast("long").alias("_n"))
        states = _composed(kept_for_good(step.select(*columns)), f"_in{i}")
        if i == 0:
            states = states.withColumn("lines_before", _sum_before("_n")).drop("_n")
        found = kept_for_good(found.join(states, KEY))
    return found


def _kept(pieces: Pieces, placed: DataFrame, o: ScanOptions) -> DataFrame:
    """Adds ``kept``, the piece's lines with their numbers in the file, as far as the scan goes."""
    step = _with_lines(pieces.read(placed), o, len(lo.comment_rounds(o)))
    numbered = transform("_lines", lambda x: struct(
        line_no=f"CAST({x}.line_no + lines_before AS INT)", raw=f"{x}.raw", code=f"{x}.code", sym=f"{x}.sym"))
    return step.withColumn("_lines", F.expr(numbered)).withColumnRenamed("_lines", "kept")


def kept_pieces(pieces: Pieces, o: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """``(pieces with kept, errors)``. A scan that bails out counts what pieces keep, and reads again only those it reaches."""
    encoded, errors = with_encoding(pieces)
    placed = with_states(pieces, encoded, o)
    if o.no_bail_out:
        return _kept(pieces, placed, o), errors
    sizes = _kept(pieces, placed, o).select(
        *KEY, F.size("kept").cast("long").alias("_n"), F.expr("aggregate(kept, 0L, (a, x) -> a + length(x.raw))").alias("_w"))
    sizes = kept_for_good(sizes)
    before = sizes.withColumns({"kept_before": _sum_before("_n"), "chars_before": _sum_before("_w")}).where(
        (F.col("kept_before") < o.max_lines_file_scan) & (F.col("chars_before") < o.max_chars_file_scan))
    reached = kept_for_good(placed.join(before.drop("_n", "_w"), KEY))
    step = _kept(pieces, reached, o)
    fits = lo._fitting("kept", o, "CAST(kept_before AS INT)", "chars_before")
    return step.withColumn("kept", F.expr(f"slice(kept, 1, {fits})")), errors


# ---- what a piece says

def _cut(line: Sql, o: ScanOptions) -> Sql:
    return truncate(strip(f"{line}.raw"), o.max_line_rule_hit_length)


def _rule_parts(ordered: list[Rule], o: ScanOptions) -> Sql:
    """Of each rule with events in the piece: how many, the first line, and all of them as evidence."""

    def part(i: int) -> Sql:
        found = f"filter(fired, m -> array_contains(m.rules, {i}))"
        numbered = transform(found, lambda m: f"concat({m}.line_no, ': ', {_cut(m, o)})")
        built = struct(
            i=str(i), n=f"CAST(size({found}) AS BIGINT)", line_no=f"{first(found)}.line_no", line=_cut(first(found), o),
            lines=f"array_join({numbered}, {text(chr(10))})")
        return case((f"size({found}) > 0", built))

    return f"array_compact({array(map(part, range(len(ordered))), 'int')})"


def _keyword_parts(found: list[tuple[int, Rule]], o: ScanOptions) -> Sql:
    lines = lambda i: f"transform(filter(marks, m -> array_contains(m.file_rules, {i})), " \
        f"m -> named_struct('i', {i}, 'line_no', m.line_no, 'line', {truncate('m.raw', o.max_line_rule_hit_length)}))"
    return f"flatten({array([lines(i) for i, _ in found], 'int')})"


def _text_rules(rules: list[Rule], o: ScanOptions) -> list[tuple[int, Rule]]:
    return [(i, r) for i, r in enumerate(file_rules(rules, o)) if r.type != "keyword_combination"]


def piece_parts(kept: DataFrame, packs: Packs, rules: list[Rule], o: ScanOptions) -> DataFrame:
    """One row per piece: its pattern hits, and what is merged by file."""
    ordered, keywords, texts = line_rules(rules, o), keyword_file_rules(rules, o), _text_rules(rules, o)
    step = with_marks(kept, packs, rules, o).withColumn("fired", F.expr(events("marks", o)))
    parts = {
        "patterns": pattern_hit_array(packs, o),
        "first_event": case(("size(fired) > 0", struct(line_no=f"{first('fired')}.line_no", i=f"{first(f'{first('fired')}.rules')}"))),
        "signed": "exists(marks, m -> m.pattern IS NOT NULL)",
        "kept_lines": "CAST(size(kept) AS BIGINT)",
        "kept_chars": "aggregate(kept, 0L, (a, x) -> a + length(x.raw))",
    }
    if ordered:
        parts["rules"] = _rule_parts(ordered, o)
    if keywords:
        parts["keywords"] = _keyword_parts(keywords, o)
    if texts:
        step = step.withColumn("chunk", F.expr(lo.file_text("kept", None if o.no_bail_out else o.max_chars_file_scan)))
        if not o.no_bail_out:
            parts["chunk"] = "chunk"
        else:
            parts["hex"] = contains("chunk", checks.HEX_PREFIX)
            for threshold in _thresholds(texts):
                parts[_stats_name(threshold)] = checks.identifier_stats("chunk", threshold)
            if any(r.type == "obfuscation_strings" for _, r in texts):
                call = case((is_in("ext", checks.JOIN_EXTENSIONS), text(r"\.join\s*")), default=text(r"\.concat\s*"))
                parts["strings"] = checks.string_counts("chunk", "ext", literals=False)
                parts["begins"] = r"rlike(chunk, '(?U)\\A\\s*\\(')"
                parts["ends"] = f"rlike(chunk, concat('(?U)', {call}, {text(chr(92) + 'z')}))"
    columns = [*file_key(o), "piece", *(F.expr(e).alias(n) for n, e in parts.items())]
    if "strings" in parts:
        columns.append(summaries(checks.SHORT_LITERAL)(F.expr("CASE WHEN size(kept) > 0 THEN chunk END")).alias("quotes"))
    return step.select(*columns)


def _thresholds(texts: list[tuple[int, Rule]]) -> list[float]:
    return sorted({float({**checks.VARS_DEFAULTS, **r.parameters}["entropy_threshold"]) for _, r in texts if r.type != "obfuscation_strings"})


def _stats_name(threshold: float) -> str:
    return f"stats_{threshold!r}".replace(".", "_").replace("-", "_")


# ---- what the file says

def file_key(o: ScanOptions) -> list[str]:
    return ["file_id", "scope", "path", "ext"] + [o.context_column] * bool(o.context_column)


def _line_rule_hits(parts: DataFrame, ordered: list[Rule], facts: DataFrame, o: ScanOptions) -> DataFrame:
    rows = parts.select(*file_key(o), F.expr("inline_outer(rules)")).where("i IS NOT NULL")
    merged = rows.groupBy(*file_key(o), "i").agg(
        F.sum("n").alias("n"), F.min(F.struct("line_no", "line")).alias("head"),
        F.array_sort(F.collect_list(F.struct("line_no", "lines"))).alias("parts"))
    merged = merged.join(facts.select("file_id", "first_event"), "file_id")
    gates = [i for i, r in enumerate(ordered) if r.only_if_no_match and not o.all_matches]
    if gates:
        gated = is_in("CAST(i AS STRING)", map(str, gates))
        merged = merged.where(f"NOT {gated} OR first_event.i = i").withColumn("n", F.expr(case((gated, "1L"), default="n")))
    pick = lambda values: f"element_at({array(values, 'string')}, i + 1)"
    numbered = f"array_join(transform(parts, p -> p.lines), {text(chr(10))})"
    hit = hit_struct(
        stage="line_rule", hits="CAST(n AS INT)", pattern_or_rule=pick(text(LINE_RULE_PREFIX + r.name) for r in ordered),
        type_or_severity=pick(text(r.severity) for r in ordered), rule_id=pick(text(r.id) for r in ordered),
        rule_type=pick(text(r.type) for r in ordered), line_number="head.line_no",
        line=case(("n > 1", numbered), default="head.line"), seq="i")
    least = f"element_at({array([str(max(1, r.heuristic_threshold)) for r in ordered], 'int')}, i + 1)"
    return explode_hits(merged.where(f"n >= {least}"), f"array({hit})")


def _keyword_hits(parts: DataFrame, ordered: list[Rule], facts: DataFrame, o: ScanOptions) -> DataFrame:
    """Distinct lines are grouped by the line itself, so a line that a file repeats without end is one row."""
    rows = parts.select(*file_key(o), F.expr("inline_outer(keywords)")).where("i IS NOT NULL")
    distinct = rows.groupBy(*file_key(o), "i", "line").agg(F.min("line_no").alias("line_no"))
    of_rule = Window.partitionBy("file_id", "i").orderBy("line_no")
    if not o.no_bail_out:  # a scan that bails out has few lines
        before = of_rule.rowsBetween(Window.unboundedPreceding, -1)
        distinct = distinct.withColumns({
            "_n": F.row_number().over(of_rule) - 1, "_w": F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)),
        }).where((F.col("_n") < o.max_lines_file_scan) & (F.col("_w") < o.max_chars_file_scan)).drop("_n", "_w")
    counts = distinct.groupBy(*file_key(o), "i").agg(F.count("*").cast("int").alias("n"))
    heads = distinct.withColumn("nth", F.row_number().over(of_rule)).where(F.col("nth") <= o.max_preview_lines_file)
    heads = heads.groupBy("file_id", "i").agg(F.expr("transform(array_sort(collect_list(struct(nth, line))), x -> x.line)").alias("found"))
    merged = counts.join(heads, ["file_id", "i"]).join(facts.select("file_id", "kept_lines", "kept_chars"), "file_id")
    minified = is_minified_of("kept_lines", "kept_chars", o)
    return _file_hits(merged, ordered, "n", preview_of("found", "n", minified, o))


def _file_hits(rows: DataFrame, ordered: list[Rule], hits: Sql, line: Sql) -> DataFrame:
    pick = lambda values: f"element_at({array(values, 'string')}, i + 1)"
    hit = hit_struct(
        stage="file_rule", hits=hits, pattern_or_rule=pick(text(FILE_RULE_PREFIX + r.name) for r in ordered),
        type_or_severity=pick(text(r.severity) for r in ordered), rule_id=pick(text(r.id) for r in ordered),
        rule_type=pick(text(r.type) for r in ordered), line_number="0", line=line, seq="i")
    return explode_hits(rows, f"array({hit})")


def _text_hits(parts: DataFrame, rules: list[Rule], facts: DataFrame, o: ScanOptions) -> DataFrame:
    """File rules on the kept text: on the text itself where the scan bails out (it is bounded then), else on merged counts."""
    ordered, texts = file_rules(rules, o), _text_rules(rules, o)
    if not o.no_bail_out:
        held = parts.where("kept_lines > 0").groupBy(*file_key(o)).agg(F.array_sort(F.collect_list(F.struct("piece", "chunk"))).alias("c"))
        joined = f"substring(array_join(transform(c, x -> x.chunk), {text(chr(10))}), 1, {o.max_chars_file_scan})"
        rows = held.withColumn("file_text", F.expr(joined))
        every = parts.select(*file_key(o)).distinct().join(rows.select("file_id", "file_text"), "file_id", "left")
        rows = every.withColumn("file_text", F.coalesce("file_text", F.lit("")))

        def test(rule: Rule) -> Sql:
            if rule.type == "obfuscation_strings":
                score = checks.obfuscation_score("file_text", "ext", rule.parameters.get("weights"), _least(rule))
                return f"{score} >= {_limit(rule)}"
            return checks.obfuscated_vars("file_text", rule.parameters)
    else:
        sums = [F.max("hex").alias("hex")]
        for threshold in _thresholds(texts):
            n = _stats_name(threshold)
            fields = [F.sum(f"{n}.{c}").alias(c) for c in ("tokens", "hex_hits", "entropy_hits", "long_lines")]
            sums.append(F.struct(*fields, F.round(F.sum(f"{n}.weight"), 9).alias("weight")).alias(n))
        strings = any(r.type == "obfuscation_strings" for _, r in texts)
        if strings:
            sums += [F.sum(f"strings.{c}").alias(c) for c in checks.STRING_COUNTS[:6]]
            sums.append(F.array_sort(F.collect_list(F.when(F.col("kept_lines") > 0, F.struct("piece", "begins", "ends", "quotes")))).alias("c"))
        rows = parts.groupBy(*file_key(o)).agg(*sums)
        if strings:
            over = is_in("ext", [*checks.CONCAT_EXTENSIONS, *checks.JOIN_EXTENSIONS])
            rows = rows.withColumn("q", merged_literals(checks.SHORT_LITERAL)("c"))
            counted = {c: c for c in checks.STRING_COUNTS[:6]} | {"literals": "q.literals", "short": "q.short"}
            counted["joins"] = case((over, "joins + q.joins"), default="joins")
            rows = rows.withColumn("strings", F.expr(struct(**counted)))

        def test(rule: Rule) -> Sql:
            if rule.type == "obfuscation_strings":
                return f"{checks.score_of_counts('strings', rule.parameters.get('weights'), _least(rule))} >= {_limit(rule)}"
            p = {**checks.VARS_DEFAULTS, **rule.parameters}
            stats = checks.vars_of_stats(_stats_name(float(p["entropy_threshold"])), rule.parameters)
            return all_of(["hex", stats] if p["require_hex_prefix"] else [stats])

    def fires(i: int, rule: Rule) -> Sql:
        file_test = applies(rule, o)
        return case((all_of([test(rule)] if file_test is None else [file_test, test(rule)]), str(i)))

    rows = rows.select(*file_key(o), F.explode(F.expr(f"array_compact({array([fires(i, r) for i, r in texts], 'int')})")).alias("i"))
    evidence = array([text(STRINGS_EVIDENCE if r.type == "obfuscation_strings" else VARS_EVIDENCE) for r in ordered], "string")
    return _file_hits(rows, ordered, "1", f"element_at({evidence}, i + 1)")


def _least(rule: Rule) -> int:
    return int(rule.parameters.get("min_string_literals", checks.MIN_STRING_LITERALS))


def _limit(rule: Rule) -> str:
    return f"{float(rule.parameters.get('min_score', checks.MIN_SCORE))}D"


def scan_pieces(pieces: Pieces, packs: Packs, rules: list[Rule], o: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """``(hits, errors)`` of files in pieces: those that ``scan`` finds in the whole files. What the pieces say is written
    once, in the shared folder; hits are merged from that."""
    kept, errors = kept_pieces(pieces, o)
    parts = kept_for_good(piece_parts(kept, packs, rules, o))
    found = [explode_hits(parts, "patterns")]
    facts = parts.groupBy("file_id").agg(
        F.min("first_event").alias("first_event"), F.max("signed").alias("signed"),
        F.sum("kept_lines").alias("kept_lines"), F.sum("kept_chars").alias("kept_chars"))
    if ordered := line_rules(rules, o):
        found.append(_line_rule_hits(parts, ordered, facts, o))
    of_file = []
    if keyword_file_rules(rules, o):
        of_file.append(_keyword_hits(parts, file_rules(rules, o), facts, o))
    if _text_rules(rules, o):
        of_file.append(_text_hits(parts, rules, facts, o))
    if of_file:
        found.append(_gated(reduce(DataFrame.unionByName, of_file), parts, rules, o))
    return reduce(DataFrame.unionByName, found).select(*HIT_COLUMNS, *ORIGIN_COLUMNS), errors


def _gated(hits: DataFrame, parts: DataFrame, rules: list[Rule], o: ScanOptions) -> DataFrame:
    """File-rule hits that count: none in a file with a pattern hit, if those are enough; and, as documented, a fallback
    rule's only where no earlier file rule matched."""
    if o.signature_gate:
        signed = parts.where("signed").select(F.col("path").alias("file"), "scope").distinct()
        hits = hits.join(signed, ["file", "scope"], "left_anti")
    fallback = [i for i, r in enumerate(file_rules(rules, o)) if r.only_if_no_match]
    if o.file_gate == "evaluated" or o.all_matches or not fallback:
        return hits
    earliest = F.min("seq").over(Window.partitionBy("file", "scope"))  # a row for each rule at most
    return hits.withColumn("_first", earliest).where(~F.col("seq").isin(fallback) | (F.col("seq") == F.col("_first"))).drop("_first")
