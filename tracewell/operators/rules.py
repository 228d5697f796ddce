"""Rule catalogs as tables: parsing, level filter, evaluation order, keywords, applicability, lint.

A catalog may be any size (many teams' rule sets in one table); nothing here collects it.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions.regex import check_pattern
from tracewell.operators.ranking import with_global_number
from tracewell.options import SEVERITY_RANK, ScanOptions
from tracewell.sources.rules import TYPE_SCOPES, RuleError

_RAW_RULE = (
    "id string, name string, description string, false_positive_note string, type string, scope string, "
    "severity string, only_if_no_match boolean, heuristic_threshold int, priority int, "
    "applies_to struct<extensions: array<string>, scan_context: array<string>>, parameters variant"
)


def rules_from_json(texts: DataFrame) -> DataFrame:
    """``texts(source_file, idx, value)``, one rule's JSON each, to a rules table with defaults."""
    r = F.from_json("value", _RAW_RULE)
    return texts.select(r.alias("r"), "source_file", F.col("idx").cast("int").alias("idx")).select(
        "r.id",
        F.coalesce("r.name", "r.id").alias("name"),
        F.coalesce("r.description", F.lit("")).alias("description"),
        F.coalesce("r.false_positive_note", F.lit("")).alias("false_positive_note"),
        "r.type",
        "r.scope",
        "r.severity",
        F.coalesce("r.only_if_no_match", F.lit(False)).alias("only_if_no_match"),
        F.coalesce("r.heuristic_threshold", F.lit(1)).alias("heuristic_threshold"),
        F.coalesce("r.priority", F.lit(100)).alias("priority"),
        "r.applies_to",
        F.coalesce(F.to_json("r.parameters"), F.lit("{}")).alias("parameters"),
        "source_file",
        "idx",
    )


def rule_files_to_texts(files: DataFrame) -> DataFrame:
    """``files(source_file, value)`` of whole rule files to one row per entry of their ``rules``."""
    entries = F.from_json("value", "rules array<variant>")["rules"]
    rows = files.select("source_file", F.posexplode_outer(entries).alias("idx", "rule"))
    return rows.filter(F.col("rule").isNotNull()).select("source_file", "idx", F.to_json("rule").alias("value"))


def rule_file_problems(files: DataFrame) -> DataFrame:
    """``violations(rule_id, check, detail)`` of whole rule files ``files(source_file, value)``: a file whose ``rules`` is
    not a list, and a set of files that has no rule at all."""
    rules = F.try_variant_get(F.try_parse_json("value"), "$.rules", "variant")
    is_list = F.coalesce(_kind_of(rules) == "ARRAY", F.lit(False))
    none = F.lit(None).cast("string").alias("rule_id")
    shapes = files.where(~is_list).select(none, F.lit("rules_not_list").alias("check"), F.col("source_file").alias("detail"))
    held = F.size(F.from_json("value", "rules array<variant>")["rules"])
    total = files.agg(F.coalesce(F.sum(F.greatest(F.coalesce(held, F.lit(0)), F.lit(0))), F.lit(0)).alias("n"))
    return shapes.unionByName(total.where("n = 0").select(none, F.lit("no_rules").alias("check"), F.lit("").alias("detail")))


def severity_rank(severity: Column) -> Column:
    ranks = None
    for name, rank in SEVERITY_RANK.items():
        ranks = (F if ranks is None else ranks).when(severity == name, rank)
    return ranks


def at_level(rules: DataFrame, level: str) -> DataFrame:
    """Rules of at least this severity."""
    return rules.filter(severity_rank(F.col("severity")) >= SEVERITY_RANK[level])


def rule_counts(rules: DataFrame, level: str) -> DataFrame:
    return at_level(rules, level).groupBy("severity").agg(F.count("*").alias("rules"))


def order_rules(rules: DataFrame, level: str) -> DataFrame:
    """Adds ``rule_order``, 1 for the rule evaluated first: severity, priority, line before file,
    non-fallback first, then file name and place in the file."""
    keys = {
        "_sev": -severity_rank(F.col("severity")),
        "_pri": -F.col("priority"),
        "_scope": F.when(F.col("scope") == "line", 0).when(F.col("scope") == "file", 1).otherwise(99),
        "_fallback": F.col("only_if_no_match").cast("int"),
        "_file": F.col("source_file"),
    }
    placed = at_level(rules, level).withColumns(keys)
    return with_global_number(placed, "rule_order", [*keys, "idx"]).drop(*keys)


ANY_EXTENSION = "*"


def rule_extensions(rules: DataFrame, o: ScanOptions) -> DataFrame:
    """``(rule_id, ext)`` for every extension a rule applies to, ``*`` for a rule that names none.
    A name is a group or a literal suffix; unknown names give nothing (``lint_rules`` reports
    them)."""
    groups = F.create_map(*[
        part for g, exts in o.extension_groups.items() for part in (F.lit(g), F.array(*map(F.lit, exts)))
    ])
    given = F.col("applies_to.extensions")
    names = rules.select(
        F.col("id").alias("rule_id"),
        F.explode(F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(ANY_EXTENSION)))).alias("name"),
    )
    single = F.when(F.col("name").startswith(".") | (F.col("name") == ANY_EXTENSION), F.array("name"))
    exts = F.coalesce(F.try_element_at(groups, F.col("name")), single)
    return names.select("rule_id", F.explode(exts).alias("ext")).distinct()


def applicable(rules: DataFrame, files: DataFrame, o: ScanOptions) -> DataFrame:
    """Per extension that occurs, how many files have it and how many rules apply to it. Both sides
    are counted per extension before they meet."""
    present = files.groupBy(F.col("ext").alias("file_ext")).agg(F.count("*").alias("files"))
    counts = rule_extensions(rules, o).groupBy("ext").agg(F.count("*").alias("n"))
    either = present.select("*", F.explode(F.array("file_ext", F.lit(ANY_EXTENSION))).alias("ext"))
    return (
        either.join(counts, "ext", "left")
        .groupBy(F.col("file_ext").alias("ext"), "files")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("rules"))
        .select("ext", "rules", "files")
    )


def _kind_of(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _item(v: Column) -> Column:
    """``struct(kind, value, flags)`` of one keyword, null for anything that is none."""
    regex = F.try_variant_get(v, "$.regex", "string")
    flags = F.coalesce(F.try_variant_get(v, "$.flags", "array<string>"), F.array().cast("array<string>"))
    struct = lambda kind, value, flags: F.struct(
        F.lit(kind).alias("kind"), value.alias("value"), flags.alias("flags")
    )
    return F.when(
        _kind_of(v) == "STRING", struct("plain", F.lower(v.cast("string")), F.array().cast("array<string>"))
    ).when((_kind_of(v) == "OBJECT") & regex.isNotNull(), struct("regex", regex, flags))


def _groups(parameters: Column) -> Column:
    """Keyword groups of a rule's parameters, invalid entries gone. A list is a group even when
    none of its items is valid; any other entry is a group of one or nothing."""
    entries = F.try_variant_get(F.try_parse_json(parameters), "$.keywords", "array<variant>")

    def group(v: Column) -> Column:
        is_list = _kind_of(v) == "ARRAY"
        items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
        found = F.array_compact(F.transform(items, _item))
        return F.when(is_list | (F.size(found) > 0), found)

    return F.array_compact(F.transform(F.coalesce(entries, F.array().cast("array<variant>")), group))


def keyword_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("type") == "keyword_combination")


def rule_keywords(rules: DataFrame) -> DataFrame:
    """``(rule_id, group_no, item_no, kind, value, flags)`` with numbers from 1."""
    groups = keyword_rules(rules).select(
        F.col("id").alias("rule_id"), F.posexplode(_groups(F.col("parameters"))).alias("g", "items")
    )
    items = groups.select("rule_id", "g", F.posexplode("items").alias("i", "item"))
    return items.select(
        "rule_id", (F.col("g") + 1).alias("group_no"), (F.col("i") + 1).alias("item_no"), "item.kind", "item.value", "item.flags"
    )


# Workers need not have this package: what runs there is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[check_pattern.__module__])


@F.pandas_udf(StringType())
def _pattern_problem(patterns: pd.Series) -> pd.Series:
    return patterns.map(check_pattern)


def lint_rules(rules: DataFrame, o: ScanOptions, strict: bool = False) -> DataFrame:
    """``violations(rule_id, check, detail)``. ``strict`` raises on the first ones instead."""
    groups = list(o.extension_groups)
    known = F.col("type").isin(list(TYPE_SCOPES))
    allowed = F.concat_ws("/", "type", "scope").isin([f"{t}/{s}" for t, scopes in TYPE_SCOPES.items() for s in scopes])
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    where = F.concat_ws("#", "source_file", F.col("idx").cast("string"))
    unknown = F.filter(
        F.coalesce("applies_to.extensions", F.array().cast("array<string>")),
        lambda e: ~(e.isin(groups) | e.startswith(".")),
    )
    is_keywords = F.col("type") == "keyword_combination"
    count = F.size(_groups(F.col("parameters")))
    threshold = F.try_variant_get(F.try_parse_json("parameters"), "$.threshold", "variant")
    given = F.when(_kind_of(threshold) == "ARRAY", F.try_variant_get(threshold, "$", "array<int>"))
    overwritten = (count > 1) & (F.size(given) > 0) & (
        (F.size(given) != count) | F.exists(given, lambda t: t != 1)
    )

    def row(test: Column, check: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(check).alias("check"), detail.alias("detail")))

    checks = F.array_compact(
        F.array(
            row(missing("id"), "missing_id", where),
            row(missing("type"), "missing_field", F.lit("type")),
            row(missing("scope"), "missing_field", F.lit("scope")),
            row(
                ~F.coalesce(F.col("severity"), F.lit("")).isin(list(SEVERITY_RANK)),
                "invalid_severity", F.coalesce("severity", F.lit("")),
            ),
            row(F.size(unknown) > 0, "unknown_extension", F.array_join(unknown, ",")),
            row(~missing("type") & ~known, "unknown_type", F.col("type")),
            row(~missing("scope") & ~F.col("scope").isin("line", "file"), "unknown_scope", F.col("scope")),
            row(
                known & F.col("scope").isin("line", "file") & ~allowed, "scope_not_allowed",
                F.concat_ws("/", "type", "scope"),
            ),
            row(is_keywords & (count == 0), "no_keyword_group", F.lit("")),
            row(
                is_keywords & threshold.isNotNull() & (_kind_of(threshold) != "ARRAY"),
                "threshold_not_list", F.to_json(threshold),
            ),
            row(is_keywords & overwritten, "threshold_overwritten", F.array_join(given, ",")),
        )
    )
    local = rules.select(F.col("id").alias("rule_id"), F.inline_outer(checks)).filter(F.col("check").isNotNull())
    duplicates = (
        rules.filter(~missing("id"))
        .groupBy(F.col("id").alias("rule_id"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("rule_id", F.lit("duplicate_id").alias("check"), F.col("n").cast("string").alias("detail"))
    )
    patterns = rule_keywords(rules).filter(F.col("kind") == "regex")
    invalid = (
        patterns.withColumn("problem", _pattern_problem("value"))
        .filter(F.col("problem").isNotNull())
        .select("rule_id", F.lit("invalid_regex").alias("check"), F.col("value").alias("detail"))
    )
    violations = local.unionByName(duplicates).unionByName(invalid)
    if strict and (first := violations.take(5)):
        raise RuleError("; ".join(f"{v.rule_id}: {v.check} {v.detail}".rstrip() for v in first))
    return violations
