"""Heuristic rules: reading, normalising and ordering rule sets.

A rule set is configuration (tens of rules), so the driver holds it and compiles it to Columns.
``operators.rules`` has the same checks and orderings for rule catalogs kept as tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.regex import check_pattern
from tracewell.options import SEVERITY_RANK

RULES_SCHEMA = (
    "id string, name string, description string, false_positive_note string, type string, scope string, "
    "severity string, only_if_no_match boolean, heuristic_threshold int, priority int, "
    "applies_to struct<extensions: array<string>, scan_context: array<string>>, parameters string, "
    "source_file string, idx int"
)
# Rule types and the scopes they may have.
TYPE_SCOPES = {
    "string_length": ("line",),
    "base64_suspect": ("line",),
    "hex_suspect": ("line",),
    "path_access": ("line",),
    "keyword_combination": ("line", "file"),
    "obfuscation_strings": ("line", "file"),
    "obfuscation_vars": ("file",),
}
_SCOPE_RANK = {"line": 0, "file": 1}


class RuleError(ValueError):
    """A rule set that a scan must not start with."""


@dataclass(frozen=True)
class Keyword:
    kind: str  # plain | regex
    value: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    scope: str
    severity: str = "low"
    name: str = ""
    description: str = ""
    false_positive_note: str = ""
    only_if_no_match: bool = False
    heuristic_threshold: int = 1
    priority: int = 100
    applies_to: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    source_file: str = ""
    idx: int = 0

    def keyword_groups(self) -> list[list[Keyword]]:
        return keyword_groups(self.parameters.get("keywords", []))

    def keyword_threshold(self) -> int:
        """Matches a single group needs; of several groups each needs one."""
        groups = self.keyword_groups()
        given = self.parameters.get("threshold") or []
        if len(groups) > 1:
            return 1
        if given and given[0] >= 1:
            return given[0]
        return 1 if len(groups[0]) == 1 else 2

    def extensions(self, groups) -> list[str] | None:
        """Extensions the rule applies to, None for all of them."""
        names = self.applies_to.get("extensions")
        if not names:
            return None
        found: list[str] = []
        for name in names:
            if name in groups:
                found += groups[name]
            elif name.startswith("."):
                found.append(name)
            else:
                raise RuleError(f"rule {self.id!r}: unknown extension or group {name!r}")
        return found

    def in_context(self, context: str | None) -> bool:
        contexts = self.applies_to.get("scan_context")
        return context is None or not contexts or context in contexts


def _keyword(item) -> Keyword | None:
    if isinstance(item, str):
        return Keyword("plain", item.lower())
    if isinstance(item, dict) and "regex" in item:
        problem = check_pattern(item["regex"])
        if problem:
            raise RuleError(f"invalid pattern {item['regex']!r}: {problem}")
        return Keyword("regex", item["regex"], "IGNORECASE" in item.get("flags", ()))
    return None


def keyword_groups(groups: list) -> list[list[Keyword]]:
    """A bare string or pattern is a group of its own, a list is one group; other items drop out."""
    found = []
    for group in groups:
        if isinstance(group, list):
            found.append([k for k in map(_keyword, group) if k])
        elif (single := _keyword(group)) is not None:
            found.append([single])
    if not found:
        raise RuleError("no valid keyword group")
    return found


def rule_from_dict(raw: dict, source_file: str = "", idx: int = 0) -> Rule:
    where = f"rule {raw.get('id')!r} ({source_file}, index {idx})"
    for name in ("id", "type", "scope"):
        if not raw.get(name):
            raise RuleError(f"{where}: no {name}")
    severity = raw.get("severity")
    if severity not in SEVERITY_RANK:
        raise RuleError(f"{where}: invalid severity {severity!r}")
    if raw["type"] not in TYPE_SCOPES:
        raise RuleError(f"{where}: unknown type {raw['type']!r}")
    if raw["scope"] not in TYPE_SCOPES[raw["type"]]:
        raise RuleError(f"{where}: type {raw['type']!r} has no scope {raw['scope']!r}")
    rule = Rule(
        id=raw["id"],
        type=raw["type"],
        scope=raw["scope"],
        severity=severity,
        name=raw.get("name", raw["id"]),
        description=raw.get("description", ""),
        false_positive_note=raw.get("false_positive_note", ""),
        only_if_no_match=bool(raw.get("only_if_no_match", False)),
        heuristic_threshold=int(raw.get("heuristic_threshold", 1)),
        priority=int(raw.get("priority", 100)),
        applies_to=raw.get("applies_to") or {},
        parameters=raw.get("parameters") or {},
        source_file=source_file,
        idx=idx,
    )
    if rule.type == "keyword_combination":
        try:
            rule.keyword_groups()
        except RuleError as e:
            raise RuleError(f"{where}: {e}") from e
        if not isinstance(rule.parameters.get("threshold", []), list):
            raise RuleError(f"{where}: threshold is not a list")
    return rule


def order_rules(rules: list[Rule], level: str = "low") -> list[Rule]:
    """Rules of at least this severity in evaluation order: severity, priority, line before file,
    rules that may overlap before fallback rules, then load order."""
    chosen = [r for r in rules if SEVERITY_RANK[r.severity] >= SEVERITY_RANK[level]]
    return sorted(
        chosen,
        key=lambda r: (-SEVERITY_RANK[r.severity], -r.priority, _SCOPE_RANK[r.scope], r.only_if_no_match),
    )


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of one JSON file, or of all ``rules*.json`` in a directory in name order."""
    texts = (
        spark.read.option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
        .collect()
    )
    if len(texts) > 1 or path.rstrip("/").rsplit("/", 1)[-1] != (texts[0].name if texts else ""):
        texts = [t for t in texts if t.name.startswith("rules")]
    rules: list[Rule] = []
    seen: dict[str, str] = {}
    for text in sorted(texts, key=lambda t: t.name):
        found = json.loads(text.value).get("rules")
        if not isinstance(found, list):
            raise RuleError(f"'rules' is not a list in {text.path}")
        for idx, raw in enumerate(found):
            rule = rule_from_dict(raw, text.path, idx)
            if rule.id in seen:
                raise RuleError(f"duplicate rule id {rule.id!r} in {text.path}, first in {seen[rule.id]}")
            seen[rule.id] = text.path
            rules.append(rule)
    if not rules:
        raise RuleError(f"no rules in {path}")
    return rules


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table; ``parameters`` is JSON text."""
    rows = [
        (
            r.id, r.name, r.description, r.false_positive_note, r.type, r.scope, r.severity, r.only_if_no_match,
            r.heuristic_threshold, r.priority,
            (r.applies_to.get("extensions"), r.applies_to.get("scan_context")),
            json.dumps(r.parameters), r.source_file, r.idx,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def default_rules(spark: SparkSession) -> list[Rule]:
    """The rules that come with this package."""
    return read_rules(spark, f"file:{resources.files('tracewell') / 'packs' / 'rules.default.json'}")
