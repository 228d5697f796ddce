"""Scan settings from a JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from tracewell.options import ScanOptions
from tracewell.sources.packs import Packs, read_packs
from tracewell.sources.rules import Rule, read_rules

# Fixed value: what a settings file without it means.
UNSET_LINE_LENGTH = 200

_LIMITS = (
    "max_line_length", "max_line_rule_hit_length", "max_lines_file_scan", "max_chars_file_scan",
    "max_preview_lines_file", "max_minified_line_avg_length",
)


@dataclass(frozen=True)
class Settings:
    """A settings file. Its relative paths are taken from ``base``."""

    options: ScanOptions
    pattern_lists: dict[str, str]
    rules_path: str
    cache_dirs: dict[str, list[str]]
    base: str

    def _resolve(self, path: str) -> str:
        return path if "://" in path or path.startswith(("/", "file:")) else f"{self.base}/{path.removeprefix('./')}"

    def packs(self, spark: SparkSession) -> Packs:
        return read_packs(spark, {name: self._resolve(path) for name, path in self.pattern_lists.items()})

    def rules(self, spark: SparkSession) -> list[Rule]:
        return read_rules(spark, self._resolve(self.rules_path))

    def roots(self, project: str, local: bool = False, global_: bool = False) -> dict[str, list[str]]:
        """Directories to scan per scope: the project, and caches where asked for."""
        expand = lambda dirs: [os.path.expandvars(os.path.expanduser(d)) for d in dirs]
        roots = {"project": [project]}
        if local:
            roots["local_cache"] = expand(self.cache_dirs.get("local", []))
        if global_:
            roots["global_cache"] = expand(self.cache_dirs.get("global", []))
        return roots


def read_settings(spark: SparkSession, path: str, base: str = ".", **options) -> Settings:
    """Settings with limits, ``artifacts`` (extension groups, content files), ``patterns``,
    ``rules_path`` and ``cache_dirs``; ``options`` are further ``ScanOptions`` fields."""
    rows = spark.read.text(path, wholetext=True).collect()
    config = json.loads(rows[0].value)
    artifacts, limits = config.get("artifacts", {}), config.get("limits", {})
    o = replace(ScanOptions(**({"max_line_length": UNSET_LINE_LENGTH} | options)), **{k: int(limits[k]) for k in _LIMITS if k in limits})
    if "extensions" in artifacts:
        o = replace(o, extension_groups={g: tuple(exts) for g, exts in artifacts["extensions"].items()})
    if "content_files" in artifacts:
        o = replace(o, content_files=tuple(artifacts["content_files"]))
    return Settings(
        options=o,
        pattern_lists=config.get("patterns", {}),
        rules_path=config.get("rules_path", "rules/"),
        cache_dirs=config.get("cache_dirs", {}).get(o.platform, {}),
        base=base.rstrip("/"),
    )
