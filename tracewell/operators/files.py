"""File-level operators: path columns, relevance, directory exclusion, suspicious names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.sql import Sql, any_of, case, is_in, text
from tracewell.functions.text import decode_text
from tracewell.operators.hits import as_hits, hit_struct
from tracewell.options import ScanOptions


def with_path_columns(files: DataFrame) -> DataFrame:
    """Adds basename, ext (last suffix, lower case, '' for dot files) and parent."""
    named = files.withColumns(
        {
            "basename": F.expr("substring_index(path, '/', -1)"),
            "parent": F.expr("CASE WHEN contains(path, '/') THEN substring_index(substring_index(path, '/', -2), '/', 1) ELSE '' END"),
        }
    )
    return named.withColumn("ext", F.expr(rf"lower(regexp_extract(basename, {text(r'(?s)^.+(\.[^.]+)$')}, 1))"))


def scan_kind(o: ScanOptions) -> Sql:
    """'content', 'shell' or null. Content wins where both apply."""
    content_file = is_in("lower(basename)", [name.lower() for name in o.content_files])
    content = any_of([is_in("ext", o.content_extensions), content_file])
    return case((content, "'content'"), (is_in("ext", o.shell_extensions), "'shell'"))


def relevant_files(files: DataFrame, o: ScanOptions) -> DataFrame:
    """Only files some pack applies to, with their ``scan_kind``."""
    kind = F.expr(scan_kind(o))
    return exclude_dirs(files, o).filter(kind.isNotNull()).withColumn("scan_kind", kind)


def exclude_dirs(files: DataFrame, o: ScanOptions) -> DataFrame:
    if not o.exclude_dirs:
        return files
    if o.exclude_mode == "parent":
        return files.filter(~F.col("parent").isin(list(o.exclude_dirs)))
    directories = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return files.filter(~F.arrays_overlap(directories, F.array(*map(F.lit, o.exclude_dirs))))


def filename_hits(files: DataFrame, names: list[str]) -> DataFrame:
    """Project files whose basename equals a listed one. Looks at names only, so it can run on
    a listing and never opens a file; exclusions and relevance do not apply to it."""
    found = files.filter((F.col("scope") == "project") & F.col("basename").isin(names))
    hit = hit_struct(
        stage="filename",
        hits="1",
        pattern_or_rule=text("[filename-only]"),
        type_or_severity=text("filename"),
        line_number="0",
        line="''",
    )
    return as_hits(found, hit)


def with_text(files: DataFrame) -> DataFrame:
    """Files with ``text``, decoded from ``content`` where they come as bytes."""
    if "text" in files.columns:
        return files
    return files.withColumn("text", F.expr(decode_text("content"))).drop("content")


def split_readable(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(readable files with text, errors)``. A file that has no content, or more than the
    caller allows, goes to ``errors(file_id, reason)`` and the scan carries on without it."""
    branches = [("content IS NULL", "'unreadable'")]
    if max_bytes is not None:
        branches.append((f"octet_length(content) > {max_bytes}", "'oversized'"))
    reason = F.expr(case(*branches))
    errors = files.select("file_id", reason.alias("reason")).filter("reason IS NOT NULL")
    return with_text(files.filter(reason.isNull())), errors
