"""The findings schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.sql import Sql, struct, text

HIT_COLUMNS = [
    "file", "hits", "pattern_or_rule", "type_or_severity", "rule_id", "rule_type", "line_number", "line",
]
# Carried beside the report columns: where a hit came from and its place in report order.
ORIGIN_COLUMNS = ["scope", "stage", "seq"]

HIT_TYPE = (
    "struct<hits:int,pattern_or_rule:string,type_or_severity:string,rule_id:string,"
    "rule_type:string,line_number:int,line:string,stage:string,seq:int>"
)


def hit_struct(
    *,
    stage: str,
    hits: Sql,
    pattern_or_rule: Sql,
    type_or_severity: Sql,
    line_number: Sql,
    line: Sql,
    rule_id: Sql = "''",
    rule_type: Sql = "''",
    seq: int = 0,
) -> Sql:
    return struct(
        hits=hits,
        pattern_or_rule=pattern_or_rule,
        type_or_severity=type_or_severity,
        rule_id=rule_id,
        rule_type=rule_type,
        line_number=line_number,
        line=line,
        stage=text(stage),
        seq=str(seq),
    )


def as_hits(rows: DataFrame, hit: Sql) -> DataFrame:
    """One hit per row of ``rows(path, scope, …)``."""
    found = rows.select(F.col("path").alias("file"), "scope", F.expr(hit).alias("h"))
    return found.select("file", "scope", "h.*").select(*HIT_COLUMNS, *ORIGIN_COLUMNS)


def explode_hits(files: DataFrame, hits: Sql) -> DataFrame:
    """One row per element of an array of hit structs. The outer generator keeps the optimizer
    from adding a size test that would evaluate the whole array expression a second time."""
    rows = files.select(F.col("path").alias("file"), "scope", F.expr(f"inline_outer({hits})"))
    return rows.filter("hits IS NOT NULL").select(*HIT_COLUMNS, *ORIGIN_COLUMNS)


def keep_where(rows: DataFrame, test: Sql) -> DataFrame:
    """Filter on something expensive to derive. A plain filter would be pushed below the
    projections it reads and evaluate them again; one on a generated column stays where it is."""
    tested = rows.select("*", F.expr(f"explode_outer(array({test}))").alias("_keep"))
    return tested.filter("_keep").drop("_keep")


def report_columns(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_COLUMNS)


def all_hits(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
