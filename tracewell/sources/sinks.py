"""Writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import csv_value
from tracewell.operators import report
from tracewell.operators.hits import HIT_COLUMNS
from tracewell.options import ScanOptions

PIVOT_COLUMNS = ["pattern_or_rule", "type_or_severity", "hits"]


def write_hits(hits: DataFrame, path: str, o: ScanOptions = ScanOptions(), fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """``parquet`` keeps values as they are, a directory per scope, so readers of one scope skip
    the rest. ``csv`` is the ``;`` report: text whose parts joined in order start with the header."""
    if fmt == "parquet":
        hits.write.mode(mode).partitionBy("scope").parquet(path)
    elif fmt == "csv":
        _write_text(report.csv_columns(hits, o), HIT_COLUMNS, path, mode)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_run(hits: DataFrame, files: DataFrame, path: str, run: str, o: ScanOptions = ScanOptions()) -> None:
    """What one run adds to the reports over all runs below ``path``: some rows per pattern and scope, whatever its hits. ``files``
    are those the run scanned. A run that is written again takes the place of what it had written. Meant for written hits."""
    report.pivot_partial(hits).write.mode("overwrite").parquet(f"{path}/pivot/run={run}")
    report.scope_summary(hits, files, o).write.mode("overwrite").parquet(f"{path}/scopes/run={run}")


def pivot_of_runs(spark: SparkSession, path: str) -> DataFrame:
    """The pivot of the hits of all runs below ``path``; no run's hits are read."""
    return report.merged_pivot(spark.read.parquet(f"{path}/pivot"))


def scopes_of_runs(spark: SparkSession, path: str) -> DataFrame:
    return report.merged_scopes(spark.read.parquet(f"{path}/scopes"))


def write_pivot(hits: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """The pivot as a ``;`` report, most hits first; nothing is written when there are no hits.
    Meant for written hits: on a scan's own result, each action here would scan again."""
    if hits.isEmpty():
        return False
    counts = report.pivot(hits)
    quoted = counts.select(
        F.expr(csv_value("pattern_or_rule")).alias("pattern_or_rule"),
        F.expr(csv_value("type_or_severity")).alias("type_or_severity"),
        "hits",
    )
    ordered = quoted.orderBy(F.desc("hits"), "pattern_or_rule")
    _write_text(ordered, PIVOT_COLUMNS, path, mode)
    return True


def _write_text(rows: DataFrame, columns: list[str], path: str, mode: str) -> None:
    """Spark's own CSV quoting is of another kind, so lines are put together first."""
    spark = rows.sparkSession
    header = spark.createDataFrame([(";".join(columns),)], "value string").coalesce(1)
    lines = rows.select(F.concat_ws(";", *[F.col(c).cast("string") for c in columns]).alias("value"))
    header.union(lines).write.mode(mode).text(path)
