"""Scanning files as they arrive.

``scan_round`` is one round of a scan on a schedule: it lists the trees, scans what earlier rounds have not seen, hidden,
empty, rewritten and very large files included, and keeps the listing. A round that is lost before its end is done again by
the next, with the same result.

A scan keeps nothing between files and has no exchange, so the batch plan also runs on a stream as it
is: no watermark and no state, and each file is complete in its micro-batch. ``stream_tree`` sees fewer files than
``list_tree`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.sql import check_session
from tracewell.operators.files import with_path_columns
from tracewell.options import ScanOptions
from tracewell.plans.pieces import scan_listed
from tracewell.plans.scan import FILE_COLUMNS, scan_with_filenames
from tracewell.sources.packs import Packs
from tracewell.sources.pieces import PIECE_BYTES
from tracewell.sources.rules import Rule
from tracewell.sources.sinks import write_hits, write_run
from tracewell.sources.tree import as_files, list_everything, list_tree

HITS = (
    "file string, hits int, pattern_or_rule string, type_or_severity string, rule_id string, rule_type string, line_number int, "
    "line string, stage string, seq int, scope string"
)
BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, roots: dict[str, list[str]], seen: DataFrame | None) -> DataFrame:
    """Files of ``list_tree`` that ``seen(path, length, modified)``, an earlier listing, has not, for scans on a schedule.
    It sees every file, hidden and empty ones too, and those rewritten at the same length."""
    return _unseen(list_tree(spark, roots), seen)


def scan_round(
    spark: SparkSession, roots: dict[str, list[str]], state: str, packs: Packs, rules: list[Rule] = (), o: ScanOptions = ScanOptions(),
    piece_bytes: int = PIECE_BYTES,
) -> int:
    """Scans what is new since the last round below ``state`` and returns the round's number. Written are
    ``hits/round=n`` (and by scope), ``errors/round=n``, the partial reports of ``sinks.write_run``, and last, as the mark of a round that is
    done, ``listing/round=n``. A file that was rewritten is scanned again; its earlier hits stay in their round."""
    check_session(spark)
    number, seen = _rounds(spark, state)
    listed = list_everything(spark, roots)
    fresh = _unseen(listed.where("kind = 'file'"), seen)
    hits, errors = scan_listed(fresh.unionByName(listed.where("kind = 'error'")), packs, list(rules), o, piece_bytes)
    write_hits(hits, f"{state}/hits/round={number}", o, mode="overwrite")
    errors.write.mode("overwrite").parquet(f"{state}/errors/round={number}")
    # the round's own folder, so that a listing without hits reads as such
    written = spark.read.schema(HITS).parquet(f"{state}/hits/round={number}")
    write_run(written, as_files(fresh), f"{state}/reports", str(number), o)
    fresh.select("path", "length", "modified").write.mode("overwrite").parquet(f"{state}/listing/round={number}")
    return number


def _rounds(spark: SparkSession, state: str) -> tuple[int, DataFrame | None]:
    """The number of the next round, and what the rounds that are done have seen."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/listing")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return 1, None
    names = [s.getPath() for s in system.listStatus(target)]
    done = [p for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return 1, None
    number = max(int(p.getName().split("=")[1]) for p in done)
    return number + 1, spark.read.schema("path string, length long, modified long").parquet(*[p.toString() for p in done])


def _unseen(files: DataFrame, seen: DataFrame | None) -> DataFrame:
    known = ["path", "length", "modified"]
    return files if seen is None else files.join(seen.select(known).distinct(), known, "left_anti").select(files.columns)


def stream_tree(spark: SparkSession, path: str, scope: str = "project", max_files_per_trigger: int = 10_000) -> DataFrame:
    """New files below ``path``, but not all that ``list_tree`` sees: Spark's file stream passes over files and directories whose
    names start with ``_`` or ``.`` and over empty files, without an error row. ``new_files`` does not."""
    found = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )
    local = found.withColumns({"path": F.regexp_replace("path", "^file:(//(?=/))?", ""), "scope": F.lit(scope)})
    return with_path_columns(local).withColumn("file_id", F.col("path")).select(*FILE_COLUMNS, "content")


def scan_stream(files: DataFrame, packs: Packs, rules: list[Rule] = (), o: ScanOptions = ScanOptions()) -> DataFrame:
    """Hits of a stream of files."""
    return scan_with_filenames(files, packs, rules, o)


def write_stream(hits: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append hits to parquet, a directory per scope."""
    writer = hits.writeStream.format("parquet").partitionBy("scope").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)
