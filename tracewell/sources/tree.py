"""Directory trees as files tables.

One lister serves every reader: directories are listed on the executors, level by level, and contents are opened
there too, each file's or directory's failure being a row. Trees of very many small files are slow to list and to
open; corpora of that kind are better kept as a table of ``(path, content)`` rows, which every operator takes as well.
"""

from __future__ import annotations

import os
import stat
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.files import relevant_files, with_path_columns
from tracewell.options import ScanOptions
from tracewell.plans.scan import FILE_COLUMNS
from tracewell.sources.tables import kept_for_good

# The most a row's binary value can hold; larger files are reported, not read.
MAX_FILE_BYTES = (1 << 31) - 1 - (1 << 20)
PIECE_ENTRIES = 4096
BATCH_BYTES = 32 << 20
DIRECTORIES_PER_TASK = 256
FILES_PER_TASK = 4096
LISTED = "scope string, kind string, path string, name string, length long, modified long"

# Arrow's names of schemes that Hadoop knows by others.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def _local(path: str) -> str:
    path = path.removeprefix("file:")
    return "/" + path.lstrip("/") if path.startswith("//") else path


def _remote(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """File system, path in it, and what to put before its paths to have the caller's again."""
    scheme, rest = path.split("://", 1)
    system, inner = arrow_fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def _entries(directory: str) -> Iterator[tuple[str, str, str, int, int]]:
    """``(kind, path, name, length, modified)`` of what is directly in a directory: ``directory``, ``file``, or ``error`` for
    what cannot be looked at. Links to files are resolved and links to directories not entered; a link to
    nothing is a file by its name."""
    try:
        if not _is_local(directory):
            system, inner, before = _remote(directory)
            for info in system.get_file_info(arrow_fs.FileSelector(inner)):
                kind = "directory" if info.type == arrow_fs.FileType.Directory else "file"
                yield kind, before + info.path, info.base_name, info.size or 0, info.mtime_ns or 0
            return
        with os.scandir(_local(directory)) as entries:
            for entry in entries:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield "directory", entry.path, entry.name, 0, 0
                    elif entry.is_symlink() and not os.path.exists(entry.path):
                        yield "file", os.path.realpath(entry.path), entry.name, 0, 0
                    else:
                        found = entry.stat()
                        if stat.S_ISREG(found.st_mode):
                            yield "file", os.path.realpath(entry.path), entry.name, found.st_size, found.st_mtime_ns
                except OSError:
                    yield "error", entry.path, entry.name, 0, 0
    except OSError:
        yield "error", directory, os.path.basename(directory), 0, 0


# Workers need not have this package: what runs there is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["scope", "kind", "path", "name", "length", "modified"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 2

    def piece(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    rows = []
    for batch in batches:
        for scope, directory in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for entry in _entries(directory):
                rows.append((scope, *entry))
                if len(rows) == PIECE_ENTRIES:
                    yield piece(rows)
                    rows = []
    if rows:
        yield piece(rows)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    conf, found = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            found.append(path)
    return found


def list_everything(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """``(scope, kind, path, name, length, modified)`` of all files below ``{scope: [directories]}`` and of what could not be
    looked at. Each round lists one level of directories in tasks of some hundred directories; the driver holds the
    roots only. Directories that do not exist are left out."""
    given = [(scope, path) for scope, paths in roots.items() for path in _existing(spark, paths)]
    if not given:
        raise ValueError(f"none of the directories exist: {roots}")
    level, waiting, found = spark.createDataFrame(given, "scope string, path string"), len(given), None
    while waiting:
        tasks = max(1, min(waiting, max(spark.sparkContext.defaultParallelism, waiting // DIRECTORIES_PER_TASK)))
        listed = kept_for_good(level.repartition(tasks).mapInArrow(_list_level, LISTED))
        part = listed.where("kind <> 'directory'")
        found = part if found is None else found.union(part)
        level = listed.where("kind = 'directory'").select("scope", "path")
        waiting = level.count()
    return found


def as_files(listed: DataFrame) -> DataFrame:
    files = with_path_columns(listed.where("kind = 'file'"))
    return files.withColumns({"basename": F.col("name"), "file_id": F.col("path")}).select(*FILE_COLUMNS, "length", "modified")


def list_tree(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """All files below ``{scope: [directories]}`` with their length and time of modification (nanoseconds since 1970, 0 where
    none is known), none of them opened, empty and hidden ones included. ``ext`` is that of the file a link leads to, ``basename`` the link's own."""
    return as_files(list_everything(spark, roots))


def _open(path: str):
    if _is_local(path):
        return open(_local(path), "rb")
    system, inner, _ = _remote(path)
    return system.open_input_stream(inner)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, size, contents = 0, 0, []
        for i, path in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            try:
                with _open(path) as file:
                    contents.append(file.read())
            except OSError:
                contents.append(None)
            size += len(contents[-1] or b"")
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                rows = batch.slice(start, len(contents))
                columns = [*rows.columns[:-1], pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names[:-1], "content"])
                start, size, contents = i + 1, 0, []


def read_tree(
    spark: SparkSession, roots: dict[str, list[str]], o: ScanOptions = ScanOptions(), max_bytes: int = MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(files with content, scan_errors)`` of the files a scan reads, empty ones included.

    Relevance and size are settled on the listing, so other files are never opened, and the others are opened once: contents
    are written in the shared folder, and files and errors are read from there. Errors are ``oversized`` files (``plans.pieces``
    scans those too), and files and directories that are ``unreadable``, be it from the first byte or a later one."""
    listed = list_everything(spark, roots)
    return read_listed(listed, o, max_bytes)


def read_listed(listed: DataFrame, o: ScanOptions, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``read_tree`` of what ``list_everything`` found."""
    files = relevant_files(as_files(listed), o).select(*FILE_COLUMNS, "length")
    fits = files.where(F.col("length") <= max_bytes)
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, fits.count() // FILES_PER_TASK)
    dealt = fits.repartition(tasks).select(*FILE_COLUMNS, F.col("path").alias("where"))
    schema = ", ".join(f"{c} string" for c in FILE_COLUMNS) + ", content binary"
    read = kept_for_good(dealt.mapInArrow(_contents, schema))
    lost = read.where("content IS NULL").select("file_id").union(listed.where("kind = 'error'").select(F.col("path")))
    oversized = files.where(F.col("length") > max_bytes).select("file_id", F.lit("oversized").alias("reason"))
    return read.where("content IS NOT NULL"), oversized.union(lost.withColumn("reason", F.lit("unreadable")))
