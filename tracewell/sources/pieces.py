"""Large files in pieces: byte ranges that executors read, cut at line ends.

A piece holds the lines that begin in its range, so neighbours agree on where a line belongs without seeing each other. A
source of pieces is a table of descriptors ``(…file columns, piece, start, stop)`` and a function that adds ``content``
to descriptors; content that is null could not be read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.files import relevant_files
from tracewell.options import ScanOptions
from tracewell.plans.scan import file_columns
from tracewell.sources.tree import BATCH_BYTES, MAX_FILE_BYTES, _is_local, _local, _remote

PIECE_BYTES = 64 << 20
AHEAD = 1 << 16
PIECES_PER_TASK = 4
_BREAK = re.compile(rb"\r\n|\n|\r")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Pieces:
    descriptors: DataFrame
    read: Callable[[DataFrame], DataFrame]


def _with_ranges(files: DataFrame, piece_bytes: int) -> DataFrame:
    """Descriptors of ``files(…, length)``."""
    columns = [c for c in files.columns if c != "length"]
    last = f"greatest(length - 1, 0) div {piece_bytes}"
    dealt = files.withColumn("piece", F.explode(F.expr(f"sequence(0L, {last})")))
    return dealt.withColumns({
        "start": F.expr(f"piece * {piece_bytes}"), "stop": F.expr(f"least(length, (piece + 1) * {piece_bytes})"),
    }).select(*columns, "piece", "start", "stop")


class _Window:
    """A growing part of a file, from ``at`` on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.ended = file, at, bytearray(), False
        file.seek(at)

    def grow(self, size: int) -> None:
        more = self.file.read(size)
        self.ended = len(more) < size
        self.data += more
        if len(self.data) > MAX_FILE_BYTES:
            raise OSError("a line that no row can hold")

    def after_break(self, place: int) -> int:
        """The first line's beginning after a line end at or behind ``place``, or the end of the file."""
        at = place - self.at
        while True:
            found = _BREAK.search(self.data, at)
            if found and (found.group() != b"\r" or found.end() < len(self.data) or self.ended):
                return self.at + found.end()
            if self.ended:
                return self.at + len(self.data)
            at = found.start() if found else max(at, len(self.data) - 1)
            self.grow(AHEAD)


def read_range(file, start: int, stop: int) -> bytes:
    """The lines of a seekable file that begin in ``[start, stop)``."""
    window = _Window(file, max(start - 1, 0))
    window.grow(stop - window.at)
    begin = window.after_break(start - 1) if start else 0
    end = window.after_break(stop - 1) if begin < stop else begin
    return bytes(window.data[begin - window.at : end - window.at])


def _open_at(path: str):
    if _is_local(path):
        return open(_local(path), "rb")
    system, inner, _ = _remote(path)
    return system.open_input_file(inner)


def _read_pieces(path_at: int, start_at: int, stop_at: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = zip(*(batch.column(i).to_pylist() for i in (path_at, start_at, stop_at)))
            begin, size, contents = 0, 0, []
            for i, (path, start, stop) in enumerate(where):
                try:
                    with _open_at(path) as file:
                        contents.append(read_range(file, start, stop))
                except OSError:
                    contents.append(None)
                size += len(contents[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    rows = batch.slice(begin, len(contents))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(contents, pa.binary())], [*rows.schema.names, "content"])
                    begin, size, contents = i + 1, 0, []

    return read


def read_from_files(descriptors: DataFrame) -> DataFrame:
    """Adds ``content``, read where the task runs. Descriptors travel, contents do not."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in descriptors.schema) + ", content binary"
    places = [descriptors.columns.index(c) for c in ("path", "start", "stop")]
    return descriptors.mapInArrow(_read_pieces(*places), schema)


def tree_pieces(listed: DataFrame, o: ScanOptions, piece_bytes: int = PIECE_BYTES) -> Pieces:
    """Of the files ``listed(…file columns, length)`` that a scan reads and that are longer than a piece."""
    files = relevant_files(listed, o).where(F.col("length") > piece_bytes).select(*file_columns(o), "scan_kind", "length")
    descriptors = _with_ranges(files, piece_bytes)

    def read(rows: DataFrame) -> DataFrame:
        # large ranges, few to a task
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // PIECES_PER_TASK)
        return read_from_files(rows.repartition(tasks))

    return Pieces(descriptors, read)


def _cut(piece_bytes: int, text_at: int, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for row, content in enumerate(batch.column(text_at).to_pylist()):
                whole = content.encode() if isinstance(content, str) else content
                starts = range(0, len(whole), piece_bytes)
                parts = [read_range(io.BytesIO(whole), s, min(s + piece_bytes, len(whole))) for s in starts]
                index = pa.array([row] * len(parts), pa.int64())
                columns = [batch.column(i).take(index) for i, n in enumerate(batch.schema.names) if n != names[text_at]]
                made = [pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())]
                fields = [n for n in batch.schema.names if n != names[text_at]]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*fields, "piece", "content"])

    return cut


def table_pieces(files: DataFrame, o: ScanOptions, piece_bytes: int) -> tuple[DataFrame, Pieces]:
    """``(files of a piece at most, pieces of the others)`` of a table of files with ``text`` or ``content``."""
    body = "text" if "text" in files.columns else "content"
    whole = files.where(F.octet_length(body) <= piece_bytes)
    columns = [*file_columns(o), "scan_kind"]
    large = relevant_files(files.where(F.octet_length(body) > piece_bytes), o).select(*columns, body)
    schema = ", ".join(f"`{c}` string" for c in columns) + ", piece long, content binary"
    parts = large.mapInArrow(_cut(piece_bytes, large.columns.index(body), large.columns), schema)
    sizes = large.select(*columns, F.octet_length(body).cast("long").alias("length"))

    def read(rows: DataFrame) -> DataFrame:
        return rows.join(parts.select(F.col("file_id").alias("_of"), F.col("piece").alias("_nth"), "content"),
                         (F.col("file_id") == F.col("_of")) & (F.col("piece") == F.col("_nth"))).drop("_of", "_nth")

    return whole, Pieces(_with_ranges(sizes, piece_bytes), read)
