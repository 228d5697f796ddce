"""Scans in which no file is one row: small files whole, large ones in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.functions.sql import check_session
from tracewell.operators.files import filename_hits
from tracewell.operators.hits import all_hits
from tracewell.operators.pieces import scan_pieces
from tracewell.options import ScanOptions
from tracewell.plans.scan import scan
from tracewell.sources.packs import Packs
from tracewell.sources.pieces import PIECE_BYTES, table_pieces, tree_pieces
from tracewell.sources.rules import Rule
from tracewell.sources.tree import as_files, list_everything, read_listed


def scan_tree(
    spark: SparkSession, roots: dict[str, list[str]], packs: Packs, rules: list[Rule] = (), o: ScanOptions = ScanOptions(),
    piece_bytes: int = PIECE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(hits, scan_errors)`` of directory trees ``{scope: [directories]}``, file names included. Files of more than ``piece_bytes``
    are scanned in pieces, whatever their size; hits do not depend on where the pieces are cut. What cannot be read to its end
    is an ``unreadable`` row and gives no hits but by its name, as is a file with a line that no row can hold (2 GB)."""
    check_session(spark)
    return scan_listed(list_everything(spark, roots), packs, rules, o, piece_bytes)


def scan_listed(
    listed: DataFrame, packs: Packs, rules: list[Rule] = (), o: ScanOptions = ScanOptions(), piece_bytes: int = PIECE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``scan_tree`` of what ``list_everything`` found, or a part of it."""
    files = as_files(listed)
    whole, errors = read_listed(listed, o, piece_bytes)
    large, lost = scan_pieces(tree_pieces(files, o, piece_bytes), packs, list(rules), o)
    hits = all_hits(filename_hits(files, list(packs.names)), scan(whole, packs, rules, o), large)
    return hits, errors.where("reason <> 'oversized'").union(lost)


def scan_table(
    files: DataFrame, packs: Packs, rules: list[Rule] = (), o: ScanOptions = ScanOptions(), piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """The hits of ``scan_with_filenames`` on a table of files, those of more than ``piece_bytes`` scanned in pieces."""
    check_session(files.sparkSession)
    whole, pieces = table_pieces(files, o, piece_bytes)
    large, _ = scan_pieces(pieces, packs, list(rules), o)
    return all_hits(filename_hits(files, list(packs.names)), scan(whole, packs, rules, o), large)
