"""From file text to the lines a scan looks at.

Everything stays in the file's row: the text is split into an array, comments are cut, hidden
lines dropped and the bail-out prefix taken with array functions. A corpus scan therefore has
no exchange before its findings, and a file that is far larger than others costs its own task
only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import comments as C
from tracewell.functions.sql import Sql, case, is_in, let, struct, text, transform, where
from tracewell.functions.text import has_text, prefix_length, split_lines
from tracewell.options import PYTHON_EXTENSION, ScanOptions

_CODE = {"shell": C.shell_code, "python": C.python_code, "block": C.block_code}
_SYMBOL = {"python": C.python_symbol, "block": C.block_symbol}
_MASK = {"python": ("[dsb]", C.python_mask), "block": ("[ob]", C.block_mask)}
_CHANGE = {"python": C.python_change, "block": C.block_change}
_NO_MASK = "CAST(array() AS array<string>)"


def comment_rounds(o: ScanOptions) -> list[dict[str, list[str]]]:
    """``[{dialect: extensions}]`` in the order they are applied. One round, unless settings put
    an extension in two dialects."""
    dialects: dict[str, list[str]] = {}
    for name, exts in (
        ("shell", o.shell_extensions),
        ("python", [PYTHON_EXTENSION]),
        ("block", o.block_comment_extensions),
    ):
        for ext in dict.fromkeys(exts):
            dialects.setdefault(ext, []).append(name)
    rounds: list[dict[str, list[str]]] = []
    for ext, names in dialects.items():
        for i, name in enumerate(names):
            if i == len(rounds):
                rounds.append({})
            rounds[i].setdefault(name, []).append(ext)
    return rounds


def _numbered(lines: Sql) -> Sql:
    return f"transform({lines}, (x, i) -> {struct(line_no='i + 1', raw='x', code='x', sym=text('n'))})"


def _cut_comments(lines: Sql, plan: dict[str, list[str]]) -> Sql:
    """Each line on its own: code without comments, and its symbol."""

    def with_dialect(name: str) -> Sql:
        return transform(
            lines,
            lambda x: struct(
                line_no=f"{x}.line_no",
                raw=f"{x}.raw",
                code=_CODE[name](f"{x}.raw", f"{x}.code"),
                sym=_SYMBOL[name](f"{x}.code") if name in _SYMBOL else "'n'",
            ),
        )

    return case(*[(is_in("ext", exts), with_dialect(name)) for name, exts in plan.items()], default=lines)


def _masks(lines: Sql, plan: dict[str, list[str]], inside: Sql | None = None) -> Sql:
    """One '1' per hidden line, or an empty array where the file has no multi-line comment. ``inside`` has the comment
    state before the first line (``b``, ``d``, ``s``)."""
    began = f"{inside}.b OR {inside}.d OR {inside}.s OR " if inside else ""

    def masked(trigger: str, mask) -> Sql:
        return let(
            C.symbols_of(lines), lambda s: case((f"{began}rlike({s}, {text(trigger)})", mask(s, inside)), default=_NO_MASK)
        )

    return case(
        *[(is_in("ext", plan[name]), masked(*how)) for name, how in _MASK.items() if name in plan], default=_NO_MASK
    )


def _without_hidden(lines: Sql, masks: Sql) -> Sql:
    shown = f"zip_with({lines}, {masks}, (x, m) -> CASE WHEN m = '1' THEN NULL ELSE x END)"
    return where(shown, lambda x: f"{x} IS NOT NULL AND {has_text(f'{x}.code')}")


def comment_change(lines: Sql, plan: dict[str, list[str]]) -> Sql:
    """What the lines of a piece do to the comment state."""
    changes = [
        (is_in("ext", plan[name]), let(C.symbols_of(lines), change)) for name, change in _CHANGE.items() if name in plan]
    return case(*changes, default=C.NO_CHANGE)


# Lines looked at first when a scan may bail out, per line it may keep.
HEAD_LINES = 4


def with_kept_lines(files: DataFrame, o: ScanOptions) -> DataFrame:
    """Replaces ``text`` by ``kept array<struct<line_no, raw, code, sym>>``: lines that still have
    text once comments are cut, down to where the scan bails out.

    A scan that bails out needs few lines of a long file, but how many depends on what is skipped.
    So the head of the file is prepared first, and the whole of it only for files whose head does
    not reach a limit; nearly all long files do, and the others come out exact all the same.
    """
    if o.no_bail_out:
        return _with_shown_lines(files, "text", "kept", o)
    others = [c for c in files.columns if c != "text"]
    head = f"substring_index(text, {text(chr(10))}, {HEAD_LINES * o.max_lines_file_scan})"
    step = files.select("*", F.expr(head).alias("_head"))
    beyond = case(("octet_length(_head) < octet_length(text)", "text"))
    step = step.select(*others, "_head", F.expr(beyond).alias("_rest"))
    step = _with_shown_lines(step, "_head", "kept", o).withColumn("_n", F.expr(_fitting("kept", o)))
    reached = f"_n < size(kept) OR _n = {o.max_lines_file_scan}"
    step = step.select(
        *others,
        F.expr("slice(kept, 1, _n)").alias("kept"),
        F.expr(case((reached, "NULL"), default="_rest")).alias("_rest"),
    )
    step = _with_shown_lines(step, "_rest", "_all", o)
    return step.select(*others, F.expr(f"coalesce(slice(_all, 1, {_fitting('_all', o)}), kept)").alias("kept"))


def _fitting(lines: Sql, o: ScanOptions, items: Sql = "0", weight: Sql = "0L") -> Sql:
    return prefix_length(
        lines, lambda x: f"length({x}.raw)", o.max_lines_file_scan, o.max_chars_file_scan, items, weight)


def _with_shown_lines(files: DataFrame, source: str, name: str, o: ScanOptions) -> DataFrame:
    """Replaces the text in ``source`` by its lines that have text once comments are cut.

    Steps are separate projections because each array is used several times in the next one;
    Catalyst keeps such projections apart instead of evaluating the array again.
    """
    others = [c for c in files.columns if c != source]
    step = files.select(*others, F.expr(_numbered(split_lines(source))).alias("_lines"))
    for plan in comment_rounds(o):
        step = step.select(*others, F.expr(_cut_comments("_lines", plan)).alias("_lines"))
        step = step.select(*others, F.expr(_without_hidden("_lines", _masks("_lines", plan))).alias("_lines"))
    return step.withColumnRenamed("_lines", name)


def kept_lines(files: DataFrame) -> DataFrame:
    """One row per kept line, ``(…file columns, line_no, raw, code)``."""
    others = [c for c in files.columns if c != "kept"]
    return files.select(*others, F.inline_outer("kept")).drop("sym").filter("line_no IS NOT NULL")


def raw_lines(files: DataFrame) -> DataFrame:
    """Every line of every file, ``(…file columns, line_no, raw)``."""
    others = [c for c in files.columns if c != "text"]
    rows = files.select(*others, F.posexplode_outer(F.expr(split_lines("text"))).alias("pos", "raw"))
    return rows.filter("raw IS NOT NULL").select(*others, F.expr("pos + 1").alias("line_no"), "raw")


def file_text(kept: Sql, max_chars: int | None) -> Sql:
    """Original text of the kept lines; cut where the scan bails out."""
    joined = f"array_join({transform(kept, lambda x: f'{x}.raw')}, {text(chr(10))})"
    return joined if max_chars is None else f"substring({joined}, 1, {max_chars})"
