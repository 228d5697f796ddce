"""Small files tables, and plain Python versions of the line semantics to test against."""

from tracewell.operators.files import with_path_columns
from tracewell.plans.scan import FILE_COLUMNS


def files_of(spark, contents: dict, scope: str = "project"):
    """``{path: text or bytes}`` as a files table."""
    raw = any(isinstance(c, bytes) for c in contents.values())
    rows = [(p, scope, p, bytearray(c, "utf-8") if raw and isinstance(c, str) else bytearray(c) if raw else c) for p, c in contents.items()]
    name, kind = ("content", "binary") if raw else ("text", "string")
    frame = spark.createDataFrame(rows, f"file_id string, scope string, path string, {name} {kind}")
    return with_path_columns(frame).select(*FILE_COLUMNS, name)


def cut_hash(line: str) -> str:
    quote = None
    for i, ch in enumerate(line):
        if quote:
            quote = None if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "#":
            return line[:i].rstrip()
    return line


def fold_lines(text: str, dialect: str) -> list[tuple[int, str]]:
    """``(line_no, code)`` of shown lines, walking the file once with explicit state."""
    import re

    shown, inside, odd = [], False, {'"""': False, "'''": False}
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    for no, raw in enumerate(lines, 1):
        code = raw
        if dialect == "shell":
            code = "" if raw.lstrip().startswith("#") else cut_hash(raw)
        elif dialect == "python":
            for q in odd:
                odd[q] ^= raw.count(q) % 2 == 1
            if any(odd.values()) or raw.lstrip().startswith("#"):
                continue
            code = cut_hash(re.sub(r'("""|\'\'\').*?\1', "", raw))
        elif dialect == "block":
            if inside:
                inside = "*/" not in raw
                continue
            code = re.sub(r"/\*.*?\*/", "", raw)
            if "/*" in code:
                inside = True
                continue
            code = code.split("//", 1)[0]
        if code.strip():
            shown.append((no, code))
    return shown
