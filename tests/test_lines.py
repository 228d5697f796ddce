import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import files_of, fold_lines
from tracewell.functions.text import csv_value, decode_text, split_lines
from tracewell.operators.files import exclude_dirs, filename_hits, relevant_files, split_readable
from tracewell.operators.lines import comment_rounds, kept_lines, raw_lines, with_kept_lines
from tracewell.options import EXTENSION_GROUPS, ScanOptions

FORENSIC = ScanOptions().forensic()


def kept(spark, contents, o=FORENSIC):
    rows = kept_lines(with_kept_lines(files_of(spark, contents), o)).select("path", "line_no", "code").collect()
    found = {p: [] for p in contents}
    for r in sorted(rows):
        found[r.path].append((r.line_no, r.code))
    return found


def test_universal_newlines(spark):
    rows = raw_lines(files_of(spark, {"a.txt": "a\r\nb\rc\n\nd\n", "empty.txt": "", "nl.txt": "\n"})).collect()
    assert sorted((r.path, r.line_no, r.raw) for r in rows) == [
        ("a.txt", 1, "a"), ("a.txt", 2, "b"), ("a.txt", 3, "c"), ("a.txt", 4, ""), ("a.txt", 5, "d"), ("nl.txt", 1, ""),
    ]


def test_other_separators_do_not_split(spark):
    value = "a b\x0bc\x85d"
    assert spark.createDataFrame([(value,)], "t string").select(F.expr(split_lines("t"))).first()[0] == [value]


def test_decode_falls_back_for_the_whole_value(spark):
    frame = spark.createDataFrame([(bytearray(b"\xe9t"),), (bytearray("é".encode()),), (bytearray(b"\xef\xbb\xbfx"),)], "c binary")
    assert [r[0] for r in frame.select(F.expr(decode_text("c"))).collect()] == ["ét", "é", "﻿x"]


@pytest.mark.parametrize("name, ext", [("a.tar.GZ", ".gz"), (".bashrc", ""), ("Pipfile", ""), ("x.", "")])
def test_suffix(spark, name, ext):
    row = files_of(spark, {f"/p/q/{name}": ""}).first()
    assert (row.basename, row.ext, row.parent) == (name, ext, "q")


def test_relevance(spark):
    files = files_of(spark, {p: "" for p in ("x.cs", "run.ps1", "a.JS", "b.sh", "PACKAGE.json", "n.txt", "Pipfile")})
    kinds = lambda o: {r.path: r.scan_kind for r in relevant_files(files, o).collect()}
    assert kinds(ScanOptions()) == {"a.JS": "content", "b.sh": "shell", "PACKAGE.json": "content", "Pipfile": "content"}
    assert kinds(ScanOptions(platform="windows"))["run.ps1"] == "shell"


def test_exclude_dirs(spark):
    files = files_of(spark, {"node_modules/a.js": "", "node_modules/p/b.js": "", "src/c.js": ""})
    left = lambda mode: {r.path for r in exclude_dirs(files, ScanOptions(exclude_dirs=("node_modules",), exclude_mode=mode)).collect()}
    assert left("parent") == {"node_modules/p/b.js", "src/c.js"}
    assert left("subtree") == {"src/c.js"}


def test_filename_hits(spark):
    project = files_of(spark, {"node_modules/bad.js": "", "BAD.js": ""})
    cache = files_of(spark, {"cache/bad.js": ""}, scope="local_cache")
    hits = filename_hits(project.unionByName(cache), ["bad.js"]).collect()
    assert [(h.file, h.hits, h.pattern_or_rule, h.type_or_severity, h.line_number, h.line) for h in hits] == [
        ("node_modules/bad.js", 1, "[filename-only]", "filename", 0, "")
    ]


def test_errors_are_set_apart(spark):
    files = spark.createDataFrame([("a", None), ("b", bytearray(b"xxxx")), ("c", bytearray(b"x"))], "file_id string, content binary")
    readable, errors = split_readable(files, max_bytes=2)
    assert sorted(map(tuple, errors.collect())) == [("a", "unreadable"), ("b", "oversized")]
    assert [r.text for r in readable.collect()] == ["x"]


def test_shell_comments(spark):
    text = "#!/bin/sh\necho '#x' # y\na \"open # z\n  # c\nb=\"#\" 'c' # d\n"
    assert kept(spark, {"a.sh": text})["a.sh"] == [(2, "echo '#x'"), (3, 'a "open # z'), (5, "b=\"#\" 'c'")]


def test_python_comments(spark):
    text = 's = """open\nhidden\n""" ; shown(3)\nx = """a""" # b\n# """\nstill hidden\n# """\ny = 1\n'
    assert kept(spark, {"a.py": text})["a.py"] == [(3, '""" ; shown(3)'), (4, "x ="), (8, "y = 1")]


def test_block_comments(spark):
    text = '/* note\ninside\n*/ after\nok = 1\na /* b */ c /* d\nx */ y\ncall("http://h"); f(1)\n// all\n'
    assert kept(spark, {"a.js": text})["a.js"] == [(4, "ok = 1"), (7, 'call("http:')]
    assert kept(spark, {"a.rb": 'call("http://h")'})["a.rb"] == [(1, 'call("http://h")')]


@pytest.mark.parametrize("dialect, ext", [("shell", ".sh"), ("python", ".py"), ("block", ".java")])
def test_random_files_against_a_fold(spark, dialect, ext):
    rng = random.Random(7)
    parts = ["/*", "*/", "//", "#", "'", '"', '"""', "'''", "a", " ", "\t", "x = 1", "é", "*", "/", "　", "\n", "\n", "\r\n"]
    contents = {f"f{i}{ext}": "".join(rng.choices(parts, k=rng.randint(0, 120))) for i in range(400)}
    assert kept(spark, contents) == {p: fold_lines(t, dialect) for p, t in contents.items()}


def test_long_lines_do_not_recurse(spark):
    line = "'a' b " * 60_000 + "# c"
    [(no, code)] = kept(spark, {"a.sh": line})["a.sh"]
    assert code == ("'a' b " * 60_000).rstrip()


def test_extension_in_two_dialects(spark):
    groups = {**EXTENSION_GROUPS, "unix_shell": (".sh", ".php")}
    o = ScanOptions(extension_groups=groups, no_bail_out=True)
    assert len(comment_rounds(o)) == 2
    text = "# gone\na /* b */ c # d\n/* e # f\n*/\ng // h\n"
    # '#' is cut first, so the third line still opens a block
    assert kept(spark, {"a.php": text}, o)["a.php"] == [(2, "a  c"), (5, "g ")]


def test_bail_out_counts_kept_lines_only(spark):
    text = "".join(f"# skipped\nx{i}\n" for i in range(250))
    lines = kept(spark, {"a.sh": text}, ScanOptions())["a.sh"]
    assert [c for _, c in lines] == [f"x{i}" for i in range(200)]


@pytest.mark.parametrize("dialect, ext", [("python", ".py"), ("block", ".java"), ("none", ".rb")])
def test_bail_out_of_long_files(spark, dialect, ext):
    """Heads that reach a limit, heads that do not, and every kind of newline."""
    rng = random.Random(8)
    o = ScanOptions(max_lines_file_scan=3, max_chars_file_scan=25)
    lines = ["x = 1", "# c", "", "  ", "/*", "*/ y", '"""', "z" * 9, "é // q"]
    contents = {
        f"f{i}{ext}": rng.choice(["\n", "\n", "\r\n", "\r"]).join(rng.choices(lines, k=rng.randint(0, 60))) for i in range(300)
    }

    def expected(text):
        raws = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        left, chars = [], 0
        for no, code in fold_lines(text, dialect):
            if len(left) < 3 and chars < 25:
                left.append((no, code))
            chars += len(raws[no - 1])
        return left

    assert kept(spark, contents, o) == {p: expected(t) for p, t in contents.items()}


def test_bail_out_keeps_the_crossing_line(spark):
    text = "a" * 15_000 + "\n" + "b" * 6_000 + "\n" + "c" * 10
    assert [no for no, _ in kept(spark, {"a.rb": text}, ScanOptions())["a.rb"]] == [1, 2]
    assert len(kept(spark, {"a.rb": text})["a.rb"]) == 3


def test_csv_values(spark):
    one = lambda value, *args: spark.createDataFrame([(value,)], "v string").select(F.expr(csv_value("v", *args))).first()[0]
    assert one('say "hi"; x') == '"say ""hi""; x"'
    assert one("a" * 101, 100) == '"' + "a" * 100 + ' [truncated]"'
    assert one('"' * 60, 100) == '"' + '"' * 100 + ' [truncated]"'
    assert one(None) == "" and one(" \n ") == ""
    assert one("a\nb\rc") == '"a b c"'
    assert one("a\nb", None, False) == '"a\nb"'
