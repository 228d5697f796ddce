import json
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import files_of
from tracewell.operators import report
from tracewell.operators.hits import HIT_COLUMNS, report_columns
from tracewell.options import ScanOptions
from tracewell.plans.corpus import STARTER_PACKS, STARTER_RULES, corpus
from tracewell.plans.scan import scan, scan_with_filenames
from tracewell.sources.rules import rule_from_dict
from tracewell.sources.settings import read_settings
from tracewell.sources.sinks import write_hits, write_pivot
from tracewell.sources.tree import list_tree, read_tree
from tracewell.streaming.incremental import new_files, scan_stream, stream_tree, write_stream

SF = "/root/testdata/sf0.001"
O = ScanOptions(max_lines_file_scan=20)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "project/src/a.js": b"decode_payload(1)\n// decode_payload(2)\n",
        "project/src/b.PY": b"x = 1  # ENV_READ\nENV_READ\n",
        "project/bin/run.sh": "fetch_tool é\n".encode("latin-1"),
        "project/docs/note.md": b"ENV_READ",
        "project/docs/stage_loader.js": b"",
        "project/Package.JSON": b"ENV_READ",
        "cache/stage_loader.js": b"oin -l",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def roots(tree):
    return {"project": [f"{tree}/project"], "local_cache": [f"{tree}/cache", f"{tree}/missing"]}


def test_tree(spark, tree):
    listing = list_tree(spark, roots(tree))
    assert {(os.path.relpath(r.path, tree), r.length) for r in listing.collect()} == {
        (os.path.relpath(os.path.join(d, n), tree), os.path.getsize(os.path.join(d, n)))
        for top in ("project", "cache") for d, _, names in os.walk(tree / top) for n in names
    }
    files, errors = read_tree(spark, roots(tree))
    assert {os.path.relpath(r.path, tree) for r in files.collect()} == {
        "project/src/a.js", "project/src/b.PY", "project/bin/run.sh", "project/Package.JSON", "cache/stage_loader.js",
        "project/docs/stage_loader.js",
    }
    assert errors.count() == 0
    hits = scan_with_filenames(files, STARTER_PACKS, STARTER_RULES, O, listing=listing).filter("stage IN ('filename', 'pattern')")
    found = {(os.path.relpath(r.file, tree), r.line_number, r.pattern_or_rule, r.line) for r in hits.collect()}
    assert found == {
        ("project/src/a.js", 1, "decode_payload(", "decode_payload(1)"),
        ("project/src/b.PY", 2, "ENV_READ", "ENV_READ"),
        ("project/bin/run.sh", 1, "Fetch_Tool ", "fetch_tool é"),
        ("project/Package.JSON", 1, "ENV_READ", "ENV_READ"),
        ("project/docs/stage_loader.js", 0, "[filename-only]", ""),
        ("cache/stage_loader.js", 1, STARTER_PACKS.content.regex[1], "oin -l"),
    }


def test_links(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real/code.js").write_text("x")
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/alias.txt").symlink_to(tmp_path / "real/code.js")
    (tmp_path / "tree/dir").symlink_to(tmp_path / "real")
    [row] = list_tree(spark, {"project": [f"{tmp_path}/tree"]}).collect()
    assert (row.path, row.basename, row.ext) == (f"{tmp_path}/real/code.js", "alias.txt", ".js")


def test_oversized_files_are_reported_unread(spark, tree):
    files, errors = read_tree(spark, roots(tree), max_bytes=20)
    assert {r.reason for r in errors.collect()} == {"oversized"} and errors.count() == 2
    assert files.count() == 4


def test_stream_equals_batch(spark, tree, tmp_path):
    project = {"project": [f"{tree}/project"]}
    files, _ = read_tree(spark, project)
    # the stream source of Spark sees no empty files
    batch = scan_with_filenames(files.where("octet_length(content) > 0"), STARTER_PACKS, STARTER_RULES, O)
    stream = scan_stream(stream_tree(spark, f"{tree}/project"), STARTER_PACKS, STARTER_RULES, O)
    write_stream(stream, f"{tmp_path}/hits", f"{tmp_path}/checkpoint", available_now=True).awaitTermination(120)
    written = spark.read.parquet(f"{tmp_path}/hits").select(*HIT_COLUMNS)
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, report_columns(batch).collect()))


def test_settings(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/rules.one.json").write_text(
        '{"rules": [{"id": "h", "type": "hex_suspect", "scope": "line", "severity": "low"}]}'
    )
    (tmp_path / "content.txt").write_text('"abc " # x\n')
    config = {
        "limits": {"max_line_length": 50, "max_lines_file_scan": 7},
        "patterns": {"content": "./content.txt"},
        "rules_path": "rules/",
        "artifacts": {"extensions": {"unix_shell": [".sh"], "javascript": [".js"]}, "content_files": ["Pipfile"]},
        "cache_dirs": {"linux": {"local": ["/tmp/none"], "global": ["/tmp"]}},
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    s = read_settings(spark, f"{tmp_path}/config.json", base=str(tmp_path), level="low")
    assert (s.options.max_line_length, s.options.max_lines_file_scan) == (50, 7)
    assert s.options.content_extensions == [".js"] and s.options.block_comment_extensions == [".js"]
    assert s.packs(spark).content.plain == ("abc ",) and [r.id for r in s.rules(spark)] == ["h"]
    assert s.roots("p", local=True) == {"project": ["p"], "local_cache": ["/tmp/none"]}


def test_pivot_counts_records(spark):
    rules = [rule_from_dict({"id": i, "name": "Same", "type": "hex_suspect", "scope": "line", "severity": s}) for i, s in (("a", "low"), ("b", "high"))]
    hits = scan(files_of(spark, {"a.rb": "ab\ncd\n"}), STARTER_PACKS, rules, O)
    assert [h.hits for h in hits.collect()] == [2, 2]
    [row] = report.pivot(hits).collect()
    assert (row.hits, row.type_or_severity) == (2, "high")


def test_report_files(spark, tmp_path):
    files = files_of(spark, {'dir;x/q"1.rb': 'ENV_READ "a"; b\nspawn_shell\n'})
    hits = scan(files, STARTER_PACKS, [], O)
    write_hits(hits, f"{tmp_path}/csv", O, fmt="csv")
    parts = sorted(p for p in os.listdir(tmp_path / "csv") if p.startswith("part-"))
    text = "".join((tmp_path / "csv" / p).read_text() for p in parts)
    lines = text.splitlines()
    assert lines[0] == "file;hits;pattern_or_rule;type_or_severity;rule_id;rule_type;line_number;line"
    assert '"dir;x/q""1.rb";1;"ENV_READ";"normal";;;1;"ENV_READ ""a""; b"' in lines
    write_hits(hits, f"{tmp_path}/parquet", O)
    assert spark.read.parquet(f"{tmp_path}/parquet").filter("scope = 'project'").count() == 2
    assert write_pivot(hits, f"{tmp_path}/pivot")
    assert not write_pivot(hits.filter("false"), f"{tmp_path}/none")


def test_invariants(spark):
    files = corpus(spark, SF).cache()
    rows = lambda o, stage: {(r.file, r.line_number, r.pattern_or_rule) for r in scan(files, STARTER_PACKS, STARTER_RULES, o).filter(F.col("stage") == stage).collect()}
    assert rows(O, "pattern") < rows(ScanOptions(no_bail_out=True, max_lines_file_scan=20), "pattern")
    gated, open_ = rows(O, "line_rule"), rows(ScanOptions(all_matches=True, max_lines_file_scan=20), "line_rule")
    assert {(f, r) for f, _, r in gated} < {(f, r) for f, _, r in open_}
    hits = scan_with_filenames(files, STARTER_PACKS, STARTER_RULES, O)
    assert report.pivot(hits).agg(F.sum("hits")).first()[0] == hits.count()
    files.unpersist()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_scan_has_no_exchange_and_no_python(spark, tmp_path):
    files = files_of(spark, {"a.js": "x"})
    files.write.parquet(f"{tmp_path}/files")
    stored = spark.read.parquet(f"{tmp_path}/files")
    text = plan(scan_with_filenames(stored, STARTER_PACKS, STARTER_RULES, O))
    assert "Exchange" not in text and "Python" not in text and "Window" not in text and "Sort" not in text
    # one pass for names, which leaves the text unread, and one for everything else
    assert text.count("FileScan") == 2
    names = plan(scan_with_filenames(stored, STARTER_PACKS, STARTER_RULES, O).filter("stage = 'filename'"))
    assert "ReadSchema: struct<scope:string,path:string,basename:string>" in names


def test_kept_lines_are_made_once(spark):
    """The comment steps must not be pulled into the expressions that use their result."""
    passes = lambda o: plan(scan(files_of(spark, {"a.js": "x"}), STARTER_PACKS, STARTER_RULES, o)).count("zip_with(_lines")
    assert passes(O.forensic()) == 1
    assert passes(O) == 2  # head, then whole files where the head was not enough


def test_tree_hides_nothing_and_follows_no_directory_links(spark, tmp_path, monkeypatch):
    for name in ("src/__init__.py", "src/_app.js", "src/.eslintrc.js", ".d/h.sh", "_cacache/c.js", "real/b.js"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("ENV_READ\n")
    (tmp_path / "src/empty.py").write_text("")
    (tmp_path / "src/loop").symlink_to(tmp_path)
    (tmp_path / "src/run.txt").symlink_to(tmp_path / "real/b.js")
    (tmp_path / "src/link.py").symlink_to(tmp_path / "real/b.js")
    (tmp_path / "src/stage_loader.js").symlink_to(tmp_path / "nowhere.js")
    roots = {"project": [str(tmp_path)]}
    listed = list_tree(spark, roots).collect()
    names = sorted(n for _, _, files in os.walk(tmp_path) for n in files)
    assert sorted(r.basename for r in listed) == names
    assert {r.ext for r in listed if r.basename in ("run.txt", "link.py")} == {".js"}
    files, errors = read_tree(spark, roots)
    read = {r.basename: bytes(r.content) for r in files.collect()}
    assert set(read) == set(names) - {"stage_loader.js"} and read["empty.py"] == b"" and read["run.txt"] == b"ENV_READ\n"
    assert [(os.path.basename(r.file_id), r.reason) for r in errors.collect()] == [("nowhere.js", "unreadable")]


def test_what_cannot_be_listed_is_an_error(tmp_path, monkeypatch):
    from tracewell.sources import tree

    def scandir(path):
        raise PermissionError(path)

    (tmp_path / "a.js").write_text("x")
    assert [e[0] for e in tree._entries(str(tmp_path))] == ["file"]
    monkeypatch.setattr(tree.os, "scandir", scandir)
    assert [e[:2] for e in tree._entries(str(tmp_path))] == [("error", str(tmp_path))]


def test_new_files(spark, tmp_path):
    (tmp_path / "_a.js").write_text("x")
    first = new_files(spark, {"project": [str(tmp_path)]}, None)
    assert [r.basename for r in first.collect()] == ["_a.js"]
    (tmp_path / ".b.js").write_text("")
    assert [r.basename for r in new_files(spark, {"project": [str(tmp_path)]}, first).collect()] == [".b.js"]


def test_files_rewritten_at_the_same_length_are_new(spark, tmp_path):
    for name in ("a.js", "b.js"):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, ns=(10**18, 10**18))
    rows = new_files(spark, {"project": [str(tmp_path)]}, None)
    seen = spark.createDataFrame(rows.collect(), rows.schema)
    assert new_files(spark, {"project": [str(tmp_path)]}, seen).isEmpty()
    (tmp_path / "b.js").write_text("y")
    assert [r.basename for r in new_files(spark, {"project": [str(tmp_path)]}, seen).collect()] == ["b.js"]
