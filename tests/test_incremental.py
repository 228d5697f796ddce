"""Rounds of a scan on a schedule, and reports over runs."""

import os
from collections import Counter

import pytest

from tests.helpers import files_of
from tracewell.operators.report import pivot, scope_summary
from tracewell.options import ScanOptions
from tracewell.plans.corpus import STARTER_PACKS, STARTER_RULES
from tracewell.plans.scan import scan_with_filenames
from tracewell.sources.sinks import pivot_of_runs, scopes_of_runs
from tracewell.streaming.incremental import scan_round

O = ScanOptions(no_bail_out=True)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_rounds_add_up_to_one_scan(spark, tmp_path):
    """Hidden and empty files, a file in pieces, one rewritten at the same length, a round without anything new."""
    tree, state = tmp_path / "tree", str(tmp_path / "state")
    tree.mkdir()
    roots = {"project": [str(tree)]}

    def put(name, text, time=None):
        (tree / name).parent.mkdir(exist_ok=True)
        (tree / name).write_text(text)
        if time:
            os.utime(tree / name, ns=(time, time))

    scan = lambda: scan_round(spark, roots, state, STARTER_PACKS, STARTER_RULES, O, 500)
    put("_hidden/.a.js", "decode_payload(1)\n", 10**18)
    put("empty.py", "")
    put("stage_loader.js", "x")
    put("long.rb", "ENV_READ\n/* x */ spawn_shell\n" * 100)
    assert scan() == 1
    assert scan() == 2
    put("new.py", "decode_payload(2)\n")
    put("_hidden/.a.js", "decode_payload(7)\n", 2 * 10**18)
    assert scan() == 3
    hits = spark.read.parquet(f"{state}/hits")
    of_round = {n: {os.path.basename(r["file"]) for r in hits.where(f"round = {n}").collect()} for n in (1, 2, 3)}
    assert of_round == {1: {".a.js", "stage_loader.js", "long.rb"}, 2: set(), 3: {"new.py", ".a.js"}}
    # the reports are those of all that the rounds scanned
    counts = {r["pattern_or_rule"]: r["hits"] for r in pivot_of_runs(spark, f"{state}/reports").collect()}
    assert counts == {r["pattern_or_rule"]: r["count"] for r in hits.groupBy("pattern_or_rule").count().collect()}
    scanned = scopes_of_runs(spark, f"{state}/reports").collect()
    assert [(r["scope"], r["files_scanned"], r["total_hits"]) for r in scanned] == [("project", 6, hits.count())]


def test_a_round_that_was_lost_is_done_again(spark, tmp_path):
    tree, state = tmp_path / "tree", tmp_path / "state"
    tree.mkdir()
    (tree / "a.js").write_text("decode_payload(1)\n")
    scan = lambda: scan_round(spark, {"project": [str(tree)]}, str(state), STARTER_PACKS, (), O)
    assert scan() == 1
    (state / "listing" / "round=1" / "_SUCCESS").unlink()  # lost before its end
    assert scan() == 1 and scan() == 2
    assert spark.read.parquet(f"{state}/hits").count() == 1
    assert {r["hits"] for r in pivot_of_runs(spark, f"{state}/reports").collect()} == {1}


@pytest.mark.parametrize("runs", [1, 4])
def test_reports_over_runs(spark, tmp_path, runs):
    from tracewell.sources.sinks import write_run

    files = files_of(spark, {f"f{i}.js": f"decode_payload({i})\nENV_READ\nspawn_shell" for i in range(20)}).cache()
    hits = scan_with_filenames(files, STARTER_PACKS, STARTER_RULES, O).cache()
    for n in range(runs):
        part = lambda c: f"crc32({c}) % {runs} = {n}"  # noqa: E731, B023
        for _ in range(2):  # written again, it counts once
            write_run(hits.where(part("file")), files.where(part("path")), str(tmp_path), str(n), O)
    assert rows(pivot_of_runs(spark, str(tmp_path))) == rows(pivot(hits))
    whole = scope_summary(hits, files, O)
    assert rows(scopes_of_runs(spark, str(tmp_path)).select(whole.columns)) == rows(whole)
