"""Files in pieces give the hits of whole files."""

import io
import os
import random
import re
from collections import Counter
from dataclasses import replace

import pytest

from tests.helpers import files_of
from tracewell.functions.quotes import Literals, summary
from tracewell.options import ScanOptions
from tracewell.plans.corpus import STARTER_PACKS, STARTER_RULES
from tracewell.plans.pieces import scan_table, scan_tree
from tracewell.plans.scan import scan_with_filenames
from tracewell.sources import pieces, tree
from tracewell.sources.packs import Pack, Packs
from tracewell.sources.pieces import read_range
from tracewell.sources.rules import rule_from_dict

PARTS = [
    "x = run_decode(\"aGk=\")  # decode_payload(", "decode_payload( exec_now(1)", "/* note", "a */ b /* c", "*/ ok", "ENV_READ and exec_now(1)",
    '"""', "'''", 's = """open""" + \'\'\'', "plain text of the file", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODk=", "", "   ", "// only", "# only",
    'read("/etc/app_secret")', "the que der <script", 'out += "ka" + word.concat', "  (part) + list.join", "(\"-\") + '\\x6b' \"q", "it's", 'a " b',
    "let _0x51fe=_0x77aa(qwertzuiopasdfgh);" * 20, "spawn_shell now", "ä é ñ", "x" * 300, "run_payload fetch decode", "spawn_abc",
]
EXTRA = [rule_from_dict(raw, "extra", 100 + i) for i, raw in enumerate([
    {"id": "heap", "name": "Heap", "type": "obfuscation_strings", "scope": "file", "severity": "low", "parameters": {"min_score": 40}},
    {"id": "names", "name": "Names", "type": "obfuscation_vars", "scope": "file", "severity": "low", "parameters": {"min_ratio": 0.2}},
    {"id": "low_names", "name": "Low", "type": "obfuscation_vars", "scope": "file", "severity": "high", "only_if_no_match": True,
     "parameters": {"min_ratio": 0.1, "entropy_threshold": 3.0, "min_entropy_hits": 1}},
])]


def random_file(rng, lines):
    ends = rng.choice([["\n"], ["\r\n"], ["\n", "\r", "\r\n"]])
    return "".join(rng.choice(PARTS) + rng.choice(ends) for _ in range(lines)) + rng.choice(["", "last decode_payload("])


def corpus_of(rng, lines=60):
    files = {}
    for i, ext in enumerate([".js", ".py", ".sh", ".java", ".rb", ".conf", ".c", ".ts", ".ps1"] * 3):
        files[f"src/f{i}{ext}"] = random_file(rng, rng.randint(1, lines)).encode()
    files["src/latin.py"] = random_file(rng, 30).encode("latin-1", "replace") + b"\nend \xe9 decode_payload(\n"
    files["src/hidden.js"] = b"/* open\n" + b"decode_payload(\n" * 80 + b"*/\ndecode_payload(\n" * 3
    files["src/quotes.py"] = b"a\n\"\"\"\n" + b"decode_payload( 'x\n" * 60 + b"\"\"\" \ndecode_payload(\n"
    files["src/one.js"] = b"decode_payload(" + b"z" * 900
    files["src/empty.js"] = b""
    files["src/package.json"] = b"\n\n\r\r\n" * 50 + b"decode_payload("
    return files


def rows(df):
    return Counter(tuple(r) for r in df.collect())


OPTIONS = [
    ScanOptions(no_bail_out=True), ScanOptions(), ScanOptions().forensic(), ScanOptions(max_lines_file_scan=7, max_chars_file_scan=400),
    ScanOptions(no_bail_out=True, signature_gate=True), ScanOptions(no_bail_out=True, file_gate="documented"),
    ScanOptions(signature_gate=True, file_gate="documented", max_lines_file_scan=20, max_preview_lines_file=2),
]


@pytest.mark.parametrize("o", OPTIONS)
def test_pieces_equal_whole_files(spark, o):
    files = files_of(spark, corpus_of(random.Random(5)))
    rules = [*STARTER_RULES, *EXTRA]
    expected = rows(scan_with_filenames(files, STARTER_PACKS, rules, o))
    assert len(expected) > 50
    for size in (200, 1000) if o == OPTIONS[0] else (200,):
        assert rows(scan_table(files, STARTER_PACKS, rules, o, size)) == expected


def test_pieces_of_an_extension_in_two_dialects(spark):
    groups = dict(ScanOptions().extension_groups) | {"unix_shell": (".sh", ".js", ".py")}
    o = ScanOptions(no_bail_out=True, extension_groups=groups)
    files = files_of(spark, corpus_of(random.Random(6)))
    expected = rows(scan_with_filenames(files, STARTER_PACKS, STARTER_RULES, o))
    assert rows(scan_table(files, STARTER_PACKS, STARTER_RULES, o, 150)) == expected


def test_pieces_know_their_context_and_python_patterns(spark):
    files = files_of(spark, corpus_of(random.Random(8), 30)).selectExpr(
        "*", "CASE ext WHEN '.js' THEN 'web' WHEN '.py' THEN 'batch' END AS context")
    rules = [replace(r, applies_to=r.applies_to | {"scan_context": ["web"]}) for r in [*STARTER_RULES, *EXTRA]]
    packs = Packs(content=Pack(regex=(r"((?(1)x|decode)_payload)",)), shell=STARTER_PACKS.shell)
    for o in (ScanOptions(no_bail_out=True, context_column="context"), ScanOptions(context_column="context", scan_context="batch")):
        expected = rows(scan_with_filenames(files, packs, rules, o))
        assert rows(scan_table(files, packs, rules, o, 200)) == expected
        of_file = {f.rsplit(".", 1)[1] for f, *_, stage, _ in expected if stage == "file_rule"}
        assert "js" in of_file and "py" not in of_file and ("rb" in of_file) == (o.scan_context is None)


def test_tree_in_pieces(spark, tmp_path, monkeypatch):
    """64 KB pieces of real files, among them what whole files cannot be: one over the size of a row."""
    rng = random.Random(7)
    contents = {p: b"".join([c] * 40) if i % 3 == 0 else c for i, (p, c) in enumerate(corpus_of(rng, 150).items())}
    for path, content in contents.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    roots = {"project": [str(tmp_path)]}
    o = ScanOptions(no_bail_out=True)
    files = files_of(spark, {str(tmp_path / p): c for p, c in contents.items()})
    expected = rows(scan_with_filenames(files, STARTER_PACKS, STARTER_RULES, o))
    hits, errors = scan_tree(spark, roots, STARTER_PACKS, STARTER_RULES, o, 1 << 16)
    assert rows(hits) == expected and errors.collect() == []
    assert max(map(len, contents.values())) > 3 << 16


def test_a_piece_that_cannot_be_read_loses_its_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a.js").write_bytes(b"decode_payload(\n" * 100)
    (tmp_path / "b.js").write_bytes(b"decode_payload(\n" * 100)
    (tmp_path / "c.js").write_bytes(b"decode_payload(\n")

    class Failing(io.BytesIO):
        def read(self, size=-1):
            if self.tell() > 300 or size < 0:
                raise OSError("lost")
            return super().read(size)

    def opened(path):
        return Failing(b"decode_payload(\n" * 100) if "b.js" in path or "c.js" in path else open(path, "rb")

    monkeypatch.setattr(pieces, "_open_at", opened)
    monkeypatch.setattr(tree, "_open", opened)
    hits, errors = scan_tree(spark, {"project": [str(tmp_path)]}, STARTER_PACKS, [], ScanOptions(no_bail_out=True), 200)
    assert {os.path.basename(r["file_id"]) for r in errors.collect()} == {"b.js", "c.js"}
    assert {os.path.basename(r["file"]) for r in hits.collect()} == {"a.js"}


@pytest.mark.parametrize("ahead", [3, 1 << 16])
def test_ranges_part_a_file(monkeypatch, ahead):
    monkeypatch.setattr(pieces, "AHEAD", ahead)
    rng = random.Random(8)
    for _ in range(300):
        data = "".join(rng.choice(["a", "bc", "\n", "\r", "\r\n", "\n\n"]) for _ in range(rng.randint(0, 40))).encode()
        size = rng.randint(1, 12)
        parts = [read_range(io.BytesIO(data), s, min(s + size, len(data))) for s in range(0, len(data), size)]
        assert b"".join(parts) == data
        assert all(not p or re.search(rb"(\n|\r)\Z", p) for p in parts[:-1] if p != b"" and not data.endswith(p))


def test_literals_of_chunks():
    rng = random.Random(9)
    for _ in range(5000):
        lines = ["".join(rng.choice("ab'\"'\" ") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
        cuts = sorted(rng.sample(range(1, len(lines)), rng.randint(0, len(lines) - 1))) if len(lines) > 1 else []
        found = Literals(4)
        for a, b in zip([0, *cuts], [*cuts, len(lines)]):
            found.add(summary("\n".join(lines[a:b]), 4))
        literals = re.findall("'[^']*'|\"[^\"]*\"", "\n".join(lines))
        assert found.counts() == (len(literals), sum(len(x) <= 4 for x in literals))


def test_options_are_those_of_the_scan():
    assert replace(ScanOptions(), no_bail_out=True) == OPTIONS[0]
