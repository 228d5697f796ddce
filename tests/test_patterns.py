import random
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import files_of
from tracewell.functions import grams
from tracewell.functions.regex import check_pattern, java_pattern, needs_python, required_literals
from tracewell.operators.lines import kept_lines
from tracewell.operators import patterns
from tracewell.operators.patterns import gram_filter, pattern_hits, pattern_table_hits
from tracewell.options import ScanOptions
from tracewell.plans.corpus import STARTER_PACKS
from tracewell.plans.scan import prepare, scan
from tracewell.sources.rules import rule_from_dict
from tracewell.sources.packs import Pack, Packs, default_packs, parse_pattern_lines, patterns_table, read_patterns

O = ScanOptions()


def hits_of(spark, contents, packs=STARTER_PACKS, mode="first"):
    lines = kept_lines(prepare(files_of(spark, contents), O))
    rows = pattern_hits(lines, packs, O, mode).collect()
    return sorted((r.file, r.line_number, r.pattern_or_rule, r.type_or_severity) for r in rows)


def test_first_match_wins(spark):
    assert hits_of(spark, {"a.js": "ENV_READ and exec_now(1)"}) == [("a.js", 1, "ENV_READ", "normal")]
    assert len(hits_of(spark, {"a.js": "ENV_READ and exec_now(1)"}, mode="all")) == 2


def test_regex_boundaries_and_case(spark):
    contents = {"a.rb": "/bin/Spawn_Shell\nmy_spawn_shell\nçoin\nOIÉ x\n", "b.rb": "ſpawn_shell"}
    found = [(f, n) for f, n, _, kind in hits_of(spark, contents) if kind == "regex"]
    assert found == [("a.rb", 1), ("a.rb", 4), ("b.rb", 1)]


def test_pack_follows_scan_kind(spark):
    packs = Packs(content=Pack(("alpha",)), shell=Pack(("beta",)))
    assert hits_of(spark, {"package.json": "beta", "x.sh": "beta", "y.js": "alpha"}, packs) == [
        ("x.sh", 1, "beta", "normal"), ("y.js", 1, "alpha", "normal"),
    ]


def test_scan_and_line_operator_agree(spark):
    rng = random.Random(3)
    words = ["decode_payload(", "fetch_tool ", "env_read", "spawn_shell", "exec_now", "nc", "x", " ", "#", "//", "\n", "é"]
    contents = {f"f{i}{rng.choice(['.js', '.sh', '.py', '.conf'])}": "".join(rng.choices(words, k=60)) for i in range(80)}
    fused = scan(files_of(spark, contents), STARTER_PACKS, [], O).collect()
    assert sorted((r.file, r.line_number, r.pattern_or_rule, r.type_or_severity) for r in fused) == hits_of(spark, contents)


def test_hundreds_of_patterns(spark, capfd):
    plain = tuple(f"needle_{i}(" for i in range(300))
    regex = tuple(rf"(^|[^a-z])(hook{i}|probe{i})\b" for i in range(60))
    pack = Packs(content=Pack(plain, regex), shell=Pack(plain, regex))
    contents = {"a.js": "x\nNEEDLE_7( needle_8(\n probe59\n", "b.sh": "needle_299("}
    expected = [("a.js", 2, "needle_7(", "normal"), ("a.js", 3, regex[59], "regex"), ("b.sh", 1, "needle_299(", "normal")]
    capfd.readouterr()
    assert hits_of(spark, contents, pack) == expected
    assert len(hits_of(spark, contents, pack, "all")) == 4
    assert "Failed to compile" not in capfd.readouterr().err
    fused = scan(files_of(spark, contents), pack, [], O).collect()
    assert sorted((r.file, r.line_number, r.pattern_or_rule, r.type_or_severity) for r in fused) == expected


def test_evidence_is_stripped_and_cut(spark):
    text = "  " + "ENV_READ" + "y" * 200 + "  "
    [row] = scan(files_of(spark, {"a.js": text}), STARTER_PACKS, [], O).collect()
    assert row.line == ("ENV_READ" + "y" * 92) + " [truncated]"


@pytest.mark.parametrize(
    "pattern, words",
    [
        (r"(^|[^A-Za-z0-9_\$])(spawn_shell|exec_now)\b", {"spawn_shell", "exec_now"}),
        (r"(^|\W)(curl|wget)\b", {"curl", "wget"}),
        (r"JSON\.parse\s*\(\s*atob", {"JSON.parse"}),
        (r"a?bc*(def)+", {"def"}),
        (r"(foo|x*)bar", {"bar"}),
        (r"foo|\d+", set()),
        (r"(?i)abc", set()),
        (r"[abc]{3}", set()),
    ],
)
def test_required_literals(pattern, words):
    assert set(required_literals(pattern)) == words


def test_required_literals_never_lose_a_match():
    rng = random.Random(11)
    patterns = [
        r"(^|\W)(ruby)\s+-e\s", r"\b(ab|abc|b)\b", r"(?:ab){2,}c?", r"a(b|c(d|e))f", r"(ab)?cd|ef", r"ab(?=cd)", r"(ab|cd)*x",
        r"a\.b", r"(a|b)(ab|ba)", r"(?P<q>ab)(?P=q)", r"[^a]bc+?d",
    ]
    for pattern in patterns:
        literals = required_literals(pattern)
        for _ in range(3000):
            text = "".join(rng.choices("abcdefx. -e\nruby", k=rng.randint(0, 12)))
            if re.search(pattern, text) and literals:
                assert any(w in text for w in literals), (pattern, text)


def test_java_spelling(spark):
    assert java_pattern(r"(^|[^a\$])x") == r"(?d)(?<![a\x{24}])()x"
    cases = [(r"(^|[^b])(a)\2", "xaa"), (r"(?P<a_b>x)(?P=a_b)\Z", "yxx"), (r"\w\b", "é"), (r"a.b", "a\rb"), (r"\d", "٣")]
    for pattern, text in cases:
        assert re.search(pattern, text)
        row = spark.createDataFrame([(text,)], "t string").select(F.rlike("t", F.lit(java_pattern(pattern)))).first()
        assert row[0], pattern


def test_pattern_table_equals_contains(spark):
    rng = random.Random(5)
    text = "\n".join("".join(rng.choices("abcdé ", k=rng.randint(1, 40))) for _ in range(200))
    patterns = {"".join(rng.choices("abcdAé ", k=rng.randint(1, 8))) for _ in range(150)}
    patterns = [p for p in patterns if p]
    lines = kept_lines(prepare(files_of(spark, {"a.rb": text}), O.forensic()))
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = pattern_table_hits(lines, table).collect()
    assert sorted(pattern_table_hits(lines, table, broadcast_bytes=None).collect()) == sorted(found)
    expected = {
        (n, p) for n, line in enumerate(text.split("\n"), 1) if line.strip() for p in patterns if p.lower() in line.lower()
    }
    assert len(found) == len(expected)
    assert {(r.line_no, r.pattern) for r in found} == expected


def test_a_long_line_costs_its_length(spark, monkeypatch):
    """Patterns are compared where their grams stand, over any number of steps; no row holds a gram and the whole line."""
    monkeypatch.setattr(grams, "STEP", 64)
    rng = random.Random(8)
    rows = [(str(i), 1, "".join(rng.choices("abé ", k=n))) for i, n in enumerate((0, 1, 5, 700, 3000))] + [("x", None, None), (None, 2, "xab")]
    rows += rows[3:4]
    table = {"".join(rng.choices("abé ", k=rng.randint(1, 9))) for _ in range(80)} | {"aB", "Ab", rows[3][2][100:400]}
    lines = spark.createDataFrame(rows, "file_id string, line_no int, code string")
    found = pattern_table_hits(lines, spark.createDataFrame([(p,) for p in table] + [(None,), ("",)], "pattern string"), n=4)
    expected = [(f, no, p) for f, no, code in rows for p in table if p.lower() in (code or "")]
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert pattern_table_hits(lines, spark.createDataFrame([], "pattern string")).collect() == []


def test_gram_filter(spark, monkeypatch):
    """All filed grams pass, few others do, and a table too large for the filter goes without."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé", k=5))
    filed, other = {word() for _ in range(5000)}, {word() for _ in range(5000)}
    passes = gram_filter(spark.createDataFrame([(g,) for g in filed], "_g string"))
    rows = spark.createDataFrame([(g,) for g in filed | other], "g string").select("g", F.expr(passes("g")).alias("ok")).collect()
    assert all(r["ok"] for r in rows if r["g"] in filed)
    assert sum(r["ok"] for r in rows if r["g"] not in filed) < 0.03 * len(other)
    monkeypatch.setattr(patterns, "FILTER_BITS", 10)
    assert gram_filter(spark.createDataFrame([(g,) for g in filed], "_g string")) is None
    lines = kept_lines(prepare(files_of(spark, {"a.rb": "one two\nthree"}), O.forensic()))
    table = spark.createDataFrame([(p,) for p in ["e t", "hre", "x", *filed]], "pattern string")
    assert {(r.line_no, r.pattern) for r in pattern_table_hits(lines, table, n=3).collect()} == {(1, "e t"), (2, "hre")}


def test_pattern_list_lines(spark, tmp_path):
    text = '"chown "\n# c\nab # x\n\n  \n""\n"a#b"\n\tlast\t\n"'
    path = tmp_path / "list.txt"
    path.write_text(text)
    expected = ["chown ", "ab", '"a', "last", None]
    assert read_patterns(spark, str(path))[:4] == expected[:4]
    rows = [("p", "plain", i, line) for i, line in enumerate(text.split("\n"))]
    table = parse_pattern_lines(spark.createDataFrame(rows, "pack string, kind string, line_no int, line string"))
    assert [(r.ord, r.pattern) for r in sorted(table.collect(), key=lambda r: r.ord)][:4] == list(enumerate(expected[:4], 1))
    assert read_patterns(spark, str(tmp_path / "missing.txt")) == []


def test_invalid_pattern_is_refused():
    with pytest.raises(ValueError):
        Pack(regex=("(",))


PYTHON_ONLY = [r"((?(1)a|b)c)+d", r"x{0,4294967290}y", r"(?(1)é|foo)(q)?bar", r"\b((?(1)x|spawn)_shell)\b"]


@pytest.mark.parametrize("ignore", [False, True])
def test_patterns_that_only_python_can_say(spark, ignore):
    """In packs, line rules and file rules; first matches keep their order."""
    assert all(needs_python(p) and check_pattern(p) is None for p in PYTHON_ONLY) and check_pattern("(") is not None
    rng = random.Random(3)
    lines = ["".join(rng.choice(["bc", "ac", "d", "xx", "y", "foo", "bar", "é", "spawn_shell", " ", "K"]) for _ in range(6)) for _ in range(80)]
    text = "\n".join(lines)
    packs = Packs(content=Pack(plain=("xxy",), regex=(r"K+", *PYTHON_ONLY)))
    flags = {"flags": ["IGNORECASE"]} if ignore else {}
    rules = [
        rule_from_dict({"id": f"{scope}{i}", "type": "keyword_combination", "scope": scope, "severity": "low",
                        "parameters": {"keywords": [[{"regex": p} | flags]]}}, "t", i)
        for scope in ("line", "file") for i, p in enumerate(PYTHON_ONLY)]
    o = ScanOptions(no_bail_out=True, max_preview_lines_file=1000)
    hits = scan(files_of(spark, {"a.rb": text}), packs, rules, o).collect()

    def first(line):
        tests = [("xxy", "xxy" in line.lower())] + [(p, re.search(p, line, re.I)) for p in packs.content.regex]
        return next((p for p, found in tests if found), None)

    shown = [(n, x) for n, x in enumerate(lines, 1) if x.strip()]
    assert [(r.line_number, r.pattern_or_rule) for r in hits if r.stage == "pattern"] == [(n, first(x)) for n, x in shown if first(x)]
    for i, p in enumerate(PYTHON_ONLY):
        found = [(n, x) for n, x in shown if re.search(p, x, re.I * ignore)]
        got = {r.stage: r for r in hits if r.rule_id in (f"line{i}", f"file{i}")}
        assert bool(found) == ("line_rule" in got) == ("file_rule" in got)
        if found:
            assert got["line_rule"].hits == len(found) and got["line_rule"].line_number == found[0][0]
            assert got["file_rule"].hits == len({x for _, x in found})


def test_python_is_asked_only_where_it_is_needed(spark):
    files = files_of(spark, {"a.rb": "x"})
    plan = lambda regex: scan(files, Packs(content=Pack(regex=regex)))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan((r"\bx\b",)) and "EvalPython" in plan((PYTHON_ONLY[0],))


def test_default_packs(spark):
    packs = default_packs(spark)
    assert packs.names and packs.content.plain and packs.content.regex and packs.shell.plain and packs.shell.regex
    assert patterns_table(spark, packs).count() == sum(
        map(len, (packs.names, packs.content.patterns, packs.shell.patterns))
    )
    hits = hits_of(spark, {"a.sh": "echo x | base64 -d | sh\nunset HISTFILE\n", "b.py": "import pty; pty.spawn('sh')"}, packs)
    assert [(f, n) for f, n, *_ in hits] == [("a.sh", 1), ("a.sh", 2), ("b.py", 1)]


PATTERNS = [
    r"function\(p,a,c\){", r"%{x}", r"[[(]x", r"(?#note)abc", r"a{,3}b", "\\U0001F600", r"(?a:\w)x", r"(x)?(?(1)y|z)", r"[a&&b]x",
    r"x\sy", r"(^|[^a])?foo", r"(^|[^a])*foo", r"(^|[^a])foo", r"(^|[^a])foo\1", r"(?P<n_1>ab)+(?P=n_1)", r"(?i:straße)K",
    r"[^\W\d]x", r"[\D\s]q", r"\Bx\B", r"[]a]", r"[^]a]b", r"a*?b++c", r"(?>a+)b", r"(?s:.)y",
]
ATOMS = [
    "a", "é", r"\w", r"\W", r"\d", r"\s", "[a-c]", r"[^\s\d]", r"[\w-]", ".", r"\b", r"\B", "(a|b)", "(?i:K)", "(?=a)", "(?!b)",
    "(?<=a)", "&&", "{", r"\[", r"(?a:\w)", "^", "$",
]


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_patterns_find_what_python_finds(spark):
    rng = random.Random(1)
    patterns = list(PATTERNS)
    while len(patterns) < 100:
        p = "".join(rng.choice(ATOMS) + rng.choice(["", "", "*", "+", "?", "{1,2}", "*?"]) for _ in range(rng.randint(1, 5)))
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)
    letters = "abxyzfo&[({})%é é\u0301K\u212asſ12²\u0663_-\x1c\u00a0q\U0001F600"
    lines = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(100)]
    lines += ["function(p,a,c){", "%{x}", "(x", "aaab", "xy", "z", "ax", "&x", "x\x1cy", "afoo", "bfoob", "foo", "STRASSEk", "abab"]
    frame = spark.createDataFrame([(x,) for x in lines], "t string")
    for ignore in (False, True):
        for i in range(0, len(patterns), 50):
            part = patterns[i : i + 50]
            tests = [F.rlike("t", F.lit(java_pattern(p, ignore))).alias(f"c{k}") for k, p in enumerate(part)]
            for row in frame.select("t", *tests).collect():
                assert [row[f"c{k}"] for k in range(len(part))] == [bool(re.search(p, row.t, re.I * ignore)) for p in part]
