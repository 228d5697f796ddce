import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import files_of, fold_lines
from tracewell.functions import checks
from tracewell.functions.regex import with_line
from tracewell.operators import rules as ro
from tracewell.options import ScanOptions
from tracewell.plans.corpus import STARTER_PACKS, STARTER_RULES
from tracewell.plans.scan import scan
from tracewell.sources.packs import Packs
from tracewell.sources.rules import (
    RuleError, default_rules, keyword_groups, order_rules, read_rules, rule_from_dict, rules_table,
)

O = ScanOptions()


def value(spark, sql, **columns):
    schema = ", ".join(f"{k} string" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], schema).select(F.expr(sql)).first()[0]


def rule(**fields):
    return rule_from_dict({"id": "r", "type": "keyword_combination", "scope": "line", "severity": "low", **fields})


def hits(spark, contents, rules, o=O):
    rows = scan(files_of(spark, contents), Packs(), rules, o).collect()
    return sorted(((r.file, r.rule_id, r.hits, r.line_number, r.line) for r in rows))


def keywords(spark, line, groups, threshold=None):
    r = rule(parameters={"keywords": groups, **({"threshold": threshold} if threshold else {})})
    return value(spark, with_line("t", lambda x: checks.keyword_combination(x, r.keyword_groups(), r.keyword_threshold())), t=line)


def test_line_checks(spark):
    body = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODk="
    assert value(spark, checks.base64_suspect("t", 40), t=body)
    assert not value(spark, checks.base64_suspect("t", 40), t=" " + body)
    assert not value(spark, checks.base64_suspect("t"), t="")
    assert value(spark, checks.hex_suspect("t", 4), t="dEad") and not value(spark, checks.hex_suspect("t", 5), t="dead")
    assert not value(spark, checks.path_access("t", ["/etc/app"]), t="/ETC/app")
    assert value(spark, checks.string_length("t"), t="")


@pytest.mark.parametrize(
    "line, groups, threshold, expected",
    [
        ("env exec", ["ENV", "exec"], None, True),
        ("env", ["ENV", "exec"], None, False),
        ("a", [["a", "b", "c"]], None, False),
        ("a", [["a", "b", "c"]], [1], True),
        ("a", [["a"]], None, True),
        ("a b", [["a", "b"]], [3], False),
        ("a b", [["a", "b"]], [0], True),
        ("Obf_x", [{"regex": "obf_[a-z]"}], None, False),
        ("Obf_x", [{"regex": "obf_[a-z]", "flags": ["IGNORECASE"]}], None, True),
        ("x", [["a", {"regex": "x"}], "x", 7], None, True),
    ],
)
def test_keywords(spark, line, groups, threshold, expected):
    assert keywords(spark, line, groups, threshold) is expected


def test_keyword_forms_agree_with_the_table(spark):
    forms = [["A", "b"], [["a", "B"], "c"], [{"regex": "x+", "flags": ["IGNORECASE"]}], [[1, "a"], 7], [[5], "z"]]
    rules = [rule(id=f"r{i}", parameters={"keywords": f}) for i, f in enumerate(forms)]
    expected = {
        (r.id, g, i, k.kind, k.value, "IGNORECASE" in ("IGNORECASE" if k.ignore_case else ""))
        for r in rules for g, items in enumerate(r.keyword_groups(), 1) for i, k in enumerate(items, 1)
    }
    rows = ro.rule_keywords(rules_table(spark, rules)).collect()
    assert {(r.rule_id, r.group_no, r.item_no, r.kind, r.value, "IGNORECASE" in r.flags) for r in rows} == expected


def test_bad_keywords():
    for bad in ([], [5], [{"word": "x"}], [{"regex": "("}]):
        with pytest.raises(RuleError):
            keyword_groups(bad)


def entropy(t):
    return -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0


@pytest.mark.parametrize("token", ["", "a", "foo", "abcdefghijklmnop", "éééa", "a𝒳𝒳b"])
def test_entropy(spark, token):
    assert value(spark, checks.entropy("t"), t=token) == pytest.approx(entropy(token), abs=1e-9)


def test_identifiers_as_python_finds_them(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("ab_$é1 .-\n0x", k=4000))
    assert value(spark, checks.identifiers("t"), t=text) == re.findall(r"\b[$_a-zA-Z][$\w]*\b", text)


@pytest.mark.parametrize(
    "text, ext, expected",
    [
        ("total += part", ".rb", 1.5),
        ("a + b + c += d", ".rb", 3.5),
        ("x.concat (y).concat(z)", ".ts", 4.0),
        ("x.concat(y)", ".py", 0.0),
        ("sep.join (y)", ".py", 2.0),
        ("sep.join(y)", ".js", 0.0),
        (r"\x4A\u00e9 \xZZ \u12", ".c", 5.0),
        ("'ab' 'ab' 'ab' 'ab'", ".c", 0.0),
        ("'ab' 'ab' 'ab' 'ab' 'ab'", ".c", 6.25),
        ("'abcde' \"fghij\" 'klmno' 'pqrst' 'uvwxy'", ".c", 2.5),
        ("'abcde' \"fg\" 'klmno' 'pqrst' 'uvwxy'", ".c", 2.5),
        ("$a -BXOR 3; iex $b; `n", ".ps1", 8.5),
        ("$a -BXOR 3; iex $b; `n", ".js", 0.0),
        ("fromBASE64string + Invoke-Expression", ".ps1", 9.0),
    ],
)
def test_string_score(spark, text, ext, expected):
    assert value(spark, checks.obfuscation_score("t", "ext"), t=text, ext=ext) == expected


def test_fallback_gate_and_threshold(spark):
    fallback = rule(only_if_no_match=True, heuristic_threshold=3, parameters={"keywords": [["x"]]})
    text = "x\n" * 10
    assert hits(spark, {"a.rb": text}, [fallback]) == []
    [(_, _, n, first, line)] = hits(spark, {"a.rb": text}, [fallback], ScanOptions(all_matches=True))
    assert (n, first, line.split("\n")[:2]) == (10, 1, ["1: x", "2: x"])


def test_gate_keeps_only_a_first_event(spark):
    a = rule(id="a", parameters={"keywords": [["aa"]]})
    b = rule(id="b", only_if_no_match=True, parameters={"keywords": [["bb"]]})
    found = lambda text: [(r, n, at, line) for _, r, n, at, line in hits(spark, {"f.rb": text}, [b, a])]
    assert found("aa bb") == [("a", 1, 1, "aa bb")]
    assert found("bb\naa\nbb") == [("a", 1, 2, "aa"), ("b", 1, 1, "bb")]


def test_file_keywords(spark):
    words = rule(scope="file", parameters={"keywords": [["key"]]})
    found = lambda text, o=O: [(n, at, line) for _, _, n, at, line in hits(spark, {"f.js": text}, [words], o)]
    assert found("key\n" * 5) == [(1, 0, "key")]
    assert found("key 1\nx\nKEY 2") == [(2, 0, "Matched lines:\nkey 1\nKEY 2")]
    many = found("\n".join(f"key {i}" for i in range(11)))
    assert many[0][0] == 11 and many[0][2].startswith("Preview of matched lines (max. 10):\nkey 0\n") and many[0][2].count("\n") == 10
    assert found("key " + "y" * 5000) == [(1, 0, "[File content omitted – likely contains bundled or minified code]")]
    # evidence sees the original line, comments included, and blanks count for its first cut
    assert found("x = 1 // key") == [(1, 0, "x = 1 // key")]
    assert found("x\nx\n" + " " * 95 + "key" + "z" * 50)[0][2] == "key" + "z" * 2 + " [truncated]"
    limited = found("\n".join(f"key {i}" for i in range(9)), ScanOptions(max_lines_file_scan=4))
    assert limited[0][0] == 4


def test_identifier_rule(spark):
    text = "\n".join(["var _0xab12=_0xcd34[abcdefghijklmnopq];" * 20] * 4)
    strict = {"min_entropy_hits": 5, "require_hex_prefix": True, "require_long_lines": True, "min_long_lines": 3}
    r = lambda **p: rule(type="obfuscation_vars", scope="file", parameters={**strict, **p})
    assert len(hits(spark, {"a.js": text}, [r()])) == 1
    for refused in ({"min_ratio": 0.86}, {"min_tokens": 321}, {"min_entropy_hits": 81}, {"min_long_lines": 5}):
        assert hits(spark, {"a.js": text}, [r(**refused)]) == []
    assert hits(spark, {"a.js": text}, [r(min_ratio=0.85, min_tokens=320, min_entropy_hits=80, min_long_lines=4)])


def test_documented_file_gate(spark):
    rules = [
        rule(id="a", scope="file", parameters={"keywords": [["k"]]}),
        rule(id="b", scope="file", only_if_no_match=True, parameters={"keywords": [["k"]]}),
    ]
    ids = lambda o: [r for _, r, *_ in hits(spark, {"f.rb": "k"}, rules, o)]
    assert ids(O) == ["a", "b"] and ids(ScanOptions(file_gate="documented")) == ["a"]


def fires(r, ext, code, o):
    """One rule on one line, taken alone."""
    exts, p, low = r.extensions(o.extension_groups), r.parameters, code.lower()
    if exts is not None and ext not in exts:
        return False
    if r.type == "string_length":
        return len(code) >= p["min_length"]
    if r.type in ("base64_suspect", "hex_suspect"):
        letters = "[A-Za-z0-9+/=]+" if r.type == "base64_suspect" else "[0-9a-fA-F]+"
        return len(code) >= p["min_length"] and bool(re.fullmatch(letters, code))
    if r.type == "path_access":
        return any(x in code for x in p["paths"])
    found = [
        [bool(k.value in low if k.kind == "plain" else re.search(k.value, code, re.I * k.ignore_case)) for k in group]
        for group in r.keyword_groups()
    ]
    return sum(found[0]) >= r.keyword_threshold() if len(found) == 1 else all(map(any, found))


def brute_force(path, text, rules, o):
    """Line-rule hits of one file: events of each rule over the lines that are looked at, then the gate (a fallback
    event stays only as the file's first), then thresholds."""
    ext = path[path.rindex("."):]
    dialect = {".sh": "shell", ".py": "python", ".js": "block", ".ts": "block", ".java": "block"}.get(ext, "none")
    raws, lines = text.split("\n"), list(fold_lines(text, dialect))
    if not o.no_bail_out:
        before = [sum(len(raws[no - 1]) for no, _ in lines[:i]) for i in range(len(lines))]
        lines = [x for i, x in enumerate(lines) if i < o.max_lines_file_scan and before[i] < o.max_chars_file_scan]
    ordered = [r for r in order_rules(rules, o.level) if r.scope == "line"]
    events = sorted((no, i) for i, r in enumerate(ordered) for no, code in lines if fires(r, ext, code, o))
    if not o.all_matches:
        events = [e for e in events if e == events[0] or not ordered[e[1]].only_if_no_match]
    at = {i: [no for no, j in events if j == i] for i in range(len(ordered))}
    return {(path, r.id, len(at[i]), at[i][0]) for i, r in enumerate(ordered) if at[i] and len(at[i]) >= r.heuristic_threshold}


@pytest.mark.parametrize("o", [ScanOptions(max_lines_file_scan=12), ScanOptions().forensic(), ScanOptions(level="medium", all_matches=True)])
def test_line_rules_against_brute_force(spark, o):
    from tracewell.plans.corpus import PLANTS

    rng = random.Random(9)
    rules = [r for r in STARTER_RULES if r.scope == "line" and r.type != "obfuscation_strings"]  # test_string_score has that
    pieces = [*PLANTS, "x" * 300, "y" * 301, "plain line", "", "   # c", "decode fetch"]
    contents = {
        f"f{i}{rng.choice(['.js', '.py', '.sh', '.java', '.rb', '.conf'])}": "\n".join(rng.choices(pieces, k=rng.randint(1, 30)))
        for i in range(120)
    }
    expected = set().union(*(brute_force(p, t, rules, o) for p, t in contents.items()))
    rows = scan(files_of(spark, contents), STARTER_PACKS, rules, o).filter("stage = 'line_rule'").collect()
    assert {(r.file, r.rule_id, r.hits, r.line_number) for r in rows} == expected
    assert len(rows) == len(expected) > 0


def test_order(spark):
    make = lambda i, **f: rule(id=f"r{i}", parameters={"keywords": ["a"]}, **f)
    rules = [
        make(0, severity="low"), make(1, severity="high", priority=1), make(2, severity="low", priority=200),
        make(3, severity="low", scope="file"), make(4, severity="low", only_if_no_match=True), make(5, severity="medium"),
    ]
    order = ["r1", "r5", "r2", "r0", "r4", "r3"]
    assert [r.id for r in order_rules(rules)] == order
    table = rules_table(spark, [type(r)(**{**vars(r), "idx": i}) for i, r in enumerate(rules)])
    rows = ro.order_rules(table, "low").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.rule_order)] == order
    assert sorted(r.rule_order for r in ro.order_rules(table, "medium").collect()) == [1, 2]


def test_applies_to_groups_suffixes_and_nothing_else():
    groups = O.extension_groups
    assert rule(parameters={"keywords": ["a"]}).extensions(groups) is None
    assert rule(parameters={"keywords": ["a"]}, applies_to={"extensions": ["typescript", ".vue"]}).extensions(groups) == [".ts", ".tsx", ".vue"]
    with pytest.raises(RuleError):
        rule(parameters={"keywords": ["a"]}, applies_to={"extensions": ["cobol"]}).extensions(groups)


def test_applicability_as_a_table(spark):
    lists = [None, [], ["typescript", ".vue"], ["python"], ["python", ".py"], ["cobol"]]
    rules = [
        rule(id=f"r{i}", parameters={"keywords": ["a"]}, applies_to={} if exts is None else {"extensions": exts})
        for i, exts in enumerate(lists)
    ]
    found = {(r.rule_id, r.ext) for r in ro.rule_extensions(rules_table(spark, rules), O).collect()}
    assert found == {("r0", "*"), ("r1", "*"), ("r2", ".ts"), ("r2", ".tsx"), ("r2", ".vue"), ("r3", ".py"), ("r4", ".py")}
    files = files_of(spark, {"a.py": "", "b.py": "", "c.ts": "", "d": ""})
    counts = {r.ext: (r.files, r.rules) for r in ro.applicable(rules_table(spark, rules), files, O).collect()}
    assert counts == {".py": (2, 4), ".ts": (1, 3), "": (1, 2)}


def test_scan_context():
    r = rule(parameters={"keywords": ["a"]}, applies_to={"scan_context": ["web"]})
    assert r.in_context(None) and r.in_context("web") and not r.in_context("batch")


@pytest.mark.parametrize(
    "change", [{"id": ""}, {"type": None}, {"scope": None}, {"severity": "HIGH"}, {"type": "x"}, {"scope": "project"}, {"type": "hex_suspect", "scope": "file"}]
)
def test_broken_rules_are_refused(change):
    with pytest.raises(RuleError):
        rule(parameters={"keywords": ["a"]}, **change)


def test_read_rules(spark, tmp_path):
    good = '{"rules": [{"id": "%s", "type": "hex_suspect", "scope": "line", "severity": "low"}]}'
    (tmp_path / "rules.b.json").write_text(good % "b")
    (tmp_path / "rules.a.json").write_text(good % "a")
    (tmp_path / "other.json").write_text(good % "c")
    assert [r.id for r in read_rules(spark, str(tmp_path))] == ["a", "b"]
    (tmp_path / "rules.c.json").write_text(good % "a")
    with pytest.raises(RuleError, match="duplicate"):
        read_rules(spark, str(tmp_path))
    assert len(default_rules(spark)) == 8


def test_lint(spark):
    rows = [
        ("a", "hex_suspect", "file", "low", "{}", ["cobol"]),
        ("a", "keyword_combination", "line", "High", '{"keywords": [{"regex": "("}], "threshold": 2}', None),
        (None, "entropy", "project", "low", "{}", None),
        ("k", "keyword_combination", "line", "low", '{"keywords": [["a"], ["b"]], "threshold": [2, 1]}', None),
        ("n", "keyword_combination", None, "low", '{"keywords": []}', [".x"]),
    ]
    columns = ["id", "type", "scope", "severity", "parameters", "exts"]
    frame = spark.createDataFrame(rows, "id string, type string, scope string, severity string, parameters string, exts array<string>")
    table = frame.select(
        *columns[:5], F.struct(F.col("exts").alias("extensions")).alias("applies_to"),
        F.lit("f.json").alias("source_file"), F.monotonically_increasing_id().alias("idx"),
    )
    found = {(v.rule_id, v.check) for v in ro.lint_rules(table, O).collect()}
    assert found == {
        ("a", "duplicate_id"), ("a", "scope_not_allowed"), ("a", "unknown_extension"), ("a", "invalid_severity"),
        ("a", "invalid_regex"), ("a", "threshold_not_list"), (None, "missing_id"), (None, "unknown_type"),
        (None, "unknown_scope"), ("k", "threshold_overwritten"), ("n", "missing_field"), ("n", "no_keyword_group"),
    }
    with pytest.raises(RuleError):
        ro.lint_rules(table, O, strict=True)


def test_order_has_no_single_task(spark):
    table = rules_table(spark, [rule(id=f"r{i}", idx=i, priority=i % 7, parameters={"keywords": ["a"]}) for i in range(300)])
    ordered = ro.order_rules(table, "low")
    assert "SinglePartition" not in ordered._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.rule_order for r in ordered.collect()) == list(range(1, 301))


def test_shape_of_rule_files(spark):
    files = spark.createDataFrame([("a", '{"rules": 3}'), ("b", "no json"), ("c", '{"rules": []}')], "source_file string, value string")
    assert {(v.check, v.detail) for v in ro.rule_file_problems(files).collect()} == {
        ("rules_not_list", "a"), ("rules_not_list", "b"), ("no_rules", "")}
    good = spark.createDataFrame([("a", '{"rules": [{"id": "x"}]}')], files.schema)
    assert ro.rule_file_problems(good).collect() == []
