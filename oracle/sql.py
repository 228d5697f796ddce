"""DuckDB SQL for every registered query, written another way than the Spark side.

Comment state is walked line by line with a recursive query, first matches and gates are ranked
joins, and evidence is aggregated from rows; the Spark side folds arrays inside a file's row.
"""

from __future__ import annotations

BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DOUBLE, SINGLE = '"' * 3, "'" * 6  # three quotes, as they stand in an SQL literal
MAX_LINES, MAX_CHARS, MAX_BYTES = 200, 20000, 12000

SHELL = "'.sh', '.bash', '.zsh', '.ksh', '.csh', '.tcsh', '.fish', '.ash'"
JS = "'.js', '.jsx', '.mjs', '.cjs'"
TS = "'.ts', '.tsx'"
BLOCK = f"'.c', '.cpp', {JS}, {TS}, '.java', '.cs', '.csx', '.php'"
CONTENT = f"{JS}, {TS}, '.py', '.php', '.rb', '.go', '.java', '.c', '.cpp', '.rs', '.lua', '.pl', '.swift', '.conf', '.config'"
CONTENT_FILES = (
    "'package.json', 'composer.json', 'requirements.txt', 'pyproject.toml', 'pipfile', 'go.mod', 'cargo.toml', "
    "'pom.xml', 'settings.xml', 'web.xml', 'applicationcontext.xml', 'hibernate.cfg.xml'"
)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def truncate(x: str, n: int = 100) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || ' [truncated]' ELSE {x} END"


def cut_hash(x: str) -> str:
    rx = r"""^((?:[^''"#]|''[^'']*''|"[^"]*")*)#"""
    cut = f"regexp_extract({x}, '{rx}', 1)"
    return f"CASE WHEN regexp_matches({x}, '{rx}') THEN regexp_replace({cut}, '[{BLANKS}]+$', '') ELSE {x} END"


def occurrences(x: str, token: str) -> str:
    quoted = token.replace("'", "''")
    return f"((length({x}) - length(replace({x}, '{quoted}', ''))) // {len(token)})"


def score(t: str, ext: str, short: float) -> str:
    """String-building score with default weights but for short strings."""
    count = lambda rx: f"len(regexp_extract_all({t}, '{rx}'))"
    literals = f"""regexp_extract_all({t}, '''[^'']*''|"[^"]*"')"""
    few = f"len(list_filter({literals}, lambda s: length(s) <= 4))"
    plus_equals = occurrences(t, "+=")
    return f"""round(
        {plus_equals} * 1.5::DOUBLE + ({occurrences(t, '+')} - {plus_equals}) * 1.0::DOUBLE
        + CASE WHEN {ext} IN ({JS}, {TS}) THEN {count(r'[.]concat[[:space:]]*[(]')}
               WHEN {ext} = '.py' THEN {count(r'[.]join[[:space:]]*[(]')} ELSE 0 END * 2.0::DOUBLE
        + ({count(r'[\\]x[0-9a-fA-F]{2}')} + {count(r'[\\]u[0-9a-fA-F]{4}')}) * 2.5::DOUBLE
        + CASE WHEN len({literals}) >= 5 THEN len({literals}) * {short}::DOUBLE ELSE 0 END
        + CASE WHEN {few} >= 5 THEN {few} * ({short}::DOUBLE + 0.25::DOUBLE) ELSE 0 END, 9)"""


# name -> (names it builds on, text)
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (list(needs), text)


def query(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + final


# ---- corpus

cte("plants", r"""
    SELECT * FROM (VALUES
        (0, 'x = run_decode("aGk=")  # decode_payload('),
        (1, 'fetch_tool --get http://host.test/a'),
        (2, '/* note' || chr(10) || 'decode_payload( inside' || chr(10) || '*/ decode_payload( after' || chr(10) || 'ok = 1'),
        (3, 'call("http://host.test"); decode_payload(1)'),
        (4, 'echo ''#keep'' # spawn_shell'),
        (5, 's = ' || repeat('"', 3) || 'open' || chr(10) || 'decode_payload( hidden' || chr(10) || repeat('"', 3) || ' ; decode_payload(3)'),
        (6, 'ENV_READ and exec_now(1)'),
        (7, 'QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODk='),
        (8, 'deadbeefdeadbeefdeadbeefdeadbeefdeadbeef'),
        (9, 'read("/etc/app_secret")'),
        (10, 'out += "ka" + word.concat(part) + list.join("-") + "' || chr(92) || 'x6b' || chr(92) || 'x6c" + "' || chr(92) || 'u00e9" + "mi"; out += "lo"'),
        (11, 'spawn_shell now')
    ) p(i, t)""")
cte("planted", """
    SELECT d.doc_id, string_agg(repeat(p.t || chr(10), (1 + d.doc_id % 4)::BIGINT), '' ORDER BY p.i) AS tail
    FROM documents d JOIN plants p ON (d.doc_id * 7 + p.i * 13) % 17 = 0 GROUP BY d.doc_id""", "plants")
cte("located", """
    SELECT 'd' || d.doc_id AS file_id, 'project' AS scope,
        '/project/' || ['src', 'lib', 'node_modules', 'node_modules/pkg', 'dist', 'test', '.git'][d.doc_id % 7 + 1] || '/' ||
        CASE WHEN d.doc_id % 97 = 0 THEN ['stage_loader.js', 'drop_helper.sh'][d.doc_id % 2 + 1]
             WHEN d.doc_id % 53 = 0 THEN 'package.json'
             ELSE 'd' || d.doc_id || ['.js', '.py', '.sh', '.ts', '.java', '.rb', '.conf', '.txt', '.c', '.php'][d.doc_id % 10 + 1]
        END AS path,
        d.text || chr(10) || coalesce(p.tail, '') || CASE WHEN d.doc_id % 41 = 0 THEN array_to_string(list_transform(range(4),
            lambda i: repeat('let _0x51fe=_0x77aa(qwertzuiopasdfgh);', 40)), chr(10)) ELSE '' END AS text
    FROM documents d LEFT JOIN planted p ON p.doc_id = d.doc_id
    UNION ALL
    SELECT 'p' || page_id, 'local_cache', '/local_cache/cache/p' || page_id || '.js', html FROM pages
    UNION ALL
    SELECT 'c' || conv_id || '_' || turn, 'global_cache', '/global_cache/tmp/c' || conv_id || '_' || turn || '.sh', text
    FROM conversations""", "planted")
cte("files", r"""
    SELECT file_id, scope, path, string_split(path, '/')[-1] AS basename,
        lower(regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1)) AS ext,
        string_split(path, '/')[-2] AS parent, text
    FROM located""", "located")
cte("relevant", f"""
    SELECT *, CASE WHEN ext IN ({CONTENT}) OR lower(basename) IN ({CONTENT_FILES}) THEN 'content'
                   WHEN ext IN ({SHELL}) THEN 'shell' END AS scan_kind
    FROM files WHERE ext IN ({CONTENT}, {SHELL}) OR lower(basename) IN ({CONTENT_FILES})""", "files")


def exploded(source: str, columns: str) -> str:
    return f"""
    SELECT {columns}, unnest(l) AS raw, generate_subscripts(l, 1)::INT AS line_no FROM (
        SELECT {columns}, string_split(CASE WHEN suffix(u, chr(10)) THEN left(u, length(u) - 1) ELSE u END, chr(10)) AS l
        FROM (SELECT {columns}, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS u FROM {source})
        WHERE u <> '')"""


cte("every_line", exploded("files", "file_id"), "files")
cte("raw_lines", exploded("relevant", "file_id, scope, path, basename, ext, scan_kind"), "relevant")
cte("measured", rf"""
    SELECT *, ext IN ({SHELL}) AS sh, ext = '.py' AS py, ext IN ({BLOCK}) AS bl,
        regexp_matches(raw, '^[{BLANKS}]*#') AS hash_first,
        regexp_replace(raw, '/\*.*?\*/', '', 'g') AS residual,
        regexp_replace(raw, '{DOUBLE}.*?{DOUBLE}|{SINGLE}.*?{SINGLE}', '', 'g') AS outside,
        {occurrences('raw', '"' * 3)} % 2 AS nd, {occurrences('raw', "'" * 3)} % 2 AS ns
    FROM raw_lines""", "raw_lines")
cte("walked", """
    SELECT file_id, line_no, contains(residual, '/*') AS hidden, contains(residual, '/*') AS inside, nd AS d, ns AS s
    FROM measured WHERE line_no = 1
    UNION ALL
    SELECT m.file_id, m.line_no, w.inside OR contains(m.residual, '/*'),
        CASE WHEN w.inside THEN NOT contains(m.raw, '*/') ELSE contains(m.residual, '/*') END,
        (w.d + m.nd) % 2, (w.s + m.ns) % 2
    FROM walked w JOIN measured m ON m.file_id = w.file_id AND m.line_no = w.line_no + 1""", "measured")
cte("coded", f"""
    SELECT m.file_id, scope, path, basename, ext, scan_kind, m.line_no, raw,
        CASE WHEN sh THEN CASE WHEN hash_first THEN '' ELSE {cut_hash('raw')} END
             WHEN py THEN CASE WHEN d = 1 OR s = 1 OR hash_first THEN '' ELSE {cut_hash('outside')} END
             WHEN bl THEN CASE WHEN hidden THEN '' ELSE split_part(residual, '//', 1) END
             ELSE raw END AS code
    FROM measured m JOIN walked w ON w.file_id = m.file_id AND w.line_no = m.line_no""", "measured", "walked")
cte("kept", f"SELECT * FROM coded WHERE regexp_matches(code, '[^{BLANKS}]')", "coded")
cte("bailed", f"""
    SELECT * EXCLUDE (n, before) FROM (
        SELECT *, row_number() OVER w AS n,
            coalesce(sum(length(raw)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM kept WINDOW w AS (PARTITION BY file_id ORDER BY line_no))
    WHERE n <= {MAX_LINES} AND before < {MAX_CHARS}""", "kept")

# ---- patterns

cte("patterns", r"""
    SELECT * FROM (VALUES
        ('content', 1, 'normal', 'decode_payload(', 0),
        ('content', 2, 'normal', 'Fetch_Tool ', 0),
        ('content', 3, 'normal', 'ENV_READ', 0),
        ('content', 4, 'regex', '\b(spawn_shell|exec_now)\b', 1),
        ('content', 5, 'regex', '\boi[eé]?n?\b', 2),
        ('shell', 1, 'normal', 'Fetch_Tool ', 0),
        ('shell', 2, 'normal', 'decode_payload(', 0),
        ('shell', 3, 'regex', '\boi[eé]?n?\b', 2),
        ('shell', 4, 'regex', '\b(spawn_shell|exec_now)\b', 1)
    ) p(pack, ord, kind, pattern, rx)""")
# RE2 knows ASCII word boundaries only, so the boundary is spelled out.
MATCH = r"""p.pack = k.scan_kind AND CASE p.rx WHEN 0 THEN contains(lower(k.code), lower(p.pattern))
        WHEN 1 THEN regexp_matches(k.code, '(^|[^\p{L}\p{N}_])(spawn_shell|exec_now)($|[^\p{L}\p{N}_])', 'i')
        ELSE regexp_matches(k.code, '(^|[^\p{L}\p{N}_])oi[eé]?n?($|[^\p{L}\p{N}_])', 'i') END"""


def pattern_rows(lines: str, first: bool) -> str:
    rank = "QUALIFY row_number() OVER (PARTITION BY k.file_id, k.line_no ORDER BY p.ord) = 1" if first else ""
    return f"""
    SELECT k.path AS file, 1::INT AS hits, p.pattern AS pattern_or_rule, p.kind AS type_or_severity,
        '' AS rule_id, '' AS rule_type, k.line_no AS line_number, {truncate(strip('k.raw'))} AS line,
        k.scope, 'pattern' AS stage, 0 AS seq, {strip('k.raw')} AS whole
    FROM {lines} k JOIN patterns p ON {MATCH} {rank}"""


cte("pattern_first", pattern_rows("bailed", True), "bailed", "patterns")
cte("pattern_first_kept", pattern_rows("kept", True), "kept", "patterns")
cte("pattern_all", pattern_rows("kept", False), "kept", "patterns")
cte("names", """
    SELECT path AS file, 1::INT AS hits, '[filename-only]' AS pattern_or_rule, 'filename' AS type_or_severity,
        '' AS rule_id, '' AS rule_type, 0::INT AS line_number, '' AS line, scope, 'filename' AS stage, 0 AS seq, '' AS whole
    FROM files WHERE scope = 'project' AND basename IN ('stage_loader.js', 'drop_helper.sh')""", "files")

# ---- line rules

LINE_RULES = f"""
    SELECT * FROM (VALUES
        (1, 'base64_body', 'Base64 body', 'base64_suspect', 'high', false, 2),
        (2, 'hex_body', 'Hex body', 'hex_suspect', 'high', false, 1),
        (3, 'secret_path', 'Secret path', 'path_access', 'medium', false, 1),
        (4, 'decode_words', 'Decode vocabulary', 'keyword_combination', 'medium', false, 2),
        (5, 'read_then_now', 'Reading and doing', 'keyword_combination', 'low', false, 1),
        (6, 'string_parts', 'String building on a line', 'obfuscation_strings', 'low', false, 1),
        (7, 'long_text', 'Long line', 'string_length', 'low', true, 2),
        (8, 'spawn_call', 'Spawn call', 'keyword_combination', 'low', true, 1)
    ) r(pos, rule_id, name, rule_type, severity, fallback, threshold)"""
cte("line_rules", LINE_RULES)
BASE64 = lambda n: f"length(code) >= {n} AND regexp_full_match(code, '[A-Za-z0-9+/=]+')"
HEX = lambda n: f"length(code) >= {n} AND regexp_full_match(code, '[0-9a-fA-F]+')"
DECODE = """((strpos(lower(code), 'decode') > 0)::INT + (strpos(lower(code), 'payload') > 0)::INT
    + (strpos(lower(code), 'fetch') > 0)::INT) >= 2"""
ENV = "contains(lower(code), '_read') AND contains(lower(code), '_now')"
PATHS = "regexp_matches(code, '/etc/app_secret|/root/[.]app')"


def events(lines: str) -> str:
    return f"""
    SELECT k.file_id, k.path, k.scope, k.line_no, k.raw, r.* FROM {lines} k JOIN line_rules r ON CASE r.pos
        WHEN 1 THEN {BASE64(40)}
        WHEN 2 THEN {HEX(32)}
        WHEN 3 THEN {PATHS}
        WHEN 4 THEN ext IN ({JS}, '.py', {SHELL}, '.conf') AND {DECODE}
        WHEN 5 THEN {ENV}
        WHEN 6 THEN ext IN ({JS}, {TS}, '.py', '.java') AND {score('code', 'ext', 0.5)} >= 12
        WHEN 7 THEN length(code) >= 240
        WHEN 8 THEN ext IN ({SHELL}, '.conf', '.config', '.rb') AND regexp_matches(code, 'spawn_[a-z]+', 'i')
        END"""


GATE = """SELECT * FROM {source} QUALIFY NOT fallback OR row_number() OVER (PARTITION BY file_id ORDER BY line_no, pos) = 1"""
cte("events", events("bailed"), "bailed", "line_rules")
cte("events_kept", events("kept"), "kept", "line_rules")
cte("gated", GATE.format(source="events"), "events")
cte("gated_kept", GATE.format(source="events_kept"), "events_kept")


def rule_rows(source: str) -> str:
    text = truncate(strip("raw"))
    return f"""
    SELECT path AS file, count(*)::INT AS hits, '[heuristic threshold reached]: ' || any_value(name) AS pattern_or_rule,
        any_value(severity) AS type_or_severity, rule_id, any_value(rule_type) AS rule_type, min(line_no)::INT AS line_number,
        CASE WHEN count(*) > 1 THEN string_agg(line_no || ': ' || ({text}), chr(10) ORDER BY line_no) ELSE any_value({text}) END AS line,
        any_value(scope) AS scope, 'line_rule' AS stage, any_value(pos) - 1 AS seq, '' AS whole
    FROM {source} GROUP BY file_id, path, rule_id HAVING count(*) >= any_value(threshold)"""


cte("events_unsigned", """
    SELECT e.* FROM events_kept e
    WHERE NOT EXISTS (SELECT 1 FROM pattern_first_kept p WHERE p.file = e.path AND p.line_number = e.line_no)""",
    "events_kept", "pattern_first_kept")
cte("gated_unsigned", GATE.format(source="events_unsigned"), "events_unsigned")
cte("line_hits", rule_rows("gated"), "gated")
cte("line_hits_unsigned", rule_rows("gated_unsigned"), "gated_unsigned")
cte("line_hits_gated", rule_rows("gated_kept"), "gated_kept")
cte("line_hits_kept", rule_rows("events_kept"), "events_kept")

# ---- file rules


def texts(lines: str, limit: int | None) -> str:
    text = "string_agg(raw, chr(10) ORDER BY line_no)"
    cut = f"left({text}, {limit})" if limit else text
    return f"SELECT file_id, path, scope, ext, {cut} AS file_text FROM {lines} GROUP BY ALL"


def shapes(lines: str) -> str:
    return f"""
    SELECT file_id, ext IN ({JS}, {TS}) AND count(*) <= 2 AND avg(length(raw)) > 200 AS minified
    FROM {lines} GROUP BY file_id, ext"""


cte("texts", texts("bailed", MAX_CHARS), "bailed")
cte("texts_kept", texts("kept", None), "kept")
cte("shapes", shapes("bailed"), "bailed")
cte("shapes_kept", shapes("kept"), "kept")
KEYWORD_FILE = f"""
    SELECT k.file_id, k.path, k.scope, r.*, {truncate('k.raw')} AS cut, min(k.line_no) AS first_line
    FROM {{lines}} k JOIN (VALUES
        (1, 'decode_file', 'Decode call in file', 'medium'), (2, 'stop_words', 'Stop words', 'low')
    ) r(pos, rule_id, name, severity) ON CASE r.pos
        WHEN 1 THEN (contains(lower(raw), 'decode_payload') OR regexp_matches(raw, 'run_[a-z]+')) AND contains(raw, '(')
        ELSE ext IN ({JS}, '.rb', '.conf', '.config')
            AND (contains(lower(raw), 'the') OR contains(lower(raw), '<script') OR contains(lower(raw), 'que') OR contains(lower(raw), 'der '))
        END
    GROUP BY ALL"""
cte("keyword_lines", f"""
    SELECT * EXCLUDE (before) FROM (
        SELECT *, row_number() OVER w AS n,
            coalesce(sum(length(cut)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM ({KEYWORD_FILE.format(lines='bailed')}) WINDOW w AS (PARTITION BY file_id, pos ORDER BY first_line))
    WHERE n <= {MAX_LINES} AND before < {MAX_CHARS}""", "bailed")
cte("keyword_lines_kept", f"""
    SELECT *, row_number() OVER (PARTITION BY file_id, pos ORDER BY first_line) AS n
    FROM ({KEYWORD_FILE.format(lines='kept')})""", "kept")


def keyword_rows(lines: str, shape: str) -> str:
    preview = f"string_agg({truncate(strip('cut'))}, chr(10) ORDER BY n) FILTER (n <= 10)"
    return f"""
    SELECT path AS file, count(*)::INT AS hits, '[heuristic file match]: ' || any_value(name) AS pattern_or_rule,
        any_value(severity) AS type_or_severity, rule_id, 'keyword_combination' AS rule_type, 0::INT AS line_number,
        CASE WHEN any_value(minified) THEN '[File content omitted – likely contains bundled or minified code]'
             WHEN count(*) > 10 THEN 'Preview of matched lines (max. 10):' || chr(10) || {preview}
             WHEN count(*) > 1 THEN 'Matched lines:' || chr(10) || {preview}
             ELSE {preview} END AS line,
        any_value(scope) AS scope, 'file_rule' AS stage, any_value(pos) - 1 AS seq, '' AS whole
    FROM {lines} JOIN {shape} USING (file_id) GROUP BY file_id, path, rule_id"""


cte("keyword_hits", keyword_rows("keyword_lines", "shapes"), "keyword_lines", "shapes")
cte("keyword_hits_kept", keyword_rows("keyword_lines_kept", "shapes_kept"), "keyword_lines_kept", "shapes_kept")

WORD = r"\p{L}\p{N}_"
TOKENS = rf"""
    SELECT file_id, token FROM (
        SELECT file_id, CASE WHEN regexp_matches(run, '^[_a-zA-Z]') THEN rtrim(run, '$')
            WHEN contains(run, '$') THEN rtrim(substr(run, strpos(run, '$')), '$') ELSE '' END AS token
        FROM (SELECT file_id, ltrim(unnest(regexp_extract_all(file_text, '[${WORD}]+')), '$') AS run FROM {{texts}}))
    WHERE token <> ''"""
WEIGHED = """
    SELECT token, round(0 - sum(n / total * log2(n / total)), 9) AS entropy FROM (
        SELECT token, ch, count(*)::DOUBLE AS n, any_value(length(token))::DOUBLE AS total
        FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT token FROM {tokens})) GROUP BY token, ch)
    GROUP BY token"""
STATS = """
    SELECT x.file_id, count(t.token) AS tokens,
        round(coalesce(sum(CASE WHEN length(t.token) <= 2 THEN 0.8::DOUBLE WHEN prefix(t.token, '_0x') THEN 1.2::DOUBLE
            WHEN prefix(t.token, '__') THEN 0.5::DOUBLE WHEN prefix(t.token, '_') THEN 0.3::DOUBLE
            WHEN length(t.token) >= 5 AND e.entropy >= 3.8 THEN 1.0::DOUBLE ELSE 0::DOUBLE END), 0), 9) AS weight,
        count(*) FILTER (length(t.token) > 2 AND prefix(t.token, '_0x')) AS hex_hits,
        count(*) FILTER (length(t.token) >= 5 AND NOT prefix(t.token, '_') AND e.entropy >= 3.8) AS entropy_hits,
        any_value(len(list_filter(string_split(x.file_text, chr(10)), lambda l: length(l) > 500))) AS long_lines
    FROM {texts} x LEFT JOIN {tokens} t USING (file_id) LEFT JOIN {weighed} e USING (token) GROUP BY x.file_id"""
for s in ("", "_kept"):
    cte(f"tokens{s}", TOKENS.replace("{texts}", f"texts{s}"), f"texts{s}")
    cte(f"weighed{s}", WEIGHED.format(tokens=f"tokens{s}"), f"tokens{s}")
    cte(f"stats{s}", STATS.format(texts=f"texts{s}", tokens=f"tokens{s}", weighed=f"weighed{s}"), f"weighed{s}")
    for name, rule, title, kind, line, seq, test in (
        ("heap_hits", "string_heap", "String building in file", "obfuscation_strings", "[Check file – content omitted]", 2,
         f"ext IN ({JS}, '.java') AND {score('file_text', 'ext', 0.3)} >= 18"),
        ("vars_hits", "renamed_identifiers", "Renamed identifiers", "obfuscation_vars", "[File content omitted]", 3,
         "tokens >= 50 AND round(weight / tokens, 9) >= 0.75 AND hex_hits > 0 AND long_lines >= 2 AND entropy_hits >= 7"),
    ):
        joined = f"texts{s}" if name == "heap_hits" else f"texts{s} JOIN stats{s} USING (file_id)"
        cte(f"{name}{s}", f"""
            SELECT path AS file, 1::INT AS hits, '[heuristic file match]: {title}' AS pattern_or_rule, 'low' AS type_or_severity,
                '{rule}' AS rule_id, '{kind}' AS rule_type, 0::INT AS line_number, '{line}' AS line,
                scope, 'file_rule' AS stage, {seq} AS seq, '' AS whole
            FROM {joined} WHERE {test}""", f"texts{s}" if name == "heap_hits" else f"stats{s}")

cte("by_default", """
    SELECT * FROM names UNION ALL SELECT * FROM pattern_first UNION ALL SELECT * FROM line_hits
    UNION ALL SELECT * FROM keyword_hits UNION ALL SELECT * FROM heap_hits UNION ALL SELECT * FROM vars_hits""",
    "names", "pattern_first", "line_hits", "keyword_hits", "heap_hits", "vars_hits")
cte("everything", """
    SELECT * FROM names UNION ALL SELECT * FROM pattern_first_kept UNION ALL SELECT * FROM line_hits_gated
    UNION ALL SELECT * FROM keyword_hits_kept UNION ALL SELECT * FROM heap_hits_kept UNION ALL SELECT * FROM vars_hits_kept""",
    "names", "pattern_first_kept", "line_hits_gated", "keyword_hits_kept", "heap_hits_kept", "vars_hits_kept")
cte("unsigned", """
    SELECT * FROM names UNION ALL SELECT * FROM pattern_first_kept UNION ALL SELECT * FROM line_hits_unsigned UNION ALL
    SELECT * FROM (SELECT * FROM keyword_hits_kept UNION ALL SELECT * FROM heap_hits_kept UNION ALL SELECT * FROM vars_hits_kept)
    WHERE file NOT IN (SELECT file FROM pattern_first_kept)""",
    "names", "pattern_first_kept", "line_hits_unsigned", "keyword_hits_kept", "heap_hits_kept", "vars_hits_kept")
cte("forensic", """
    SELECT * FROM names UNION ALL SELECT * FROM pattern_first_kept UNION ALL SELECT * FROM line_hits_kept
    UNION ALL SELECT * FROM keyword_hits_kept UNION ALL SELECT * FROM heap_hits_kept UNION ALL SELECT * FROM vars_hits_kept""",
    "names", "pattern_first_kept", "line_hits_kept", "keyword_hits_kept", "heap_hits_kept", "vars_hits_kept")

HIT = "file, hits, pattern_or_rule, type_or_severity, rule_id, rule_type, line_number, line"


def report(source: str, *needs: str) -> str:
    return query(f"SELECT {HIT} FROM {source}", *(needs or (source,)))


# ---- rule catalog

cte("catalog", """
    SELECT CASE WHEN p_partkey % 131 <> 7 THEN 'rule_' || CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 1 ELSE p_partkey END END AS id,
        CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS given_name,
        CASE WHEN p_partkey % 101 = 3 THEN NULL WHEN p_size = 49 THEN 'entropy_map' WHEN p_size = 50 THEN 'obfuscation_vars'
            ELSE CASE p_type WHEN 'ECONOMY' THEN 'string_length' WHEN 'SMALL' THEN 'base64_suspect' WHEN 'MEDIUM' THEN 'hex_suspect'
                WHEN 'PROMO' THEN 'path_access' WHEN 'STANDARD' THEN 'keyword_combination' WHEN 'LARGE' THEN 'obfuscation_strings' END
        END AS type,
        CASE WHEN p_partkey % 103 = 5 THEN NULL WHEN p_partkey % 107 = 6 THEN 'project' WHEN p_partkey % 5 = 0 THEN 'file' ELSE 'line' END AS scope,
        CASE WHEN p_partkey % 109 = 8 THEN 'HIGH' ELSE ['low', 'medium', 'high'][p_partkey % 3 + 1] END AS severity,
        p_partkey % 4 = 0 AS only_if_no_match,
        CASE WHEN p_partkey % 3 = 1 THEN p_size % 5 + 1 ELSE 1 END::INT AS heuristic_threshold,
        CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE 100 END::INT AS priority,
        CASE WHEN p_partkey % 6 < 4 THEN [['javascript'], ['python', '.vue'], ['unix_shell', 'ruby', '.py'], ['c_cpp', 'cobol']][p_partkey % 4 + 1] END AS extensions,
        CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'MEDIUM') THEN p_size * 10 END AS min_length,
        split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two, p_type = 'STANDARD' AS has_keywords,
        'rules.' || lower(replace(p_brand, '#', '_')) || '.json' AS source_file, p_partkey::INT AS idx
    FROM part""")
# kind of keyword list by key: 0 two bare words, 1 one group, 2 pattern and group, 3 broken pattern, 4 two groups,
# 5 nothing valid, 6 one word with a threshold that is no list
cte("keywords", """
    SELECT id, idx, g, i, kind, value, flags FROM (
        SELECT id, idx, idx % 7 AS form, unnest([
            {f: 0, g: 1, i: 1, kind: 'plain', value: lower(one), flags: ''}, {f: 0, g: 2, i: 1, kind: 'plain', value: two, flags: ''},
            {f: 1, g: 1, i: 1, kind: 'plain', value: one, flags: ''}, {f: 1, g: 1, i: 2, kind: 'plain', value: two, flags: ''},
            {f: 1, g: 1, i: 3, kind: 'plain', value: 'x', flags: ''},
            {f: 2, g: 1, i: 1, kind: 'regex', value: one || '_[a-z]+', flags: 'IGNORECASE'}, {f: 2, g: 2, i: 1, kind: 'plain', value: two, flags: ''},
            {f: 3, g: 1, i: 1, kind: 'plain', value: one, flags: ''}, {f: 3, g: 1, i: 2, kind: 'regex', value: '(' || two, flags: ''},
            {f: 4, g: 1, i: 1, kind: 'plain', value: one, flags: ''}, {f: 4, g: 2, i: 1, kind: 'plain', value: two, flags: ''},
            {f: 6, g: 1, i: 1, kind: 'plain', value: one, flags: ''}], recursive := true)
        FROM catalog WHERE type = 'keyword_combination')
    WHERE f = form""", "catalog")
cte("known_groups", f"""
    SELECT * FROM (VALUES ('javascript', [{JS}]), ('python', ['.py']), ('unix_shell', [{SHELL}]), ('ruby', ['.rb']), ('c_cpp', ['.c', '.cpp'])) g(name, exts)""")
SEVERITIES = "('low', 'medium', 'high')"

LINT = """
    SELECT id AS rule_id, 'missing_id' AS "check", source_file || '#' || idx AS detail FROM catalog WHERE id IS NULL
    UNION ALL SELECT id, 'duplicate_id', count(*)::VARCHAR FROM catalog WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id, 'missing_field', 'type' FROM catalog WHERE type IS NULL
    UNION ALL SELECT id, 'missing_field', 'scope' FROM catalog WHERE scope IS NULL
    UNION ALL SELECT id, 'invalid_severity', severity FROM catalog WHERE severity NOT IN ('low', 'medium', 'high')
    UNION ALL SELECT id, 'unknown_extension', 'cobol' FROM catalog WHERE list_contains(extensions, 'cobol')
    UNION ALL SELECT id, 'unknown_type', type FROM catalog WHERE type = 'entropy_map'
    UNION ALL SELECT id, 'unknown_scope', scope FROM catalog WHERE scope NOT IN ('line', 'file')
    UNION ALL SELECT id, 'scope_not_allowed', type || '/' || scope FROM catalog
        WHERE (scope = 'file' AND type IN ('string_length', 'base64_suspect', 'hex_suspect', 'path_access'))
           OR (scope = 'line' AND type = 'obfuscation_vars')
    UNION ALL SELECT id, 'no_keyword_group', '' FROM catalog c WHERE type = 'keyword_combination'
        AND NOT EXISTS (SELECT 1 FROM keywords k WHERE k.idx = c.idx)
    UNION ALL SELECT id, 'threshold_not_list', '3' FROM catalog WHERE type = 'keyword_combination' AND idx % 7 = 6
    UNION ALL SELECT id, 'threshold_overwritten', '1,2' FROM catalog WHERE type = 'keyword_combination' AND idx % 7 = 4
    UNION ALL SELECT id, 'invalid_regex', value FROM keywords WHERE kind = 'regex' AND length(replace(value, '(', '')) < length(value)"""


def lines_where(test: str) -> str:
    return query(f"SELECT file_id, line_no FROM kept WHERE {test}", "kept")


def csv(x: str, limit: int | None = None, feeds: bool = True) -> str:
    text = f"""replace({x}, '"', '""')"""
    if feeds:
        text = f"translate({text}, chr(10) || chr(13), '  ')"
    text = strip(text)
    cut = f"({truncate(text, limit)})" if limit else text
    return f"""CASE WHEN {text} = '' THEN '' ELSE '"' || {cut} || '"' END"""


RANKS = "list_position(['project', 'local_cache', 'global_cache'], scope), file, list_position(['filename', 'pattern', 'line_rule', 'file_rule'], stage), line_number, seq"

PIVOT = f"""
        SELECT pattern_or_rule, arg_min(type_or_severity, pos) AS type_or_severity, count(*) AS hits FROM (
            SELECT pattern_or_rule, type_or_severity, row_number() OVER (ORDER BY {RANKS}) AS pos FROM everything)
        GROUP BY pattern_or_rule"""
SCOPES = """
        SELECT scope, coalesce(filename_hits, 0) AS filename_hits, coalesce(pattern_hits, 0) AS pattern_hits,
            coalesce(line_rule_hits, 0) AS line_rule_hits, coalesce(file_rule_hits, 0) AS file_rule_hits,
            coalesce(total_hits, 0) AS total_hits, files_scanned
        FROM (SELECT scope, count(*) AS files_scanned FROM relevant GROUP BY scope)
        LEFT JOIN (
            SELECT scope, count(*) FILTER (stage = 'filename') AS filename_hits, count(*) FILTER (stage = 'pattern') AS pattern_hits,
                count(*) FILTER (stage = 'line_rule') AS line_rule_hits, count(*) FILTER (stage = 'file_rule') AS file_rule_hits,
                count(*) AS total_hits
            FROM everything GROUP BY scope) USING (scope)"""

ORACLES: dict[str, str] = {
    "decode_text": r"""
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{0}-\x{ff}]', '?', 'g') END AS text FROM documents""",
    "lines": query("SELECT file_id, line_no, raw FROM every_line", "every_line"),
    "file_inventory": query("SELECT file_id, scope, path, basename, ext, parent FROM files", "files"),
    "relevant_files": query("SELECT file_id, path, ext, scan_kind FROM relevant", "relevant"),
    "exclude_dirs": query("""
        SELECT file_id, path, 'parent' AS mode FROM files WHERE parent NOT IN ('node_modules', '.git', 'dist')
        UNION ALL
        SELECT file_id, path, 'subtree' FROM files WHERE NOT regexp_matches(path, '/(node_modules|[.]git|dist)/')""", "files"),
    "scan_errors": query(f"""
        SELECT file_id, reason FROM (
            SELECT file_id, CASE
                WHEN scope = 'global_cache' AND split_part(substr(file_id, 2), '_', 1)::BIGINT % 2 = 0
                    AND split_part(file_id, '_', 2)::BIGINT % 2 = 1 THEN 'unreadable'
                WHEN strlen(text) > {MAX_BYTES} THEN 'oversized' END AS reason FROM files)
        WHERE reason IS NOT NULL""", "files"),
    "strip_shell": query(f"SELECT file_id, line_no, code FROM kept WHERE ext IN ({SHELL})", "kept"),
    "strip_python": query("SELECT file_id, line_no, code FROM kept WHERE ext = '.py'", "kept"),
    "strip_block": query(f"SELECT file_id, line_no, code FROM kept WHERE ext IN ({BLOCK})", "kept"),
    "bail_out": query("SELECT file_id, line_no, length(raw)::BIGINT AS chars FROM bailed", "bailed"),
    "filename_hits": report("names"),
    "plain_hits": query("SELECT file, line_number, pattern_or_rule FROM pattern_all WHERE type_or_severity = 'normal'", "pattern_all"),
    "regex_hits": query("SELECT file, line_number, pattern_or_rule FROM pattern_all WHERE type_or_severity = 'regex'", "pattern_all"),
    "pattern_hits": report("pattern_first_kept"),
    "pattern_hits_all": report("pattern_all"),
    "python_regex_hits": query(r"""
        SELECT path AS file, line_no::INT AS line_number, 'spawn or exec' AS pattern FROM kept
        WHERE regexp_matches(code, '(^|[^\p{L}\p{N}_])(spawn_shell|exec_now)($|[^\p{L}\p{N}_])', 'i')""", "kept"),
    "ngram_pattern_hits": query("""
        SELECT file_id, line_no, count(*) AS patterns, min(pattern) AS first_pattern, max(pattern) AS last_pattern
        FROM kept JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS pattern FROM benchmark)
            ON contains(lower(code), lower(pattern))
        GROUP BY file_id, line_no""", "kept"),
    "pattern_packs": """
        SELECT pack, kind, row_number() OVER (PARTITION BY pack, kind ORDER BY line_no)::INT AS ord, pattern FROM (
            SELECT p_brand AS pack, CASE WHEN p_partkey % 2 = 0 THEN 'plain' ELSE 'regex' END AS kind, p_partkey AS line_no,
                CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' WHEN 2 THEN p_name WHEN 3 THEN '"' || p_name END AS pattern
            FROM part)
        WHERE pattern IS NOT NULL""",
    "rules_catalog": query(f"""
        SELECT id, coalesce(given_name, id) AS name, type, scope, severity, only_if_no_match, heuristic_threshold, priority,
            coalesce(array_to_string(extensions, ','), '') AS extensions, min_length::BIGINT AS min_length, source_file, idx
        FROM catalog WHERE severity IN ('medium', 'high')""", "catalog"),
    "rule_counts": query(f"SELECT severity, count(*) AS rules FROM catalog WHERE severity IN {SEVERITIES} GROUP BY severity", "catalog"),
    "rule_order": query(f"""
        SELECT idx, id, severity, row_number() OVER (ORDER BY list_position(['high', 'medium', 'low'], severity), -priority,
            coalesce(list_position(['line', 'file'], scope), 99), only_if_no_match, source_file, idx) AS rule_order
        FROM catalog WHERE severity IN {SEVERITIES}""", "catalog"),
    "rule_keywords": query("""
        SELECT id AS rule_id, g::INT AS group_no, i::INT AS item_no, kind, value, flags FROM keywords""", "keywords"),
    "rule_applicability": query("""
        SELECT ext, (SELECT count(DISTINCT coalesce(id, '')) FROM catalog WHERE extensions IS NULL) + coalesce(n, 0) AS rules, files
        FROM (SELECT ext, count(*) AS files FROM files GROUP BY ext)
        LEFT JOIN (
            SELECT ext, count(DISTINCT coalesce(id, '')) AS n
            FROM (
                SELECT c.id, unnest(CASE WHEN prefix(e, '.') THEN [e] ELSE g.exts END) AS ext
                FROM (SELECT id, unnest(extensions) AS e FROM catalog) c LEFT JOIN known_groups g ON g.name = c.e)
            GROUP BY ext) USING (ext)""", "catalog", "known_groups", "files"),
    "rule_lint": query(LINT, "catalog", "keywords"),
    "rule_string_length": lines_where("length(code) >= 240"),
    "rule_base64": lines_where(BASE64(20)),
    "rule_hex": lines_where(HEX(20)),
    "rule_path_access": lines_where(PATHS),
    "rule_keyword_single": lines_where(DECODE),
    "rule_keyword_multi": lines_where(ENV),
    "obf_strings_line": query(f"""
        SELECT file_id, line_no, score FROM (SELECT file_id, line_no, {score('code', 'ext', 0.5)} AS score FROM kept) WHERE score > 0""", "kept"),
    "line_rule_events": query("SELECT file_id, rule_id, pos::INT AS rule_order, line_no, severity FROM events_kept", "events_kept"),
    "fallback_gate": query("SELECT file_id, rule_id, pos::INT AS rule_order, line_no, severity FROM gated_kept", "gated_kept"),
    "line_rule_hits": report("line_hits_gated"),
    "line_rule_hits_all": report("line_hits_kept"),
    "file_text": query("SELECT file_id, length(file_text)::BIGINT AS chars, md5(file_text) AS digest FROM texts_kept UNION ALL SELECT file_id, 0, md5('') FROM relevant WHERE file_id NOT IN (SELECT file_id FROM texts_kept)", "texts_kept"),
    "file_keyword": report("keyword_hits_kept"),
    "minified_files": query("SELECT file_id, ext FROM shapes_kept JOIN relevant USING (file_id) WHERE minified", "shapes_kept"),
    "obf_strings_file": query(f"SELECT file_id, {score('file_text', 'ext', 0.3)} AS score FROM texts_kept UNION ALL SELECT file_id, 0 FROM relevant WHERE file_id NOT IN (SELECT file_id FROM texts_kept)", "texts_kept"),
    "identifier_stats": query("""
        SELECT file_id, tokens, hex_hits, entropy_hits, long_lines, weight FROM stats_kept
        UNION ALL SELECT file_id, 0, 0, 0, 0, 0 FROM relevant WHERE file_id NOT IN (SELECT file_id FROM texts_kept)""", "stats_kept", "texts_kept"),
    "token_entropy": query("SELECT token, uses, entropy FROM (SELECT token, count(*) AS uses FROM tokens_kept GROUP BY token) JOIN weighed_kept USING (token)", "weighed_kept"),
    "obf_vars": report("vars_hits_kept"),
    "all_hits": report("everything"),
    "piece_hits": report("everything"),
    "context_hits": query(f"""
        SELECT {HIT} FROM keyword_hits_kept JOIN (SELECT DISTINCT path AS file, parent FROM files) USING (file)
        WHERE parent NOT IN ('src', 'lib') OR CASE rule_id WHEN 'decode_file' THEN parent = 'lib' ELSE parent = 'src' END""",
        "keyword_hits_kept", "files"),
    "default_hits": report("by_default"),
    "signature_gate": report("unsigned"),
    "forensic_hits": report("forensic"),
    "csv_hits": query(f"""
        SELECT {csv('file')} AS file, hits, {csv('pattern_or_rule')} AS pattern_or_rule, {csv('type_or_severity')} AS type_or_severity,
            {csv('rule_id')} AS rule_id, {csv('rule_type')} AS rule_type, line_number,
            CASE WHEN stage = 'pattern' THEN {csv('whole', 100)} ELSE {csv('line', None, False)} END AS line
        FROM everything""", "everything"),
    "pivot": query(PIVOT, "everything"),
    "pivot_runs": query(PIVOT, "everything"),
    "written_hits": report("everything"),
    "written_pivot": query(f"""
        SELECT 'pattern_or_rule;type_or_severity;hits' AS line UNION ALL
        SELECT {csv('pattern_or_rule')} || ';' || {csv('type_or_severity')} || ';' || hits FROM ({PIVOT})""", "everything"),
    "scope_summary": query(SCOPES, "relevant", "everything"),
    "scope_runs": query(SCOPES, "relevant", "everything"),
    "rule_file_shapes": """
        SELECT NULL::VARCHAR AS rule_id, 'rules_not_list' AS "check", p_brand AS detail
        FROM (SELECT DISTINCT p_brand FROM part) WHERE CAST(substr(p_brand, 7) AS INT) % 5 IN (0, 2, 3)""",
}
