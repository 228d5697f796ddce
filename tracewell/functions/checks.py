"""Rule checks as SQL expression text: booleans and scores."""

from __future__ import annotations

from tracewell.functions.regex import Line, matches
from tracewell.functions.sql import (
    Sql, all_of, any_of, case, contains, fold, is_in, let, number, struct, text, transform, where,
)
from tracewell.functions.text import occurrences
from tracewell.sources.rules import Keyword

# Score weights, limits and extensions of the string check.
CONCAT_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
JOIN_EXTENSIONS = (".py",)
POWERSHELL_EXTENSIONS = (".ps1", ".psm1")
STRING_WEIGHTS = {"plus": 1.0, "concat": 2.0, "escape": 2.5, "short_string": 0.5, "powershell_exec": 4.0}
MIN_SCORE = 12.0
MIN_STRING_LITERALS = 5
SHORT_LITERAL = 4
PLUS_EQUALS_EXTRA = 0.5
BACKTICK_WEIGHT = 0.5
SHORT_LITERAL_EXTRA = 0.25

# Patterns of the string check.
CONCAT_CALL, JOIN_CALL = r"\.concat\s*\(", r"\.join\s*\("
POWERSHELL_CALLS = ("(?iu)-bxor", "(?iu)FromBase64String", r"(?iU)\bIEX\b|\bInvoke-Expression\b")
ESCAPES = ((r"\\x[0-9a-fA-F]{2}", "\\x"), (r"\\u[0-9a-fA-F]{4}", "\\u"))
STRING_LITERAL = "'[^']*'|\"[^\"]*\""

# An identifier: an ASCII letter, '_' or '$' at a word boundary, then letters, digits, '_' and '$'
# up to the last boundary. Word characters are letters, numbers and '_', without combining marks.
_WORD = r"\p{L}\p{N}_"
TOKEN = rf"(?:(?<![{_WORD}])[_a-zA-Z]|(?<=[{_WORD}])\$)[${_WORD}]*(?<=[{_WORD}])"

# Token weights and limits of the identifier check.
SHORT_TOKEN, SHORT_TOKEN_WEIGHT = 2, 0.8
HEX_PREFIX, HEX_TOKEN_WEIGHT = "_0x", 1.2
DUNDER_TOKEN_WEIGHT = 0.5
UNDERSCORE_TOKEN_WEIGHT = 0.3
ENTROPY_TOKEN, ENTROPY_TOKEN_WEIGHT = 5, 1.0
LONG_LINE = 500
VARS_DEFAULTS = {
    "min_ratio": 0.75,
    "min_entropy_hits": 0,
    "entropy_threshold": 3.8,
    "require_hex_prefix": False,
    "require_long_lines": False,
    "min_long_lines": 3,
    "min_tokens": 50,
}


def string_length(c: Sql, min_length: int = 0) -> Sql:
    """Bytes are known without counting, and characters are never more than bytes."""
    return f"(octet_length({c}) >= {min_length} AND length({c}) >= {min_length})"


def _only(c: Sql, characters: str, min_length: int) -> Sql:
    """The whole text is of these ASCII characters, none of them a blank. Most lines have a blank
    near their start and go no further; in ASCII, bytes and characters are the same number."""
    pattern = text(rf"\A[{characters}]++\z")
    return f"(octet_length({c}) >= {min_length} AND NOT contains({c}, ' ') AND rlike({c}, {pattern}))"


def base64_suspect(c: Sql, min_length: int = 0) -> Sql:
    return _only(c, "A-Za-z0-9+/=", min_length)


def hex_suspect(c: Sql, min_length: int = 0) -> Sql:
    return _only(c, "0-9a-fA-F", min_length)


def path_access(c: Sql, paths: list[str]) -> Sql:
    return any_of(contains(c, p) for p in paths)


def keyword_test(line: Line, keyword: Keyword) -> Sql:
    if keyword.kind == "plain":
        return contains(line.lower, keyword.value)
    return matches(line, keyword.value, keyword.ignore_case)


def keyword_combination(line: Line, groups: list[list[Keyword]], threshold: int) -> Sql:
    """One group: at least ``threshold`` of its items. Several: an item of each."""
    if len(groups) == 1:
        tests = [keyword_test(line, k) for k in groups[0]]
        if threshold <= 1:
            return any_of(tests)
        if threshold > len(tests):
            return "false"
        return "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + f" >= {threshold})"
    return all_of(any_of(keyword_test(line, k) for k in group) for group in groups)


def count_matches(c: Sql, pattern: str, needs: str) -> Sql:
    """Matches of ``pattern``, each of which contains the literal ``needs``."""
    return case((contains(c, needs), f"regexp_count({c}, {text(pattern)})"), default="0")


STRING_COUNTS = ("plus", "plus_equals", "joins", "calls", "backticks", "escapes", "literals", "short")


def string_counts(t: Sql, ext: Sql, literals: bool = True) -> Sql:
    """What ``obfuscation_score`` counts in a text, as a struct; without ``literals`` those are left at 0."""
    joins = case(
        (is_in(ext, CONCAT_EXTENSIONS), count_matches(t, rf"(?U){CONCAT_CALL}", ".concat")),
        (is_in(ext, JOIN_EXTENSIONS), count_matches(t, rf"(?U){JOIN_CALL}", ".join")),
        default="0",
    )
    calls = " + ".join(f"regexp_count({t}, {text(rx)})" for rx in POWERSHELL_CALLS)
    powershell = is_in(ext, POWERSHELL_EXTENSIONS)
    escapes = " + ".join(count_matches(t, rx, needs) for rx, needs in ESCAPES)
    lengths = transform(f"regexp_extract_all({t}, {text(STRING_LITERAL)}, 0)", lambda s: f"length({s})")
    sizes = lambda of: struct(n=f"size({of})", short=f"size({where(of, lambda n: f'{n} <= {SHORT_LITERAL}')})")
    none = struct(n="0", short="0")
    quoted = any_of([contains(t, '"'), contains(t, "'")])
    found = case((quoted, let(lengths, sizes)), default=none) if literals else none
    return let(found, lambda f: struct(
        plus=occurrences(t, "+"), plus_equals=occurrences(t, "+="), joins=joins, calls=case((powershell, calls), default="0"),
        backticks=case((powershell, occurrences(t, "`")), default="0"), escapes=f"({escapes})", literals=f"{f}.n", short=f"{f}.short",
    ))


def score_of_counts(n: Sql, weights: dict | None = None, min_literals: int = MIN_STRING_LITERALS) -> Sql:
    w = {**STRING_WEIGHTS, **(weights or {})}
    many = lambda field, weight: case((f"{n}.{field} >= {min_literals}", f"{n}.{field} * {number(weight)}"), default="0.0D")
    parts = [
        f"{n}.plus_equals * {number(w['plus'] + PLUS_EQUALS_EXTRA)}",
        f"({n}.plus - {n}.plus_equals) * {number(w['plus'])}",
        f"{n}.joins * {number(w['concat'])}",
        f"{n}.calls * {number(w['powershell_exec'])}",
        f"{n}.backticks * {number(BACKTICK_WEIGHT)}",
        f"{n}.escapes * {number(w['escape'])}",
        many("literals", w["short_string"]),
        many("short", w["short_string"] + SHORT_LITERAL_EXTRA),
    ]
    # Weights are multiples of 0.05, so a score can sit on a limit: drop the noise of the sum.
    return f"round({' + '.join(parts)}, 9)"


def obfuscation_score(
    c: Sql, ext: Sql, weights: dict | None = None, min_literals: int = MIN_STRING_LITERALS
) -> Sql:
    """Weighted count of string building, escapes and literals in a text."""
    return let(let(c, lambda t: string_counts(t, ext)), lambda n: score_of_counts(n, weights, min_literals))


def identifiers(c: Sql) -> Sql:
    """Identifier tokens of a text, in order, with repeats."""
    return f"regexp_extract_all({c}, {text(TOKEN)}, 0)"


def entropy(token: Sql) -> Sql:
    """Bits per character, 0 for the empty string."""

    def bits(t: Sql) -> Sql:
        characters = f"array_distinct(regexp_extract_all({t}, '(?s).', 0))"
        share = lambda ch: f"(length({t}) - length(replace({t}, {ch}, ''))) / length({t})"
        total = fold(
            transform(characters, share), "0.0D", lambda acc, p: f"{acc} - {p} * log2({p})", lambda acc: acc
        )
        return case((f"{t} = ''", "0.0D"), default=total)

    return f"round({let(token, bits)}, 9)"


def is_high_entropy(token: Sql, threshold: float) -> Sql:
    """Same as ``entropy(token) >= threshold``; a token of n characters has at most log2(n) bits,
    so most tokens are told from their length alone."""
    shortest = max(ENTROPY_TOKEN, int(2 ** (threshold - 1e-6)))
    return f"(length({token}) >= {shortest} AND {entropy(token)} >= {number(threshold)})"


def long_lines(c: Sql) -> Sql:
    newline = text("\n")
    return f"size({where(f'split({c}, {newline})', lambda line: f'length({line}) > {LONG_LINE}')})"


def identifier_stats(c: Sql, entropy_threshold: float) -> Sql:
    """``struct(tokens, weight, hex_hits, entropy_hits, long_lines)`` of a text."""

    def add(acc: Sql, t: Sql) -> Sql:
        def plus(weight: float, hex_hit: int = 0, entropy_hit: int = 0) -> Sql:
            return struct(
                w=f"{acc}.w + {number(weight)}", hex=f"{acc}.hex + {hex_hit}", ent=f"{acc}.ent + {entropy_hit}"
            )

        return case(
            (f"octet_length({t}) <= {SHORT_TOKEN} OR length({t}) <= {SHORT_TOKEN}", plus(SHORT_TOKEN_WEIGHT)),
            (f"startswith({t}, '_')", case(
                (f"startswith({t}, {text(HEX_PREFIX)})", plus(HEX_TOKEN_WEIGHT, hex_hit=1)),
                (f"startswith({t}, '__')", plus(DUNDER_TOKEN_WEIGHT)),
                default=plus(UNDERSCORE_TOKEN_WEIGHT),
            )),
            (is_high_entropy(t, entropy_threshold), plus(ENTROPY_TOKEN_WEIGHT, entropy_hit=1)),
            default=acc,
        )

    def stats(tokens: Sql) -> Sql:
        return fold(
            tokens,
            struct(w="0.0D", hex="0", ent="0"),
            add,
            lambda acc: struct(
                tokens=f"size({tokens})",
                weight=f"round({acc}.w, 9)",
                hex_hits=f"{acc}.hex",
                entropy_hits=f"{acc}.ent",
                long_lines=long_lines(c),
            ),
        )

    return let(identifiers(c), stats)


def obfuscated_vars(c: Sql, parameters: dict) -> Sql:
    """Identifier shape test of a text. What a byte search or line lengths can refuse is refused
    before any token is made."""
    p = {**VARS_DEFAULTS, **parameters}
    refusals = []
    if p["require_hex_prefix"]:
        refusals.append(contains(c, HEX_PREFIX))
    if p["require_long_lines"]:
        refusals.append(f"{long_lines(c)} >= {p['min_long_lines']}")
    stats = identifier_stats(c, float(p["entropy_threshold"]))
    return all_of([*refusals, let(stats, lambda s: vars_of_stats(s, parameters))])


def vars_of_stats(s: Sql, parameters: dict) -> Sql:
    """The identifier shape test on ``identifier_stats``."""
    p = {**VARS_DEFAULTS, **parameters}
    ratio = case((f"{s}.tokens > 0", f"{s}.weight / {s}.tokens"), default="1000.0D")
    tests = [
        f"{s}.tokens >= {p['min_tokens']}",
        f"round({ratio}, 9) >= {number(p['min_ratio'])}",
        f"{s}.entropy_hits >= {p['min_entropy_hits']}",
    ]
    if p["require_hex_prefix"]:
        tests.append(f"{s}.hex_hits > 0")
    if p["require_long_lines"]:
        tests.append(f"{s}.long_lines >= {p['min_long_lines']}")
    return all_of(tests)
