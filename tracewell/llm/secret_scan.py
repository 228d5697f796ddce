"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query of trigrams is derived: a conjunction of clauses, each
a choice of strings, each string the conjunction of its trigrams. An inverted index of those trigrams over all
documents answers it by intersecting postings; only the documents found are verified with the expression
itself. A rule without mandatory trigrams is run on every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

MOST_STRINGS = 64  # of one part of an expression; a part of more is taken as any string
MASK_BITS = 62


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` reads alike in Java and Python; a match counts if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0


def either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


# What counts as a secret.
RULES = (
    SecretRule(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8, 2,
    ),
    SecretRule("access", "AKIA[A-Z0-9]+", 16),
    SecretRule("hex", "[0-9a-f]+", 32),
)


def trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def _strings(tree) -> set[str] | None:
    """Every string the part can match, in lower case; None where they are too many to list."""
    found = {""}
    for op, arg in tree:
        if op is _parser.LITERAL:
            more = {chr(arg).lower()}
        elif op is _parser.IN:
            more = set()
            for kind, value in arg:
                if kind is _parser.LITERAL:
                    more.add(chr(value).lower())
                elif kind is _parser.RANGE and value[1] - value[0] < MOST_STRINGS:
                    more |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is _parser.SUBPATTERN:
            more = _strings(arg[3])
        elif op is _parser.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is _parser.MAX_REPEAT and arg[1] == 1:
            once = _strings(arg[2])
            more = None if once is None else once | ({""} if arg[0] == 0 else set())
        else:
            return None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that hold for the lower case of every text with a match; empty where none is mandatory."""
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def close():
        choices = [trigrams(word) for word in sorted(run)]
        if all(choices):
            clauses.append(list(dict.fromkeys(choices)))

    for item in _parser.parse(pattern):
        more = _strings([item])
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close()
        run = more if more is not None else {""}
        if item[0] is _parser.MAX_REPEAT and item[1][0] > 0:  # its first turn is mandatory
            run = _strings(item[1][2]) or {""}
            close()
            run = {""}
    close()
    return clauses


def trigram_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings ``(trigram, doc_id)`` of the wanted trigrams over the lower case of all texts."""
    words = F.array(*[F.lit(t) for t in wanted])
    # the generator keeps the lower case from being made again for each trigram
    low = docs.select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))
    held = low.select("doc_id", F.filter(words, lambda t: F.contains("low", t)).alias("held"))
    return held.select(F.explode("held").alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]], wanted: list[str]) -> DataFrame:
    """``(doc_id, rules)``: the kinds whose trigram query a document answers, by intersecting postings. A
    document's postings are folded into masks before their exchange."""
    place = {t: i for i, t in enumerate(wanted)}
    numbered = F.create_map(*[F.lit(x) for t, i in place.items() for x in (t, i)])[F.col("trigram")]
    index = index.select("doc_id", numbered.alias("place"))
    parts = range(-(-len(wanted) // MASK_BITS))
    masks = index.groupBy("doc_id").agg(*[
        F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / MASK_BITS) == p, F.expr(
            f"shiftleft(1L, cast(place % {MASK_BITS} as int))"))), F.lit(0)).alias(f"m{p}")
        for p in parts
    ])

    def has(choice: frozenset[str]) -> Column:
        tests = []
        for p in parts:
            need = sum(1 << (place[t] % MASK_BITS) for t in choice if place[t] // MASK_BITS == p)
            if need:
                tests.append(F.col(f"m{p}").bitwiseAND(F.lit(need)) == need)
        return reduce(Column.__and__, tests)

    rules = [
        F.when(reduce(Column.__and__, [reduce(Column.__or__, [has(c) for c in clause]) for clause in query]), F.lit(kind))
        for kind, query in queries.items()
    ]
    found = masks.select("doc_id", F.array_compact(F.array(*rules)).alias("rules"))
    return found.where(F.size("rules") > 0)


def _spans(rule: SecretRule, rank: int, wanted: Column) -> list[tuple[str, Column]]:
    """Columns, each over those before, that end in the rule's spans: what lies between matches and the
    matches alternate, so places are running sums of their lengths in characters."""
    k = rule.kind
    pattern = F.lit(rule.pattern)
    fold = f"""
        aggregate(arrays_zip(`gaps {k}`, `all {k}`, `values {k}`),
            named_struct('at', 0L, 'out', cast(array() AS array<struct<start:bigint,rank:int,end:bigint>>)),
            (a, x) -> named_struct(
                'at', a.at + length(x[`gaps {k}`]) + coalesce(length(x[`all {k}`]), 0),
                'out', if(length(x[`values {k}`]) >= {rule.least},
                    concat(a.out, array(named_struct('start', a.at + length(x[`gaps {k}`]), 'rank', {rank},
                        'end', a.at + length(x[`gaps {k}`]) + length(x[`all {k}`])))), a.out)),
            a -> a.out)"""
    fold = fold.replace(f"x[`gaps {k}`]", "x.`0`").replace(f"x[`all {k}`]", "x.`1`").replace(f"x[`values {k}`]", "x.`2`")
    fold = fold.replace(f"arrays_zip(`gaps {k}`, `all {k}`, `values {k}`)", f"`zip {k}`")
    none = F.array().cast("array<string>")
    return [
        (f"all {k}", F.when(wanted, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none)),
        (f"values {k}", F.col(f"all {k}") if not rule.group else F.when(
            F.size(f"all {k}") > 0, F.regexp_extract_all("text", pattern, F.lit(rule.group))).otherwise(none)),
        (f"any {k}", F.exists(f"values {k}", lambda v: F.length(v) >= rule.least)),
        (f"gaps {k}", F.when(F.col(f"any {k}"), F.split("text", rule.pattern, -1)).otherwise(none)),
        (f"zip {k}", F.when(F.col(f"any {k}"), F.expr(
            f"transform(sequence(0, size(`gaps {k}`) - 1), i -> named_struct('0', `gaps {k}`[i], '1', get(`all {k}`, i), "
            f"'2', get(`values {k}`, i)))"))),
        (f"spans {k}", F.coalesce(F.expr(fold), F.expr("cast(array() AS array<struct<start:bigint,rank:int,end:bigint>>)"))),
    ]


def secret_scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, spans)``, one row per row: ``spans`` are all rules' matches as
    ``(start, rank, end)`` in code points, end exclusive, by start and then rule order (``rank`` numbers the rules).

    A rule's matches are leftmost and do not overlap; those too short are dropped after matching. Null text
    is empty; ``keep`` may name ``text`` and returns it as it was. Rows may repeat or lack a ``doc_id``; each is verified on its own text. Other columns are not read.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    texts = docs.select("doc_id", *[c for c in keep if c != "text"], "text")
    if indexed:
        wanted = sorted({t for q in indexed.values() for clause in q for choice in clause for t in choice})
        scratch = Scratch(docs.sparkSession, "secrets")
        index = scratch.keep(trigram_index(docs.select("doc_id", "text"), wanted), "index")
        found = candidates(index, indexed, wanted).select(F.col("doc_id").alias("found id"), "rules")
        # one plan at every size: both sides by doc_id, however few documents are found
        texts = texts.hint("merge").join(found, F.col("doc_id").eqNullSafe(F.col("found id")), "left").drop("found id")
    else:
        texts = texts.withColumn("rules", F.array().cast("array<string>"))
    for rank, rule in enumerate(rules):
        chosen = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) if rule.kind in indexed else F.lit(True)
        for name, value in _spans(rule, rank, chosen):
            texts = texts.withColumn(name, value)
        texts = texts.drop(*[f"{part} {rule.kind}" for part in ("all", "values", "any", "gaps", "zip")])
    spans = F.array_sort(F.concat(*[F.col(f"spans {r.kind}") for r in rules]))
    return texts.select("doc_id", *keep, spans.alias("spans"))


def span_text(spans: str, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")
