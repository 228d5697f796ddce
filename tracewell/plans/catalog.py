"""A rule catalog and pattern lists made from the ``part`` table, for the catalog operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.rules import rules_from_json

TYPES = {
    "ECONOMY": "string_length",
    "SMALL": "base64_suspect",
    "MEDIUM": "hex_suspect",
    "PROMO": "path_access",
    "STANDARD": "keyword_combination",
    "LARGE": "obfuscation_strings",
}
EXTENSION_LISTS = [["javascript"], ["python", ".vue"], ["unix_shell", "ruby", ".py"], ["c_cpp", "cobol"]]


def _words() -> tuple[Column, Column]:
    return F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)


def _parameters() -> Column:
    """JSON text. Keyword rules get each form a keyword may have, and some that it may not."""
    key = F.col("p_partkey")
    one, two = _words()
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    keywords = (
        F.when(key % 7 == 0, text('{"keywords":["', F.upper(one), '","', two, '"]}'))
        .when(key % 7 == 1, text('{"keywords":[["', one, '","', two, '","x"]],"threshold":[2]}'))
        .when(key % 7 == 2, text('{"keywords":[{"regex":"', one, '_[a-z]+","flags":["IGNORECASE"]},["', two, '"]]}'))
        .when(key % 7 == 3, text('{"keywords":[["', one, '",{"regex":"(', two, '"},5],7]}'))
        .when(key % 7 == 4, text('{"keywords":[["', one, '"],["', two, '"]],"threshold":[1,2]}'))
        .when(key % 7 == 5, F.lit('{"keywords":[5,{"word":"x"}]}'))
        .otherwise(text('{"keywords":["', one, '"],"threshold":3}'))
    )
    length = text('{"min_length":', (F.col("p_size") * 10).cast("string"), "}")
    paths = text('{"paths":["/opt/', one, '","/srv/', two, '"]}')
    return (
        F.when(F.col("p_type") == "STANDARD", keywords)
        .when(F.col("p_type") == "PROMO", paths)
        .when(F.col("p_type") == "LARGE", F.lit("{}"))
        .otherwise(length)
    )


def rule_texts(part: DataFrame) -> DataFrame:
    """One rule per part, as JSON text; some are broken in each way ``lint_rules`` knows."""
    key, size = F.col("p_partkey"), F.col("p_size")
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    text = lambda c: c.cast("string")
    extensions = F.element_at(
        F.array(*[F.array(*map(F.lit, names)) for names in EXTENSION_LISTS]), (key % 4 + 1).cast("int")
    )
    fields = {
        "id": F.when(key % 131 != 7, F.concat(F.lit("rule_"), text(F.when(key % 50 == 49, key - 1).otherwise(key)))),
        "name": F.when(key % 3 != 0, F.col("p_name")),
        "type": F.when(key % 101 == 3, F.lit(None)).when(size == 49, "entropy_map").when(
            size == 50, "obfuscation_vars"
        ).otherwise(types[F.col("p_type")]),
        "scope": F.when(key % 103 == 5, F.lit(None)).when(key % 107 == 6, "project").when(
            key % 5 == 0, "file"
        ).otherwise("line"),
        "severity": F.when(key % 109 == 8, "HIGH").when(key % 3 == 0, "low").when(key % 3 == 1, "medium").otherwise("high"),
        "only_if_no_match": F.when(key % 2 == 0, key % 4 == 0),
        "heuristic_threshold": F.when(key % 3 == 1, (size % 5 + 1).cast("int")),
        "priority": F.when(key % 4 == 1, size),
        "applies_to": F.when(key % 6 < 4, F.struct(extensions.alias("extensions"))),
        "parameters": F.parse_json(_parameters()),
    }
    rule = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return part.select(
        F.concat(F.lit("rules."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".json")).alias("source_file"),
        key.alias("idx"),
        rule.alias("value"),
    )


def catalog(part: DataFrame) -> DataFrame:
    return rules_from_json(rule_texts(part))


def pattern_list_lines(part: DataFrame) -> DataFrame:
    """Lines of pattern lists, a list per brand and kind, with each kind of line a list may have."""
    key = F.col("p_partkey")
    line = (
        F.when(key % 5 == 0, F.concat(F.lit('  "'), F.col("p_name"), F.lit(' "  # '), F.col("p_type")))
        .when(key % 5 == 1, F.concat(F.lit("# "), F.col("p_name")))
        .when(key % 5 == 2, F.concat(F.lit(" "), F.col("p_name"), F.lit("\t")))
        .when(key % 5 == 3, F.concat(F.lit('"'), F.col("p_name"), F.lit('#tail"')))
        .otherwise(F.when(F.col("p_size") % 2 == 0, '""').otherwise("   "))
    )
    return part.select(
        F.col("p_brand").alias("pack"),
        F.when(key % 2 == 0, "plain").otherwise("regex").alias("kind"),
        key.alias("line_no"),
        line.alias("line"),
    )
