
from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle.sql import ORACLES
from tracewell.functions import checks
from tracewell.functions.text import decode_text
from tracewell.operators import file_rules, files as fo, line_rules, lines as lo, patterns as po, report, rules as ro
from tracewell.operators.hits import explode_hits, keep_where, report_columns
from tracewell.options import ScanOptions
from tracewell.plans.catalog import catalog, pattern_list_lines
from tracewell.plans.corpus import STARTER_PACKS, STARTER_RULES, corpus
from tracewell.plans.pieces import scan_table
from tracewell.plans.scan import prepare, scan, scan_with_filenames
from tracewell.sources import sinks
from tracewell.sources.packs import Pack, Packs, parse_pattern_lines
from tracewell.sources.rules import Rule
from tracewell.sources.tables import new_folder

try:
    import corpus_pipeline
    from tracewell.llm import queries as llm
except ModuleNotFoundError as missing:  # the subpackage is optional, what it needs is not
    if not (missing.name or "").startswith(("corpus_pipeline", "tracewell.llm")):
        raise
    llm = None

PIECE_BYTES = 8192

# Whole files, but for the queries of the default limits.
DEFAULT = ScanOptions()
OPTIONS = replace(DEFAULT, no_bail_out=True)
ALL = replace(OPTIONS, all_matches=True)
FORENSIC = OPTIONS.forensic()
MAX_BYTES = 12_000


def _rule(name: str) -> Rule:
    return next(r for r in STARTER_RULES if r.id == name)


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


def _kept(spark: SparkSession, sf: str, o: ScanOptions = OPTIONS) -> DataFrame:
    return prepare(corpus(spark, sf), o)


def _lines(spark: SparkSession, sf: str, o: ScanOptions = FORENSIC) -> DataFrame:
    return lo.kept_lines(_kept(spark, sf, o))


def _marked(spark: SparkSession, sf: str, o: ScanOptions) -> DataFrame:
    return line_rules.with_marks(_kept(spark, sf, o), None, STARTER_RULES, o)


# ---- sources, files, lines

def decoded(spark, sf):
    """Latin-1 bytes of the documents (characters beyond Latin-1 become '?') and how they decode."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    narrow = F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(narrow, "ISO-8859-1"))
    encoded = documents.select("doc_id", content.alias("content"))
    return encoded.select("doc_id", F.expr(decode_text("content")).alias("text"))


def lines(spark, sf):
    return lo.raw_lines(corpus(spark, sf)).select("file_id", "line_no", "raw")


def file_inventory(spark, sf):
    return corpus(spark, sf).select("file_id", "scope", "path", "basename", "ext", "parent")


def relevant_files(spark, sf):
    return fo.relevant_files(corpus(spark, sf), OPTIONS).select("file_id", "path", "ext", "scan_kind")


def exclude_dirs(spark, sf):
    base = replace(OPTIONS, exclude_dirs=("node_modules", ".git", "dist"))
    found = corpus(spark, sf).select("file_id", "path", "parent")
    modes = [
        fo.exclude_dirs(found, replace(base, exclude_mode=mode)).select("file_id", "path", F.lit(mode).alias("mode"))
        for mode in ("parent", "subtree")
    ]
    return modes[0].unionByName(modes[1])


def scan_errors(spark, sf):
    """Files over the caller's size limit, and those a source could not read (here: the odd turns
    of even conversations)."""
    found = corpus(spark, sf)
    unreadable = F.col("file_id").rlike(r"^c\d*[02468]_\d*[13579]$")
    content = F.when(~unreadable, F.encode("text", "UTF-8"))
    _, errors = fo.split_readable(found.select("file_id", content.alias("content")), MAX_BYTES)
    return errors


def _stripped(spark, sf, exts):
    found = corpus(spark, sf).filter(F.col("ext").isin(exts))
    kept = lo.with_kept_lines(found.select("file_id", "ext", "text"), FORENSIC)
    return lo.kept_lines(kept).select("file_id", "line_no", "code")


def strip_shell(spark, sf):
    return _stripped(spark, sf, OPTIONS.shell_extensions)


def strip_python(spark, sf):
    return _stripped(spark, sf, [".py"])


def strip_block(spark, sf):
    return _stripped(spark, sf, OPTIONS.block_comment_extensions)


def bail_out(spark, sf):
    return _lines(spark, sf, DEFAULT).select("file_id", "line_no", F.length("raw").cast("bigint").alias("chars"))


# ---- patterns

def filename_hits(spark, sf):
    return report_columns(fo.filename_hits(corpus(spark, sf), list(STARTER_PACKS.names)))


def _pattern_rows(spark, sf, mode):
    return po.pattern_hits(_lines(spark, sf), STARTER_PACKS, FORENSIC, mode)


def plain_hits(spark, sf):
    found = _pattern_rows(spark, sf, "all").filter(F.col("type_or_severity") == "normal")
    return found.select("file", "line_number", "pattern_or_rule")


def regex_hits(spark, sf):
    found = _pattern_rows(spark, sf, "all").filter(F.col("type_or_severity") == "regex")
    return found.select("file", "line_number", "pattern_or_rule")


def pattern_hits(spark, sf):
    return report_columns(po.pattern_hits(_lines(spark, sf, OPTIONS), STARTER_PACKS, OPTIONS))


def pattern_hits_all(spark, sf):
    return report_columns(_pattern_rows(spark, sf, "all"))


def ngram_pattern_hits(spark, sf):
    """Every word of six or more letters in the benchmark texts as a pattern, on all kept lines."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("pattern")
    )
    found = po.pattern_table_hits(_lines(spark, sf), words.distinct(), n=6)
    return found.groupBy("file_id", "line_no").agg(
        F.count("*").alias("patterns"), F.min("pattern").alias("first_pattern"), F.max("pattern").alias("last_pattern")
    )


# ---- rule catalog

def pattern_packs(spark, sf):
    return parse_pattern_lines(pattern_list_lines(_part(spark, sf)))


def rules_catalog(spark, sf):
    found = ro.at_level(catalog(_part(spark, sf)), "medium")
    return found.select(
        "id", "name", "type", "scope", "severity", "only_if_no_match", "heuristic_threshold", "priority",
        F.array_join(F.coalesce("applies_to.extensions", F.array().cast("array<string>")), ",").alias("extensions"),
        F.get_json_object("parameters", "$.min_length").cast("bigint").alias("min_length"), "source_file", "idx",
    )


def rule_counts(spark, sf):
    return ro.rule_counts(catalog(_part(spark, sf)), "low")


def rule_order(spark, sf):
    return ro.order_rules(catalog(_part(spark, sf)), "low").select("idx", "id", "severity", "rule_order")


def rule_keywords(spark, sf):
    found = ro.rule_keywords(catalog(_part(spark, sf)))
    return found.withColumn("flags", F.array_join("flags", ","))


def rule_applicability(spark, sf):
    return ro.applicable(catalog(_part(spark, sf)), corpus(spark, sf), OPTIONS)


def rule_lint(spark, sf):
    return ro.lint_rules(catalog(_part(spark, sf)), OPTIONS)


# ---- line rules

def _lines_where(test):
    def query(spark, sf):
        rows, line = po.with_line_columns(_lines(spark, sf))
        return rows.filter(test(line)).select("file_id", "line_no")

    return query


def _keyword_rule(name):
    rule = _rule(name)
    return _lines_where(lambda line: checks.keyword_combination(line, rule.keyword_groups(), rule.keyword_threshold()))


def obf_strings_line(spark, sf):
    scored = _lines(spark, sf).withColumn("score", F.expr(checks.obfuscation_score("code", "ext")))
    return keep_where(scored, "score > 0").select("file_id", "line_no", "score")


def fallback_gate(spark, sf):
    found = line_rules.gated_event_rows(_marked(spark, sf, OPTIONS), STARTER_RULES, OPTIONS)
    return found.select("file_id", "rule_id", "rule_order", "line_no", "severity")


def line_rule_events(spark, sf):
    found = line_rules.line_rule_events(_lines(spark, sf, OPTIONS), STARTER_RULES, OPTIONS)
    return found.select("file_id", "rule_id", "rule_order", "line_no", "severity")


def _line_rule_hits(spark, sf, o):
    return report_columns(explode_hits(_marked(spark, sf, o), line_rules.line_rule_hit_array(STARTER_RULES, o)))


def line_rule_hits(spark, sf):
    return _line_rule_hits(spark, sf, OPTIONS)


def line_rule_hits_all(spark, sf):
    return _line_rule_hits(spark, sf, ALL)


# ---- file rules

def file_text(spark, sf):
    text = file_rules.with_file_text(_kept(spark, sf), OPTIONS)
    return text.select("file_id", F.length("file_text").cast("bigint").alias("chars"), F.md5("file_text").alias("digest"))


def _file_rule_hits(spark, sf, names, o=OPTIONS):
    rules = [_rule(n) for n in names]
    marked = line_rules.with_marks(_kept(spark, sf, o), None, rules, o)
    files = file_rules.with_file_text(marked, o)
    return report_columns(explode_hits(files, file_rules.file_rule_hit_array(rules, o)))


def file_keyword(spark, sf):
    return _file_rule_hits(spark, sf, ["decode_file", "stop_words"])


def minified_files(spark, sf):
    return keep_where(_kept(spark, sf), file_rules.is_minified(OPTIONS)).select("file_id", "ext")


def obf_strings_file(spark, sf):
    rule = _rule("string_heap")
    text = file_rules.with_file_text(_kept(spark, sf), OPTIONS)
    score = checks.obfuscation_score("file_text", "ext", rule.parameters["weights"])
    return text.select("file_id", F.expr(score).alias("score"))


def identifier_stats(spark, sf):
    text = file_rules.with_file_text(_kept(spark, sf), OPTIONS)
    stats = text.select("file_id", F.expr(checks.identifier_stats("file_text", 3.8)).alias("s"))
    return stats.select(
        "file_id",
        *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("tokens", "hex_hits", "entropy_hits", "long_lines")],
        F.col("s.weight").alias("weight"),
    )


def token_entropy(spark, sf):
    """Entropy of each distinct identifier; repeats are summed before the exchange."""
    text = file_rules.with_file_text(_kept(spark, sf), OPTIONS)
    tokens = text.select(F.expr(f"explode({checks.identifiers('file_text')})").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("uses"))
    return counts.select("token", "uses", F.expr(checks.entropy("token")).alias("entropy"))


def obf_vars(spark, sf):
    return _file_rule_hits(spark, sf, ["renamed_identifiers"])


# ---- whole scans and reports

def _scan(spark, sf, o=OPTIONS):
    return scan_with_filenames(corpus(spark, sf), STARTER_PACKS, STARTER_RULES, o)


def hits(spark, sf):
    return report_columns(_scan(spark, sf))


def default_hits(spark, sf):
    """A scan that stops in each file at the default limits."""
    return report_columns(_scan(spark, sf, DEFAULT))


def signature_gate(spark, sf):
    """A scan in which rules leave lines and files alone that have a pattern hit."""
    return report_columns(_scan(spark, sf, replace(OPTIONS, signature_gate=True)))


def forensic_hits(spark, sf):
    return report_columns(_scan(spark, sf, FORENSIC))


def piece_hits(spark, sf):
    """All findings, files beyond some kilobytes being scanned in pieces."""
    return report_columns(scan_table(corpus(spark, sf), STARTER_PACKS, STARTER_RULES, OPTIONS, PIECE_BYTES))


# Inside a group its own condition never holds, so this is \b(spawn_shell|exec_now)\b; Java cannot ask that.
PYTHON_ONLY = r"\b((?(1)x|spawn)_shell|exec(?(1)-|_)now)\b"


def python_regex_hits(spark, sf):
    """Hits of a pattern that only Python can say."""
    pack = Pack(regex=(PYTHON_ONLY,))
    found = po.pattern_hits(_lines(spark, sf), Packs(content=pack, shell=pack), FORENSIC, "all")
    return found.select("file", "line_number", F.lit("spawn or exec").alias("pattern"))


CONTEXT_RULES = [
    replace(r, applies_to=r.applies_to | {"scan_context": contexts})
    for name, contexts in (("decode_file", ["backend"]), ("stop_words", ["frontend", "batch"])) for r in [_rule(name)]
]


def context_hits(spark, sf):
    """File rules that ask for a context, on files of two contexts and of none."""
    context = F.expr("CASE parent WHEN 'src' THEN 'frontend' WHEN 'lib' THEN 'backend' END")
    files = corpus(spark, sf).withColumn("context", context)
    return report_columns(scan(files, Packs(), CONTEXT_RULES, replace(OPTIONS, context_column="context")))


def csv_hits(spark, sf):
    return report.csv_columns(_scan(spark, sf), OPTIONS)


def pivot(spark, sf):
    return report.pivot(_scan(spark, sf))


def scope_summary(spark, sf):
    return report.scope_summary(_scan(spark, sf), corpus(spark, sf), OPTIONS)


def _written(spark, sf) -> tuple[str, DataFrame]:
    folder = new_folder(spark, "report")
    sinks.write_hits(_scan(spark, sf), f"{folder}/hits", OPTIONS)
    return folder, spark.read.parquet(f"{folder}/hits")


def written_hits(spark, sf):
    """Hits written and read back."""
    return report_columns(_written(spark, sf)[1])


def written_pivot(spark, sf):
    """Lines of the written pivot."""
    folder, found = _written(spark, sf)
    sinks.write_pivot(found, f"{folder}/pivot")
    return spark.read.text(f"{folder}/pivot").withColumnRenamed("value", "line")


def _runs(spark, sf) -> str:
    """Partial reports of three runs, each with a third of the files."""
    folder, found = _written(spark, sf)
    files = corpus(spark, sf)
    for run in range(3):
        of_run = lambda c: F.crc32(c) % 3 == run  # noqa: E731, B023
        sinks.write_run(found.where(of_run("file")), files.where(of_run("path")), f"{folder}/reports", f"r{run}", OPTIONS)
    return f"{folder}/reports"


def pivot_runs(spark, sf):
    """The pivot merged from those of three runs."""
    return sinks.pivot_of_runs(spark, _runs(spark, sf))


def scope_runs(spark, sf):
    return sinks.scopes_of_runs(spark, _runs(spark, sf))


def rule_file_shapes(spark, sf):
    """Rule files, one per brand, of each shape a file may have."""
    brands = _part(spark, sf).select("p_brand").distinct()
    shape = F.expr("CAST(substring(p_brand, 7) AS INT) % 5")
    value = (
        F.when(shape == 0, F.lit('{"rules": {"id": "a"}}')).when(shape == 1, F.lit('{"rules": [{"id": "a"}, 5]}'))
        .when(shape == 2, F.lit("{}")).when(shape == 3, F.lit('{"rules": [')).otherwise(F.lit('{"rules": []}'))
    )
    return ro.rule_file_problems(brands.select(F.col("p_brand").alias("source_file"), value.alias("value")))


def entry(spark: SparkSession) -> DataFrame:
    """All findings over the smallest corpus."""
    return hits(spark, "/root/testdata/sf0.001").orderBy("file", "line_number", "pattern_or_rule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Those of the library without its optional subpackage."""
    return {
        "decode_text": decoded,
        "lines": lines,
        "file_inventory": file_inventory,
        "relevant_files": relevant_files,
        "exclude_dirs": exclude_dirs,
        "scan_errors": scan_errors,
        "strip_shell": strip_shell,
        "strip_python": strip_python,
        "strip_block": strip_block,
        "bail_out": bail_out,
        "filename_hits": filename_hits,
        "plain_hits": plain_hits,
        "regex_hits": regex_hits,
        "python_regex_hits": python_regex_hits,
        "pattern_hits": pattern_hits,
        "pattern_hits_all": pattern_hits_all,
        "ngram_pattern_hits": ngram_pattern_hits,
        "pattern_packs": pattern_packs,
        "rules_catalog": rules_catalog,
        "rule_counts": rule_counts,
        "rule_order": rule_order,
        "rule_keywords": rule_keywords,
        "rule_applicability": rule_applicability,
        "rule_lint": rule_lint,
        "rule_file_shapes": rule_file_shapes,
        "rule_string_length": _lines_where(lambda line: checks.string_length(line.text, 240)),
        "rule_base64": _lines_where(lambda line: checks.base64_suspect(line.text, 20)),
        "rule_hex": _lines_where(lambda line: checks.hex_suspect(line.text, 20)),
        "rule_path_access": _lines_where(lambda line: checks.path_access(line.text, _rule("secret_path").parameters["paths"])),
        "rule_keyword_single": _keyword_rule("decode_words"),
        "rule_keyword_multi": _keyword_rule("read_then_now"),
        "obf_strings_line": obf_strings_line,
        "line_rule_events": line_rule_events,
        "fallback_gate": fallback_gate,
        "line_rule_hits": line_rule_hits,
        "line_rule_hits_all": line_rule_hits_all,
        "file_text": file_text,
        "file_keyword": file_keyword,
        "minified_files": minified_files,
        "obf_strings_file": obf_strings_file,
        "identifier_stats": identifier_stats,
        "token_entropy": token_entropy,
        "obf_vars": obf_vars,
        "all_hits": hits,
        "default_hits": default_hits,
        "signature_gate": signature_gate,
        "forensic_hits": forensic_hits,
        "piece_hits": piece_hits,
        "context_hits": context_hits,
        "csv_hits": csv_hits,
        "pivot": pivot,
        "written_hits": written_hits,
        "written_pivot": written_pivot,
        "pivot_runs": pivot_runs,
        "scope_runs": scope_runs,
        "scope_summary": scope_summary,
    }


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
