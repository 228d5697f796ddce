"""What a corpus pipeline does with the operators' results: which rows stay, and how.

All take ``docs`` with the columns of ``documents`` (others travel along) and return those columns. Rows that share a ``doc_id``
are one document and stay or go together; a row without one is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.decontamination import contaminated
from tracewell.llm.jaccard_join import jaccard_components
from tracewell.llm.language_id import UNKNOWN, detect, fit
from tracewell.llm.secret_scan import secret_scan
from tracewell.llm.storage import Scratch

# A text of whose n-grams fewer are known, in the language that knows most, is in no language.
LEAST_KNOWN = 0.1
KEY = "document of this run"
NO_ID = -(2**63)  # ids of rows without one count up from here
SECRET = "[SECRET]"


def in_a_language(docs: DataFrame, training: DataFrame, least_known: float = LEAST_KNOWN) -> DataFrame:
    """Drops texts in no language: null, without a letter, or with fewer than ``least_known`` of their n-grams known to any
    language that ``training`` (rows of ``docs``) taught."""
    found = detect(docs, fit(training), docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("coverage") >= least_known)).select(*docs.columns)


def identified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``KEY``: the ``doc_id``, or a number of the row's own, which is written so that it stays the same."""
    own = F.lit(NO_ID).cast("long") + F.monotonically_increasing_id()
    unnamed = scratch.keep(docs.where("doc_id IS NULL").withColumn(KEY, own), "unnamed")
    return docs.where("doc_id IS NOT NULL").withColumn(KEY, F.col("doc_id").cast("long")).unionByName(unnamed)


def _without(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    return docs.join(gone, docs[KEY] == gone["gone"], "left_anti").select(*columns)


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked ones; rows without an id come before others. Texts
    without words link with nothing and stay."""
    keyed = identified(docs, Scratch(docs.sparkSession, "near-duplicates"))
    groups = jaccard_components(keyed.select(F.col(KEY).alias("doc_id"), "text"), n, percent)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return _without(keyed, gone, docs.columns)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    keyed = identified(docs, Scratch(docs.sparkSession, "leaks"))
    gone = contaminated(keyed.select(F.col(KEY).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("gone")).distinct()
    return _without(keyed, gone, docs.columns)


def without_secrets(docs: DataFrame) -> DataFrame:
    """Writes ``SECRET`` in place of each secret; where matches of two rules overlap, over both. Null texts stay null."""
    found = secret_scan(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))
    cut = F.expr(f"""
        aggregate(spans, named_struct('at', 0L, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct(
            'at', s.end,
            'out', if(s.start < a.at, a.out,
                concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), '{SECRET}')))),
            a -> concat(a.out, substring(text, cast(a.at + 1 as int))))""")
    clean = found.withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
