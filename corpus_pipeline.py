"""Cleaning and packing of ``documents``, stage by stage. Each stage takes ``(spark, docs, sf_dir)``, and all but
the last return the columns of ``documents``.

Rows that share a ``doc_id`` are one document: they stay or go together; a row without one is a document of its own. Extra
columns of ``docs`` travel along. ``tracewell.llm.stages`` says what each stage does with nulls and empty texts.
"""

from __future__ import annotations

from tracewell.llm import stages
from tracewell.llm.language_id import held_out
from tracewell.llm.packing import pack_documents
from tracewell.llm.queries import tokenizer_file
from tracewell.llm.storage import Scratch


def language_stage(spark, docs, sf_dir):
    """Drops documents in no language: without a letter, or with hardly a known n-gram."""
    return stages.in_a_language(docs, docs.where(~held_out("doc_id", 4, 2)))


def near_duplicate_stage(spark, docs, sf_dir):
    """Keeps the smallest doc_id of each group of linked documents (five-word shingles, Jaccard of 0.8)."""
    return stages.without_near_duplicates(docs, n=5, percent=80)


def decontamination_stage(spark, docs, sf_dir):
    """Drops documents that hold a passage of the benchmark."""
    return stages.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark, docs, sf_dir):
    """Writes ``[SECRET]`` in place of each secret."""
    return stages.without_secrets(docs)


def packing_stage(spark, docs, sf_dir):
    """Packs what is left into sequences of 4096 tokens; a row per piece."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

# Latent retrieval and packing are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to ``documents``; each result is written and read again as the next one's input, and deleted
    once that is done with it."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
