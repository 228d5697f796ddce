"""Queries over the given tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.class_lm import score_texts
from tracewell.llm.decontamination import contaminated
from tracewell.llm.jaccard_join import jaccard_components
from tracewell.llm import quality, toxicity, warc
from tracewell.llm.centroids import centroid_digest, cluster_vectors
from tracewell.llm.language_id import held_out, language_id
from tracewell.llm.neighbours import nearest_neighbours
from tracewell.llm.oracle import ORACLES
from tracewell.llm.packing import pack_documents
from tracewell.llm.paragraph_dedup import repeated_paragraphs
from tracewell.llm.secret_scan import RULES, secret_scan, span_text
from tracewell.llm.source_audit import source_audit


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark, sf):
    found = secret_scan(_read(spark, sf, "documents"))
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.rank = {k})) as bigint)").alias(f"n_{r.kind}") for k, r in enumerate(RULES)
    ]
    texts = found.select("doc_id", *counts, span_text("spans").alias("spans"))
    return texts.select("doc_id", *[f"n_{r.kind}" for r in RULES], F.sha2("spans", 256).alias("base_sha256"), "spans")


def op2_best_fit_packing(spark, sf):
    return pack_documents(_read(spark, sf, "documents"), tokenizer_file())


def op3_substring_dedup(spark, sf):
    return repeated_paragraphs(_read(spark, sf, "documents"))


def op4_quality_classifier(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    labels = _read(spark, sf, "labels").where(~held_out("doc_id", 5, 0))
    return quality.score(docs, quality.fit(docs.where("NOT held_out"), labels), ["doc_id", "held_out"])


def op5_class_lm(spark, sf):
    return score_texts(_read(spark, sf, "documents"), held_out("doc_id", 5, 1))


def op6_jaccard_join(spark, sf):
    return jaccard_components(_read(spark, sf, "documents"))


def op7_warc(spark, sf):
    return warc.round_trip(_read(spark, sf, "pages"))


def op8_decontamination(spark, sf):
    return contaminated(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op9_language_id(spark, sf):
    return language_id(_read(spark, sf, "documents"))


def op10_nn_descent(spark, sf):
    return nearest_neighbours(_read(spark, sf, "embeddings"))


def op11_source_audit(spark, sf):
    return source_audit(_read(spark, sf, "documents"))


def op12_centroids(spark, sf):
    state, centroids = cluster_vectors(_read(spark, sf, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect() if r["s"] is not None}
    facts = spark.createDataFrame(
        [(c, str(sums[c]), str(sum(sums.values())), centroid_digest(v)) for c, v in enumerate(centroids) if c in sums],
        "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    long = [F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
    return state.join(F.broadcast(facts), "cluster", "left").select("vec_id", "cluster", *long, "centroid_sha256")


def op13_toxicity(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    labels = _read(spark, sf, "labels").where(~held_out("doc_id", 5, 0))
    return toxicity.score(docs, toxicity.fit(docs.where("NOT held_out"), labels), ["doc_id", "held_out"])


QUERIES = (
    op1_secret_scan, op2_best_fit_packing, op3_substring_dedup, op4_quality_classifier, op5_class_lm, op6_jaccard_join,
    op7_warc, op8_decontamination, op9_language_id, op10_nn_descent, op11_source_audit, op12_centroids, op13_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
