"""The pipeline's stages against brute-force versions, each on its own input."""

import re
import unicodedata

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as pipeline
from tests.llm.conftest import SF, brute_components
from tests.llm.test_scans import brute_spans, check_packing

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order():
    assert [n for n, _ in pipeline.STAGES] == [
        "language_id", "jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]


def test_language_stage_keeps_prose(spark, docs, odd_docs):
    assert texts(STAGES["language_id"](spark, docs, SF)) == texts(docs)
    kept = STAGES["language_id"](spark, odd_docs, SF)
    assert kept.columns == odd_docs.columns
    assert {1, 2, 3}.isdisjoint(texts(kept)) and {5, 6, 7, 8} <= set(texts(kept))


def test_duplicate_stage_keeps_one_of_each_group(spark, docs, documents):
    kept = STAGES["jaccard_join"](spark, docs, SF)
    groups = brute_components(documents, 5, 80)
    assert sorted(texts(kept)) == sorted(set(groups.values()))
    assert kept.columns == docs.columns and kept.count() == len(set(groups.values()))


def test_rows_without_an_id(spark, words):
    """Copies and leaks without a doc_id go like others; each is a document of its own."""
    import random

    rng = random.Random(3)
    prose = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(4)]
    item = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()[0]
    rows = [(1, prose[0]), (None, prose[0]), (None, prose[1]), (None, prose[1]), (2, prose[2]), (None, prose[3]), (None, None), (None, ""),
            (None, f"{prose[3]} {item} {prose[2]}"), (3, f"{prose[2]} {item} {prose[3]}")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1, 7) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone long")
    kept = STAGES["jaccard_join"](spark, docs, SF)
    assert kept.columns == docs.columns
    left = sorted(r["text"] for r in kept.collect() if r["text"] in prose)
    assert left == sorted(prose) and kept.count() == 7  # the last two are near copies
    clean = [r["text"] for r in STAGES["decontamination"](spark, docs, SF).collect()]
    assert len(clean) == 8 and not any(item in (t or "") for t in clean)


def test_decontamination_stage_drops_passages(spark, docs, documents):
    def norm(x):
        return " " + " ".join(re.findall(r"\w+", unicodedata.normalize("NFC", x.lower()))) + " "

    items = [norm(t) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    leaks = {d for d, t in documents.items() if any(i in norm(t) for i in items)}
    kept = set(texts(STAGES["decontamination"](spark, docs, SF)))
    assert kept == set(documents) - leaks


def test_secret_stage_leaves_none(spark, docs, documents, odd_docs):
    found = STAGES["secret_scan"](spark, docs, SF)
    assert found.schema == docs.schema
    for r in found.collect():
        want, at = "", 0
        for start, _, end in brute_spans(documents[r["doc_id"]]):
            if end > at:
                want += ("" if start < at else documents[r["doc_id"]][at:start] + "[SECRET]")
                at = end
        assert r["text"] == want + documents[r["doc_id"]][at:] and r["n_chars"] == len(r["text"])
    odd = STAGES["secret_scan"](spark, odd_docs, SF)
    assert odd.count() == odd_docs.count() and odd.columns == odd_docs.columns


def test_whole_pipeline(spark, docs):
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    left = texts(kept)
    rows = pipeline.run(spark, SF).collect()
    check_packing(rows, left.items(), 4096)


def test_empty_and_odd_documents(spark, no_docs, odd_docs):
    for docs in (no_docs, odd_docs):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        rows = docs.collect()
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} <= {4, 5, 6, 9, 10}
