"""Quality by compression: a text that good texts' dictionary shortens more than bad texts' does is good.

A zstandard dictionary is trained on good and another on bad labelled texts. A text is cut into blocks (all of it),
each compressed on its own with either dictionary, so that long texts count in full; the difference of the summed
sizes over their greater one is a score, which a logistic curve fitted on other labelled texts makes a probability.

Labels teach through a sample of at most ``SAMPLE`` texts of each class for the dictionaries and as many for the curve,
of at most ``SAMPLE_BYTES`` in all for each, taken in the order of a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.storage import bound_batches
from tracewell.llm.words import byte_column

SAMPLE = 1000
SAMPLE_BYTES = 8_000_000
DICTIONARY_BYTES = 112_640
BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.3


def dictionary(texts: list[bytes]) -> bytes:
    """What zstandard learns of the texts' blocks; their end itself where they are too few to learn from."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=512, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b" " * 8


def size_difference(column: pa.Array, dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """``(bad - good) / max`` of the rows' compressed sizes; 0 for empty rows."""
    good, bad = (
        zstandard.ZstdCompressor(
            level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False,
            dict_data=_loaded(d),
        )
        for d in dictionaries
    )
    offsets, data = byte_column(column)
    view, sizes = memoryview(data), np.zeros((len(offsets) - 1, 2))
    for row, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for start in range(at, end, BLOCK):
            block = view[start : min(start + BLOCK, end)]
            sizes[row, 0] += len(good.compress(block))
            sizes[row, 1] += len(bad.compress(block))
    return (sizes[:, 1] - sizes[:, 0]) / np.maximum(sizes.max(axis=1), 1)


def _loaded(content: bytes) -> zstandard.ZstdCompressionDict:
    found = zstandard.ZstdCompressionDict(content)
    found.precompute_compress(level=LEVEL)
    return found


def calibrate(values: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of most likelihood, by Newton steps on the scaled values; a small
    pull to zero keeps separable classes finite."""
    scale = float(values.std()) or 1.0
    x = np.stack([values / scale, np.ones(len(values))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (good - p)) - 0.01 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _sample(docs: DataFrame, labels: DataFrame, label: int) -> list[bytes]:
    """Texts of one class; ids are drawn from the labels alone, so no more than their rows travel."""
    ids = labels.where(F.col("quality") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        2 * SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text <> ''")
    # the bytes before each text, within the bounded sample, keep the rest of it on the executors
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    return [r["text"].encode() for r in rows.where(F.octet_length("text") <= SAMPLE_BYTES).withColumn(
        "before", before).where(F.col("before") <= 2 * SAMPLE_BYTES).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, quality being 0 or 1; other labels and
    nulls teach nothing. Without texts of both classes every text gets the share of label 1 (0.5 without any label)."""
    labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    good, bad = _sample(docs, labels, 1), _sample(docs, labels, 0)
    if len(good) < 2 or len(bad) < 2:
        return {"dictionaries": None, "slope": 0.0, "intercept": 0.0, "share": share}
    # every other text shapes a dictionary, the rest the curve
    pair = (dictionary(good[::2]), dictionary(bad[::2]))
    held = good[1::2], bad[1::2]
    values = np.concatenate([size_difference(pa.array([t.decode() for t in part], pa.string()), pair) for part in held])
    known = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    weight = np.where(known == 1, share / len(held[0]), (1 - share) / len(held[1])) * len(known)
    slope, intercept = calibrate(values, known, weight)
    return {"dictionaries": pair, "slope": slope, "intercept": intercept, "share": share}


def _score(model, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if m["dictionaries"]:
                value = m["slope"] * size_difference(batch.column(width), m["dictionaries"]) + m["intercept"]
                made = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
            else:
                made = np.full(batch.num_rows, m["share"])
            columns = [batch.column(i) for i in range(width)] + [pa.array(made)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(width + 1)])

    return score


def score(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs(text, ...)`` and ``score``, the probability of label 1, and ``predicted`` (1 from
    ``THRESHOLD`` on). Null text is empty; an empty text has the curve's value at no difference. ``columns`` that
    bear those names are replaced. One row per row, no exchange."""
    bound_batches(docs.sparkSession)
    kept = [c for c in columns if c not in ("score", "predicted")]
    rows = docs.select(*kept, F.col("text").alias("text to read"))
    schema = [f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(kept))] + [f"c{len(kept)} double"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_score(held, len(kept)), ", ".join(schema)).toDF(*kept, "score")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
