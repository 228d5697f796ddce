"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs of words with one between them, each
hashed to one of ``WIDTH`` places. Training goes through the labelled texts one by one: every coordinate has its own
learning rate, from the gradients it has seen, and the L1 term leaves weights at zero that the labels do not back.
What is left is a short list of weights that goes to the tasks, whatever was learnt from.

Labels teach through a sample of at most ``SAMPLE`` texts of each class and ``SAMPLE_BYTES`` of each, in the order
of a hash of their ids; a class of which a smaller share was drawn counts for more. One task learns from their hashed
features; all else is per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.storage import bound_batches
from tracewell.llm.words import Powers, Words, binaries, mix, word_pieces

WIDTH = 1 << 20
SAMPLE = 8000
SAMPLE_BYTES = 32_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1e-3
EPOCHS = 8
THRESHOLD = 0.5
REACH = 2  # words between the first and the last of a feature, and one


def word_letters() -> np.ndarray:
    letters = np.zeros(256, dtype=bool)
    letters[97:123] = letters[128:] = True
    return letters


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every feature, repeats included."""
    row = np.repeat(np.arange(words.rows), words.lengths())
    rows, values = [row], [words.hash]
    for apart in range(1, REACH + 1):
        same = row[apart:] == row[:-apart]
        pair = words.hash[:-apart] * np.uint64(0x9E3779B97F4A7C15) + words.hash[apart:] + np.uint64(apart)
        rows.append(row[apart:][same])
        values.append(mix(pair[same]))
    return np.concatenate(rows), (np.concatenate(values) % np.uint64(WIDTH)).astype(np.int64)


def features(column: pa.Array, powers: Powers, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the rows' distinct features, of ``wanted`` places only where given."""
    letters, found = word_letters(), [np.zeros(0, dtype=np.int64)]
    for words, _ in word_pieces(pc.utf8_lower(column), powers, REACH, letters):
        row, place = hashed(words)
        if wanted is not None:
            keep = wanted[place]
            row, place = row[keep], place[keep]
        found.append(np.unique((row + words.row0) * WIDTH + place))
    both = np.unique(np.concatenate(found))
    return both // WIDTH, both % WIDTH


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        row, place = features(batch.column(1), powers)
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), binaries(place.astype(np.int32), first)], ["ord", "label", "places"])


def weights_of(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights other than zero; place ``WIDTH`` is the intercept, which no L1 term holds down."""
    z, n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    rows = [np.append(r, WIDTH) for r in rows]
    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            held, seen = z[at], n[at]
            limit = np.full(len(at), L1)
            limit[-1] = 0.0
            w = weights_of(held, seen, limit)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            slope = importance[i] * (p - labels[i])
            rate = (np.sqrt(seen + slope * slope) - np.sqrt(seen)) / ALPHA
            z[at] = held + slope - rate * w
            n[at] = seen + slope * slope
    limit = np.full(WIDTH + 1, L1)
    limit[-1] = 0.0
    w = weights_of(z, n, limit)
    places = np.flatnonzero(w)
    return places, w[places]


def _learn(shares: dict[int, float]):
    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending"), ("label", "ascending"), ("places", "ascending")])
        labels = table.column("label").to_numpy().astype(np.float64)
        rows = [np.frombuffer(b, dtype=np.int32) for b in table.column("places").to_pylist()]
        drawn = np.maximum([np.sum(labels == 0), np.sum(labels == 1)], 1)
        importance = np.array([shares[0], shares[1]]) * len(labels) / drawn
        places, weights = train(rows, labels, importance[labels.astype(np.int64)])
        return pa.table({"place": pa.array(places, pa.int64()), "weight": pa.array(weights)})

    return learn


def _sample(docs: DataFrame, labels: DataFrame, label: int) -> DataFrame:
    """``(ord, text, label)`` of one class; ids are drawn from the labels alone."""
    ids = labels.where(F.col("toxic") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").where("text <> ''").where(F.octet_length("text") <= SAMPLE_BYTES)
    drawn = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    # bytes up to each text, within the bounded sample
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sized = drawn.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES)
    return sized.select(F.xxhash64("doc_id").alias("ord"), "text", F.lit(label).alias("label"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, toxic being 0 or 1; other labels and nulls
    teach nothing. An id with both labels teaches both; of several texts of one id the first in order teaches. Without texts of both classes every text gets the share
    of label 1 (0 without any label)."""
    bound_batches(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    model = {"places": np.zeros(0, np.int64), "weights": np.zeros(0), "intercept": -30.0}
    share = counts.get(1, 0) / total if total else 0.0
    if 0 < share < 1:
        drawn = reduce(DataFrame.union, [_sample(docs, labels, c) for c in (0, 1)])
        rows = drawn.mapInArrow(_hash_rows, "ord long, label int, places binary").withColumn("all", F.lit(0))
        shares = {0: 1 - share, 1: share}
        learnt = rows.groupBy("all").applyInArrow(_learn(shares), "place long, weight double").toArrow()
        places, weights = learnt.column("place").to_numpy(), learnt.column("weight").to_numpy()
        if len(places):
            return {"places": places[places < WIDTH], "weights": weights[places < WIDTH],
                    "intercept": float(weights[places == WIDTH].sum())}
    if share:
        model["intercept"] = float(np.log(share) - np.log1p(-share)) if share < 1 else 30.0
    return model


def _score(model, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, powers = model.value, Powers()
        weight = np.zeros(WIDTH)
        weight[m["places"]] = m["weights"]
        wanted = weight != 0
        for batch in batches:
            row, place = features(batch.column(width), powers, wanted)
            total = m["intercept"] + np.bincount(row, weight[place], minlength=batch.num_rows)
            made = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            columns = [batch.column(i) for i in range(width)] + [pa.array(made)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(width + 1)])

    return score


def score(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs(text, ...)`` and ``score``, the probability of label 1, and ``predicted`` (1 from ``THRESHOLD``
    on). Null text is empty; a text without words has the intercept alone. Words are runs of letters a-z in lower case and
    of characters beyond ASCII; texts of any length are read whole, in pieces. ``columns`` that bear those names are
    replaced. One row per row, repeated ones included, no exchange."""
    bound_batches(docs.sparkSession)
    kept = [c for c in columns if c not in ("score", "predicted")]
    rows = docs.select(*kept, F.col("text").alias("text to read"))
    schema = [f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(kept))] + [f"c{len(kept)} double"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_score(held, len(kept)), ", ".join(schema)).toDF(*kept, "score")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
