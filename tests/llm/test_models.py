"""Quality, language model, language ID, neighbours: held-out accuracy, exact parts by brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, brute_words, fold
from tracewell.llm import class_lm, quality
from tracewell.llm import queries as q
from tracewell.llm.class_lm import score_texts
from tracewell.llm.language_id import detect, fit, held_out, language_id
from tracewell.llm.neighbours import nearest_neighbours

BIGGER = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    table = pq.read_table(f"{BIGGER}/documents.parquet").to_pydict()
    truth = dict(zip(table["doc_id"], table["lang"]))
    rows = q.op9_language_id(spark, BIGGER).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: fold(d, 4) == 2 for d in truth}
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) >= 0.99 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_long_rows_have_the_same_n_grams(monkeypatch):
    import pyarrow as pa
    from tracewell.llm import language_id as li

    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abc é.\n ") for _ in range(n))
    column = pa.array([text(30), text(5000), None, "", "a" * 2000, text(1200), text(8)], pa.string())
    found = []
    for size in (1 << 19, 200):
        monkeypatch.setattr(li, "SLICE_BYTES", size)
        held = [Counter() for _ in range(7)]
        for row, code, first in li.grams(column):
            for i in range(len(first) - 1):
                held[row + i].update(code[first[i] : first[i + 1]].tolist())
        found.append(held)
    assert found[0] == found[1] and sum(found[0][1].values()) > 1000


def test_more_languages_than_a_mask_holds(spark):
    """Masks against sets of n-grams, and predictions of texts not learnt from, for 130 languages."""
    from tracewell.llm.language_id import HASHES, MASK_BITS, MIN_RATE, RELATIVE, grams, slots
    import pyarrow as pa

    rng = random.Random(6)
    names = [f"l{i:03d}" for i in range(130)]
    assert len(names) > 2 * MASK_BITS
    own = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for n in names}
    text = lambda n: " ".join(rng.choice(own[n]) for _ in range(40))
    rows = [(text(n), n) for n in names for _ in range(4)]
    filters = fit(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.languages == names and filters.masks.shape[0] == 3
    uses = {n: Counter() for n in names}
    for t, n in rows:
        for _, code, _ in grams(pa.array([t])):
            uses[n].update(code.tolist())
    rate = {n: {g: c / sum(u.values()) for g, c in u.items()} for n, u in uses.items()}
    top = Counter()
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    expected = np.zeros_like(filters.masks)
    for i, n in enumerate(names):
        kept = np.array([g for g, x in rate[n].items() if x >= MIN_RATE and x >= RELATIVE * top[g]], dtype=np.uint32)
        for where in slots(kept):
            expected[i // MASK_BITS][where] |= 1 << i % MASK_BITS
    assert HASHES == len(slots(kept)) and (filters.masks == expected).all()
    found = detect(spark.createDataFrame([(text(n), n) for n in names], "text string, lang string"), filters, ["lang"]).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 128


def test_languages_of_odd_rows(odd_docs, no_docs):
    rows = language_id(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(r["lang_pred"] in ("en", "fr") for r in rows if r["doc_id"] in (4, 5, 6, 7, 8, 9, 10))
    assert language_id(no_docs).collect() == []
    assert {r["lang_pred"] for r in detect(odd_docs, fit(no_docs), ["doc_id"]).collect()} == {"und"}


def test_quality_of_held_out_documents(spark, words):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 300)))
    rows = [(d, prose() if d % 4 else prose().replace(" ", rng.choice(["$$$ ", " | ", "!! "])), d % 4 > 0) for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = docs.where("NOT held_out").select("doc_id", F.col("good").cast("int").alias("quality"))
    found = quality.score(docs, quality.fit(docs.where("NOT held_out"), labels), ["doc_id", "good", "held_out"]).collect()
    tested = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r["good"] for r in tested) >= 0.95 * len(tested)


def test_quality_scores_by_hand(spark, documents):
    """Sizes of blocks compressed one by one, and a curve at whose parameters the likelihood has no slope."""
    import zstandard

    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    docs = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(zip(labels["doc_id"], labels["quality"])), "doc_id long, quality int")
    model = quality.fit(docs, table)
    sized = []
    for content in model["dictionaries"]:
        held = zstandard.ZstdCompressionDict(content)
        sized.append(zstandard.ZstdCompressor(
            level=quality.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(text):
        data = text.encode()
        blocks = [data[i : i + quality.BLOCK] for i in range(0, len(data), quality.BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in sized)
        return (bad - good) / max(good, bad, 1)

    for r in quality.score(docs, model, ["doc_id"]).collect():
        value = model["slope"] * difference(documents[r["doc_id"]]) + model["intercept"]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-value)), abs=1e-9)
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x + 1))).astype(float)
    weight = rng.uniform(0.5, 2, 300)
    slope, intercept = quality.calibrate(x, y, weight)
    scale = x.std()

    def likelihood(a, b):
        p = 1 / (1 + np.exp(-(a * x + b)))
        return (weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() - 0.005 * ((a * scale) ** 2 + b**2)

    best = likelihood(slope, intercept)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (7e-4, -7e-4)):
        assert likelihood(slope + da, intercept + db) < best


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(6, 1), (7, 1), (9, 0), (10, 0), (5, 0), (3, None), (None, 1), (8, 7), (4, 1)], "doc_id long, quality int")
    for model in (quality.fit(odd_docs, labels), quality.fit(no_docs, labels), quality.fit(odd_docs, labels.limit(0))):
        rows = quality.score(odd_docs, model, ["doc_id"]).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.score(no_docs, model, ["doc_id"]).collect() == []


@pytest.mark.parametrize("frequent", [1 << 18, 300])
def test_language_model_of_the_documents(spark, documents, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    tokens = {d: [*brute_words(t), None] for d, t in documents.items()}
    count = Counter(w for d, t in tokens.items() if fold(d, 5) != 1 for w in t)
    total, whole = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    rows = q.op5_class_lm(spark, SF).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            fold(r["doc_id"], 5) == 1, len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[w] + 0.5) - whole for w in t), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_language_model(texts, classes, n):
    """Score of a text by the classes of its words, written out."""
    uses, pairs, members = Counter(), Counter(), Counter()
    for t in texts:
        before = n
        for w in brute_words(t):
            uses[w] += 1
            members[classes[w]] += 1
            pairs[before, classes[w]] += 1
            before = classes[w]
        pairs[before, n] += 1
    tokens = sum(uses.values()) + len(texts)
    unknown = 0.5 / (tokens + 0.5 * (len(uses) + 2))
    into = [sum(pairs[c, d] for c in range(n + 1)) for d in range(n + 1)]
    anywhere = [(x + class_lm.SMOOTH) / (sum(into) + class_lm.SMOOTH * (n + 1)) for x in into]

    def follow(c, d):
        if d == n + 1:
            return unknown
        if c == n + 1:
            return (1 - unknown) * anywhere[d]
        here = (pairs[c, d] + class_lm.SMOOTH) / (sum(pairs[c, x] for x in range(n + 1)) + class_lm.SMOOTH * (n + 1))
        return (1 - unknown) * ((1 - class_lm.BACKED) * here + class_lm.BACKED * anywhere[d])

    def score(text):
        total, before = 0.0, n
        for w in brute_words(text):
            c = classes.get(w, n + 1)
            total += math.log10(follow(before, c)) + (math.log10(uses[w] / members[c]) if w in uses else 0)
            before = c
        return total + math.log10(follow(before, n))

    return score, follow, uses, members


@pytest.mark.parametrize("core, frequent", [(50, 120), (4096, 1 << 18), (7, 0)])
def test_language_model_by_brute_force(spark, documents, monkeypatch, core, frequent):
    """Scores, and that every word outside the core is in the class that its neighbours make likeliest."""
    monkeypatch.setattr(class_lm, "CORE", core)
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    monkeypatch.setattr(class_lm, "GROUP_TOKENS", 5000)
    some = {d: t for d, t in documents.items() if len(t) < 4000}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    from tracewell.llm.storage import Scratch
    from tracewell.llm.words import Powers, word_slices

    training = [t for d, t in some.items() if fold(d, 5) != 1]
    model, words = class_lm.learn_classes(docs.where(~held_out("doc_id", 5, 1)).select("text"), Scratch(spark, "test"))
    vocabulary = sorted({w for t in training for w in brute_words(t)})
    import pyarrow as pa

    hashes = next(word_slices(pa.array([w.decode() for w in vocabulary]), Powers(), size=1 << 40)).hash.view(np.int64).tolist()
    rows = {r["word"]: (r["uses"], r["class"]) for r in words.collect()}
    assert set(rows) == set(hashes)
    classes = {w: rows[h][1] for w, h in zip(vocabulary, hashes)}
    n = model["classes"]
    assert n == max(8, math.ceil(len(vocabulary) ** (1 / 3)))
    score, follow, uses, members = brute_language_model(training, classes, n)
    assert {w: rows[h][0] for w, h in zip(vocabulary, hashes)} == uses
    for r in score_texts(docs, held_out("doc_id", 5, 1)).collect():
        assert r["score"] == pytest.approx(score(some[r["doc_id"]]), rel=1e-9)
    # probabilities of all next words and an unknown one
    for c in range(n + 2):
        assert sum(follow(c, d) for d in range(n + 2)) == pytest.approx(1)


def test_words_outside_the_core_go_where_their_neighbours_say(spark, documents, monkeypatch):
    """The class of every rare word, one seen once included, against its likelihood in each class written out."""
    monkeypatch.setattr(class_lm, "CORE", 60)
    import pyarrow as pa
    from tracewell.llm.storage import Scratch
    from tracewell.llm.words import Powers, word_slices

    texts = [t for t in documents.values() if len(t) < 3000]
    model, held = class_lm.learn_classes(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark, "test"))
    tokens = [[w.decode() for w in brute_words(t)] for t in texts]
    uses = Counter(w for t in tokens for w in t)
    hashes = next(word_slices(pa.array(list(uses)), Powers(), size=1 << 40)).hash.view(np.int64).tolist()
    found = {r["word"]: r["class"] for r in held.collect()}
    classes = {w: found[h] for w, h in zip(uses, hashes)}
    n = model["classes"]
    ranges = Counter(math.floor(math.log2(u) * 16) for u in uses.values())
    least, total = 99, 0
    for step in sorted(ranges, reverse=True):
        total += ranges[step]
        if total > 60:
            break
        least = step
    core = {w for w, u in uses.items() if math.floor(math.log2(u) * 16) >= least}
    pairs, around = np.zeros((n + 2, n + 2)), {}
    for t in tokens:
        kinds = [n + 1, *(classes[w] if w in core else n for w in t), n + 1]
        for i, w in enumerate(t):
            around.setdefault(w, []).append((kinds[i], kinds[i + 2]))
        for a, b in zip(kinds, kinds[1:]):
            pairs[a, b] += 1
    follow = np.log(pairs + class_lm.SMOOTH) - np.log(pairs.sum(axis=1, keepdims=True) + class_lm.SMOOTH * (n + 2))
    emission = np.log(pairs.sum(axis=0) + 0.5)
    assert min(uses.values()) == 1 and len(core) < len(uses) / 5
    for w in set(uses) - core:
        gain = [sum(follow[a, c] + follow[c, b] - emission[c] for a, b in around[w]) for c in range(n)]
        assert gain[classes[w]] >= max(gain) - 1e-4 * abs(max(gain))


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([(i, 1 + i * i // 7) for i in range(500)], "word long, uses long")
    found = class_lm.most_frequent(counts, 100).to_pydict()
    least = min(found["uses"])
    assert 50 <= len(found["word"]) <= 100 and sorted(found["word"]) == [i for i in range(500) if 1 + i * i // 7 >= least]
    assert class_lm.most_frequent(counts, 0).num_rows == class_lm.most_frequent(counts.limit(0), 9).num_rows == 0


def test_language_model_of_odd_rows(odd_docs, no_docs):
    rows = score_texts(odd_docs, held_out("doc_id", 5, 1)).collect()
    assert len(rows) == odd_docs.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert len([r for r in rows if r["doc_id"] == 8]) == 2
    assert score_texts(no_docs, held_out("doc_id", 5, 1)).collect() == []
    unlearnt = score_texts(odd_docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in unlearnt)


def exact(rows, query, k):
    vector = rows[query]
    near = sorted((math.dist(vector, v), i) for i, v in rows.items() if i != query)
    return near[:k]


def test_neighbours_recall(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = dict(zip(table["vec_id"], table["embedding"]))
    found = {}
    for r in q.op10_nn_descent(spark, SF).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert set(found) == {i for i in rows if i % 100 == 0}
    hits = 0
    for query, ranks in found.items():
        assert sorted(ranks) == list(range(1, 11)) and [ranks[i] for i in range(1, 11)] == sorted(ranks.values())
        near = dict((i, d) for d, i in exact(rows, query, 10))
        hits += sum(i in near for _, i in ranks.values())
        assert all(d == pytest.approx(math.dist(rows[query], rows[i]), rel=1e-12) for d, i in ranks.values())
    assert hits >= 9 * len(found)


def test_neighbours_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)], 0) for i in range(1, 30)]
    rows += [(i, [0.5] * 4, 0) for i in range(100, 160)] + [(100, [0.5] * 4, 0)]
    bad = [(200, None, 0), (300, [0.0] * 4, 0), (400, [1.0, None, 1.0, 1.0], 0), (500, [float("nan")] * 4, 0),
           (600, [float("inf")] * 4, 0), (700, [1.0] * 3, 0), (None, [0.1] * 4, 0), (800, [], 0)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, node long")
    found = nearest_neighbours(vectors).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [
        (100, i, 100 + i, 0.0) for i in range(1, 11)]
    few = nearest_neighbours(vectors.where("vec_id IN (1, 2, 100)")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert nearest_neighbours(vectors.limit(0)).collect() == []
