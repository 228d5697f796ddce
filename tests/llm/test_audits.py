"""Source audit, clustering and toxicity: SQL, brute force, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, fold
from tracewell.llm import centroids, source_audit as sa, toxicity
from tracewell.llm import queries as q
from tracewell.llm.transducer import Transducer, build
from tracewell.llm.words import Powers, word_pieces

BIGGER = "/root/testdata/sf0.01"


# ---- transducer

@pytest.mark.parametrize("alphabet, most, count", [(b"ab", 6, 200), (b"abcdefg", 9, 3000), (bytes(range(256)), 3, 800)])
def test_transducer(alphabet, most, count):
    rng = random.Random(count)
    terms = sorted({bytes(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(count)})
    fst = Transducer.from_bytes(build(terms).to_bytes())
    asked = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms]
    data = np.frombuffer(b"".join(asked), dtype=np.uint8)
    end = np.cumsum([len(t) for t in asked])
    place = {t: i for i, t in enumerate(terms)}
    assert fst.ordinals(data, end - [len(t) for t in asked], end).tolist() == [place.get(t, -1) for t in asked]
    assert [fst.term(i) for i in range(len(terms))] == terms


def test_transducer_is_minimal():
    """As many states as there are different sets of endings."""
    terms = sorted({a + b + c for a in (b"x", b"yy", b"z") for b in (b"in", b"out", b"") for c in (b"s", b"ing")})
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    futures = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for p in prefixes}
    assert len(build(terms).final) == len(futures)


# ---- source audit

def brute_audit(rows, least, top):
    words = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t, l, s in rows]
    out = set()
    for lang in {l for l, _, _ in words}:
        held = Counter(t for l, _, w in words if l == lang for t in set(w))
        kept = sorted((t for t, n in held.items() if n >= least), key=lambda t: t.encode())
        uses = defaultdict(Counter)
        for l, s, w in words:
            if l == lang:
                uses[s].update(t for t in w if t in set(kept))
        whole = sum(uses.values(), Counter())

        def share(counts):
            below = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // below for t in kept}

        p, q_ = {s: share(c) for s, c in uses.items()}, share(whole)
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q_[t]) for t in kept if uses[s][t] and p[s][t] > q_[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found[:most])}
    return out


def audited(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("small", [False, True])
def test_audit_by_brute_force(spark, monkeypatch, small):
    """Also with transducers, rounds, blocks and slices so small that there are many of each."""
    if small:
        for name, value in (("SHARD", 7), ("SENT_BYTES", 400), ("BLOCK_TERMS", 5), ("BLOCK_SOURCES", 2), ("SLICE_BYTES", 64)):
            monkeypatch.setattr(sa, name, value)
    rng = random.Random(3)
    words = ["Ant", "bee", "éa", "Éa", "cat", "\U0001f600x", "dog", "Zoo", "yak", "eel", "áb"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(150):
        text = " ".join(rng.choice(words) + rng.choice(["", ",", "\x00", "7"]) for _ in range(rng.randint(0, 12)))
        rows.append((text if rng.random() < 0.9 else None, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", "c", None])))
    rows += [(None, "xx", "only"), ("rare words", "yy", "s1"), ("", "yy", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(sa.source_audit(docs, 4, 6)) == brute_audit(rows, 4, 6)


def test_audit_of_odd_rows(odd_docs, no_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    for least in (1, 3):
        assert audited(sa.source_audit(odd_docs, least)) == brute_audit(rows, least, 50)
    assert sa.source_audit(no_docs).collect() == []


# ---- clustering

def brute_clusters(rows, count=16, rounds=3):
    kept = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else int(x) * 64 for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        by = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            by[j].append(v)
        centres = [[sum(x) // len(by[j]) for x in zip(*by[j])] if by[j] else c for j, c in enumerate(centres)]
    return Counter((i, j, d) for (i, _), (d, j) in zip(kept, assign())), centres


def clustered(vectors, **options):
    state, centres = centroids.cluster_vectors(vectors, **options)
    rows = state.collect()
    return Counter((r["vec_id"], r["cluster"], None if r["distance"] is None else int(r["distance"])) for r in rows), centres, rows


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(16, 64))
    rows = [(i, (middle[i % 16] + 0.1 * rng.normal(size=64)).tolist()) for i in range(600)]
    rows += [(1000 + i, [float(x) for x in rng.integers(-1, 2, 64)]) for i in range(60)] + [(2000 + i, [0.5] * 64) for i in range(30)]
    rows += [(3, [0.25] * 64), (3, [0.25] * 64), (None, [0.125] * 64)]
    bad = [(5000, None), (5001, [1.0] * 63), (5002, [float("nan")] + [0.0] * 63), (5003, [None] + [0.0] * 63),
           (5004, [float("-inf")] + [0.0] * 63), (5005, [])]
    vectors = spark.createDataFrame([r + (1, 2) for r in rows + bad], "vec_id long, embedding array<double>, cluster int, vec int")
    expected, centres = brute_clusters(rows)
    found, held, state = clustered(vectors)
    assert found == expected and held.tolist() == centres
    # most vectors keep their centroid by their bounds alone
    assert sum(r["scans"] for r in state) < 2.5 * len(state)


@pytest.mark.parametrize("size", [1e6, 1e30])
def test_clusters_of_large_components(spark, size):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(64)]) for i in range(40)]
    rows += [(50 + i, [1e307 if size > 1e20 else 0.0] * 64) for i in range(2)]
    expected, centres = brute_clusters(rows)
    found, held, _ = clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fits = Counter({(i, j, d if d < 10**38 else None): n for (i, j, d), n in expected.items()})
    assert found == fits and [[int(x) for x in c] for c in held] == centres


def test_clusters_of_few_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)] + [(7, [0.0] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, held, _ = clustered(vectors)
    assert found == brute_clusters(rows)[0] and len(held) == 6
    assert clustered(vectors.limit(0))[2] == []


def test_loosening_bounds_what_members_lose():
    rng = np.random.default_rng(6)
    saved = 0
    for _ in range(300):
        d = int(rng.integers(2, 6))
        old = rng.normal(size=(4, d)) * 3
        new = old + rng.normal(size=(4, d)) * rng.choice([0, 0.1, 2], size=(4, 1))
        radius = rng.uniform(0.01, 3, 4)
        drift, loss = centroids.loosening(old, new, radius)
        for i in range(4):
            x = rng.normal(size=(200, d))
            x = old[i] + x / np.linalg.norm(x, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (200, 1)) ** 0.2
            for j in set(range(4)) - {i}:
                lost = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert lost.max() <= loss[i] + 1e-9
            saved += loss[i] < 0.9 * max(drift[j] for j in range(4) if j != i)
    assert saved > 200


# ---- toxicity

def test_toxicity_of_held_out_documents(spark):
    labels = pq.read_table(f"{BIGGER}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels["toxic"]))
    rows = q.op13_toxicity(spark, BIGGER).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: fold(d, 5) == 0 for d in (r["doc_id"] for r in rows)}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    tested = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    bad, good = [s for t, s, _ in tested if t], [s for t, s, _ in tested if not t]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) >= 0.9 * len(bad) * len(good)
    assert sum(p for t, _, p in tested if not t) <= 0.05 * len(good)


def test_features_by_brute_force():
    texts = ["One two, two three-one two", "", None, "x", "Éa été ÉA", "a " * 3000 + "b c"]
    powers, letters = Powers(), toxicity.word_letters()
    for size in (1 << 20, 512):
        for words, _ in word_pieces(pa.array([t.lower() if t else t for t in texts], pa.string()), powers, 2, letters, size):
            assert words.rows >= 1
    row, place = toxicity.features(pa.array(texts, pa.string()), powers)
    for i, t in enumerate(texts):
        w = re.findall(r"[a-z\u0080-\U0010ffff]+", (t or "").lower())
        wanted = set(w) | {(a, b, 1) for a, b in zip(w, w[1:])} | {(a, b, 2) for a, b in zip(w, w[2:])}
        assert len(place[row == i]) == len(wanted)
    all_places = np.zeros(toxicity.WIDTH, dtype=bool)
    all_places[place[row == 0]] = True
    assert (toxicity.features(pa.array([texts[0]]), powers, all_places)[1] == place[row == 0]).all()


def test_pieces_of_long_rows_make_the_same_features(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(5000)) + " " + "y" * 20_000 + " z"
    column = pa.array(["short one", text, None, "last"], pa.string())
    whole = toxicity.features(column, Powers())
    pieces = toxicity.word_pieces
    monkeypatch.setattr(toxicity, "word_pieces", lambda *a: pieces(*a, size=700))
    parts = toxicity.features(column, Powers())
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_training_step_by_hand():
    """One coordinate's weight against the update written out in plain numbers."""
    rows, labels = [np.array([5]), np.array([5, 9]), np.array([9])], np.array([1.0, 0.0, 1.0])
    places, weights = toxicity.train(rows, labels, np.array([30.0, 20.0, 10.0]))
    z, n = defaultdict(float), defaultdict(float)
    w = lambda k: 0.0 if abs(z[k]) <= (0 if k == "b" else toxicity.L1) else -(
        z[k] - math.copysign(0 if k == "b" else toxicity.L1, z[k])) / (toxicity.BETA + math.sqrt(n[k]) + toxicity.L2)
    rng = np.random.default_rng(1)
    for _ in range(toxicity.EPOCHS):
        for i in rng.permutation(3):
            keys = [*rows[i].tolist(), "b"]
            held = {k: w(k) for k in keys}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(held.values())))))
            g = (30.0, 20.0, 10.0)[i] * (p - labels[i])
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) * held[k]
                n[k] += g * g
    expected = {(toxicity.WIDTH if k == "b" else k): w(k) for k in (5, 9, "b") if w(k)}
    assert dict(zip(places.tolist(), weights.tolist())) == pytest.approx(expected)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(6, 1), (7, 1), (9, 0), (10, 0), (5, 0), (3, None), (None, 1), (8, 7), (4, 1), (4, 0)], "doc_id long, toxic int")
    ones = labels.where("toxic = 1")
    for model in (toxicity.fit(odd_docs, labels), toxicity.fit(no_docs, labels), toxicity.fit(odd_docs, labels.limit(0)),
                  toxicity.fit(odd_docs, ones)):
        rows = toxicity.score(odd_docs, model, ["doc_id", "key"]).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert all(r["score"] > 0.99 for r in rows)
    assert toxicity.score(no_docs, model, ["doc_id"]).collect() == []
    assert zlib.crc32(b"1") % 5 == fold(1, 5)
    assert toxicity.fit(odd_docs.select("doc_id", F.lit(None).cast("string").alias("text")), labels)["places"].size == 0
