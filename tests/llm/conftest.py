import random
import zlib

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, word long, node long, row long"


@pytest.fixture(scope="session")
def documents():
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return [
        "".join(rng.choice(["th", "er", "on", "in", "ra", "lo", "mi", "ta", "ke", "su"]) for _ in range(rng.randint(1, 4)))
        for _ in range(4000)
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(9)
    long = " ".join(rng.choice(words) for _ in range(60_000))
    prose = " ".join(rng.choice(words) for _ in range(120))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "...!?\n\t", "en", "a", 5), (4, "x", "en", "a", 1),
        (5, long, "en", "b", len(long)), (6, prose, "en", None, 1), (7, prose, "fr", "b", 1), (8, prose, "fr", "b", 1),
        (8, prose, "fr", "b", 1), (None, prose, "fr", "b", 1), (None, None, None, None, None), (9, "one two three", "en", "a", 3),
        (10, "éÉ \U0001f600 naïve ſ password=\"hunter2hunter2\" \x00 z", "fr", "a", 9),
    ]
    return spark.createDataFrame([r + (1, 2, 3, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def brute_words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = brute_words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(texts, n, percent):
    """Smallest id reachable, for each id."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}
