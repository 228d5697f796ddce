"""N-gram Jaccard join and paragraph dedup against brute force."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, brute_components, brute_words, shingles
from tracewell.llm import jaccard_join, paragraph_dedup
from tracewell.llm.components import components
from tracewell.llm.jaccard_join import forest, jaccard_components, overlaps_linked
from tracewell.llm.paragraph_dedup import repeated_paragraphs
from tracewell.llm.storage import CLEANUP, Scratch


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def held(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()}


def test_jaccard_join_of_the_documents(spark, documents):
    found = held(jaccard_components(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {d: c for d, (_, c) in found.items()} == brute_components(documents, 4, 85)
    assert {d: n for d, (n, _) in found.items()} == {d: len(shingles(t, 4)) for d, t in documents.items()}


def test_jaccard_join_of_near_copies_in_blocks(spark, words, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(words) for _ in range(60)]
    texts = {}
    for d in range(70):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = rng.choice(words)
        texts[d] = " ".join(copy)
    texts |= {100 + d: " ".join(rng.choice(words) for _ in range(30)) for d in range(20)}
    for small, rows in ((2, 8), (1000, 8)):
        monkeypatch.setattr(jaccard_join, "SMALL_LIST", small)
        monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", rows)
        found = held(jaccard_components(table(spark, texts)))
        assert {d: c for d, (_, c) in found.items()} == brute_components(texts, 4, 85)


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_jaccard_join_of_unlike_sizes(spark, words, monkeypatch, percent):
    """One text cut off at every length, so that long columns hold sets of all sizes, many just at the bound."""
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 5)
    rng = random.Random(13)
    base = [rng.choice(words) for _ in range(120)]
    texts = {d: " ".join(base[: 5 + d]) for d in range(0, 116, 3)}
    texts |= {200 + d: " ".join([*base[:60], *(rng.choice(words) for _ in range(d))]) for d in range(0, 90, 6)}
    found = held(jaccard_components(table(spark, texts), 4, percent))
    assert {d: c for d, (_, c) in found.items()} == brute_components(texts, 4, percent)


def test_long_rows_have_the_same_shingles():
    import pyarrow as pa
    from tracewell.llm.words import Powers, shingle_slices

    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choice("ab\n") for _ in range(rng.randint(1, 9))) for _ in range(n))
    column = pa.array([text(3), text(4000), None, "", text(900), text(2), "x" * 5000, text(700)], pa.string())
    for n in (1, 4, 5):
        whole, parts = {}, {}
        for size, out in ((1 << 30, whole), (300, parts)):
            for s in shingle_slices(column, Powers(), n, size):
                for i in range(s.rows):
                    out[s.row0 + i] = s.values[s.first[i] : s.first[i + 1]].tolist()
        assert whole == parts and len(whole) == 8


def test_blocks_count_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMN_BLOCK", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    linked = overlaps_linked(sets, 30, 40)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            shared = len(np.intersect1d(a, b))
            assert linked[i, j] == (100 * shared >= 40 * (len(a) + len(b) - shared))
    assert len(forest(linked)) < 30


def test_jaccard_join_of_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in jaccard_components(odd_docs).collect()]
    assert len(rows) == odd_docs.count()
    assert {r for r in rows if r[0] in (1, 2, 3, 4)} == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4)}
    assert {r[2] for r in rows if r[0] in (6, 7, 8)} == {6} and rows.count((8, 117, 6)) == 2
    assert (None, 117, 6) in rows and (None, 0, None) in rows
    assert jaccard_components(no_docs).collect() == []


@pytest.mark.parametrize("where", ["middle", "end"])
def test_paragraphs_find_every_long_repeat(spark, words, where):
    rng = random.Random(11)
    texts = {}
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        texts[d] = text
    passage = [rng.choice(words) for _ in range(51)]
    for d in (3, 17, 40):
        at = len(texts[d]) if where == "end" else len(texts[d]) // 2
        texts[d][at:at] = passage
    found = repeated_paragraphs(table(spark, {d: " ".join(t) for d, t in texts.items()})).collect()
    assert {r["doc_id"] for r in found} == {3, 17, 40}
    assert {r["doc_id"] for r in found if not r["removed"]} == {3}
    assert all(r["first_doc_id"] == 3 for r in found)


def test_paragraphs_of_the_documents(spark, documents):
    found = repeated_paragraphs(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    seen = {}
    for d, t in documents.items():
        w = brute_words(t)
        for i in range(len(w) - 50):
            seen.setdefault(tuple(w[i : i + 51]), set()).add(d)
    assert set().union(*[v for v in seen.values() if len(v) > 1]) <= {r["doc_id"] for r in found}
    held = {d: t.encode().split() for d, t in documents.items()}
    part = lambda r: shingles(b" ".join(held[r["doc_id"]][r["start"] : r["start"] + r["words"]]).decode(), 5)
    groups = {}
    for r in found:
        groups.setdefault((r["first_doc_id"], r["first_start"], r["first_words"]), []).append(part(r))
    for r in found:
        if r["removed"]:  # some other paragraph of its component is similar
            mine, group = part(r), groups[r["first_doc_id"], r["first_start"], r["first_words"]]
            assert sum(100 * len(mine & n) >= 80 * len(mine | n) for n in group) > 1


@pytest.mark.parametrize("size", [50, 60, 70, 200])
def test_near_copies_of_whole_texts(spark, words, size):
    """One or more words substituted; all pairs of a similarity of 0.8 or more."""
    rng = random.Random(size)
    texts, near = {}, []
    for d in range(200):
        text = [rng.choice(words) for _ in range(size)]
        copy = list(text)
        for _ in range(max(1, size // 60)):
            copy[rng.randrange(size)] = rng.choice(words)
        a, b = shingles(" ".join(text), 5), shingles(" ".join(copy), 5)
        texts[d] = "\n".join(" ".join(text[i : i + 12]) for i in range(0, size, 12)) if d % 2 else " ".join(text)
        texts[1000 + d] = " ".join(copy)
        if 100 * len(a & b) >= 80 * len(a | b):
            near.append(d)
    found = repeated_paragraphs(table(spark, texts)).collect()
    whole = {r["doc_id"]: r["first_doc_id"] for r in found if r["words"] == size}
    assert len(near) > 150 and sum(whole.get(1000 + d) == d for d in near) >= 0.95 * len(near)
    assert all(r["first_doc_id"] % 1000 == r["doc_id"] % 1000 for r in found)


def test_paragraphs_of_a_text(words):
    """Lines, short texts as a whole and windows, by hand."""
    import pyarrow as pa
    from tracewell.llm.words import Powers, word_slices

    lines = [" ".join(words[i : i + n]) for i, n in ((0, 40), (40, 10), (50, 31), (81, 29))]
    texts = ["\n".join(lines), "\n\n".join(lines * 3), lines[0], "one two"]
    held = next(word_slices(pa.array(texts), Powers()))
    row, at, size = paragraph_dedup.natural(held)
    found = set(zip(row.tolist(), (at - held.first[row]).tolist(), size.tolist()))
    assert found == {(0, 0, 40), (0, 50, 31), (0, 0, 110), (2, 0, 40)} | {(1, 110 * k, 40) for k in range(3)} | {(1, 110 * k + 50, 31) for k in range(3)}
    row, at, size = paragraph_dedup.paragraphs(held)
    sets, first = paragraph_dedup.paragraph_sets(held, row, at, size)
    made = paragraph_dedup.records(held, np.arange(4))
    every = [t.split() for t in texts]
    for r, a, n, lo, hi in zip(row, at - held.first[row], size, first[:-1], first[1:]):
        assert len(set(sets[lo:hi].tolist())) == len(shingles(" ".join(every[r][a : a + n]), 5))
    assert {tuple(x) for x in made[["doc", "start", "size"]].tolist()} == set(zip(row.tolist(), (at - held.first[row]).tolist(), size.tolist()))
    assert len(made) == paragraph_dedup.BANDS * len(row)


@pytest.mark.parametrize("small, chunk", [(8, 512), (2, 16)])
def test_paragraphs_compare_all_sets_of_a_key(spark, words, monkeypatch, small, chunk):
    """Similar pairs among many paragraphs that share most of their words, so that keys hold many unlike sets."""
    monkeypatch.setattr(paragraph_dedup, "SMALL_KEY", small)
    monkeypatch.setattr(paragraph_dedup, "CHUNK_SETS", chunk)
    rng = random.Random(17)
    shared = [rng.choice(words) for _ in range(22)]
    texts = {d: [*shared, *(rng.choice(words) for _ in range(8))] for d in range(600)}
    for d in range(200):  # the second word from the end differs: 24 shingles of 28 are shared
        texts[1000 + d] = [*texts[200 + d][:-2], f"other{d}", texts[200 + d][-1]]
    found = repeated_paragraphs(table(spark, {d: " ".join(t) for d, t in texts.items()})).collect()
    first = {r["doc_id"]: r["first_doc_id"] for r in found}
    assert sum(first.get(1000 + d) == 200 + d for d in range(200)) >= 190
    assert all(first[d] == (d if d < 1000 else d - 800) for d in first)


@pytest.mark.parametrize("shape", ["random", "path", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1, None), (None, 2)]
    if shape == "path":
        order = rng.sample(range(1000), 150)
        edges = list(zip(order, order[1:]))
    rows = [] if shape == "none" else edges
    found = components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark, "test")).collect()
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in root}


def test_paragraphs_of_odd_rows(odd_docs, no_docs):
    found = repeated_paragraphs(odd_docs).collect()
    assert {r["doc_id"] for r in found} == {6, 7, 8}
    assert {r["first_doc_id"] for r in found} == {6}
    assert repeated_paragraphs(no_docs).collect() == []


def test_records_travel_in_planes(documents):
    """What a batch sends reads back as it was, and compresses better than records in a row."""
    import pyarrow as pa
    from tracewell.llm.words import Powers, word_slices

    texts = list(documents.values())
    made = [paragraph_dedup.records(w, np.arange(len(texts))[w.row0 :]) for w in word_slices(pa.array(texts), Powers())]
    records = paragraph_dedup.equal_sets(np.concatenate(made))[0]
    dealt = paragraph_dedup._dealt(records, np.zeros(len(records), dtype=np.int64), np.arange(2))
    assert (paragraph_dedup.from_planes(dealt[0], paragraph_dedup.RECORD) == records).all()
    assert len(paragraph_dedup.from_planes(dealt[1], paragraph_dedup.RECORD)) == 0
    size = lambda b: len(pa.compress(b, "lz4_raw", asbytes=True))
    assert size(dealt[0]) < 0.9 * size(records.tobytes())


def test_records_in_order_of_key_document_and_place():
    rng = np.random.default_rng(3)
    for n, keys in ((0, 1), (1, 1), (500, 3), (500, 400), (500, 1 << 40)):
        found = np.zeros(n, paragraph_dedup.RECORD)
        for name, top in (("key", keys), ("doc", 9), ("start", 5), ("size", 4), ("set", 1 << 30)):
            found[name] = rng.integers(0, top, n)
        place = paragraph_dedup.place_in_text(found)
        expected = np.lexsort((place, found["doc"], found["key"]))
        assert (paragraph_dedup.in_order(found, found["key"]) == expected).all()
        bucket = rng.integers(0, 1 << 18, n)  # more than 16 bits hold
        for records, b in zip(paragraph_dedup._dealt(found, bucket, np.unique(bucket)), np.unique(bucket)):
            assert (paragraph_dedup.from_planes(records, paragraph_dedup.RECORD) == found[bucket == b]).all()


def test_similar_sets_of_all_sizes():
    import pyarrow as pa

    rng = random.Random(8)
    pairs = [({*range(10)}, {*range(2, 12)}), ({*range(10)}, {*range(1, 11)}), ({*range(8)}, {*range(10)}), ({1}, {1}), ({1}, {2})]
    for _ in range(300):
        left = {rng.randrange(1 << 64) for _ in range(rng.randrange(1, 80))}
        pairs.append((left, {v for v in left if rng.random() < 0.9} | {rng.randrange(1 << 64) for _ in range(rng.randrange(9))} | {7}))
    binary = lambda sets: pa.array([np.array(sorted(s), np.uint64).tobytes() for s in sets], pa.binary())
    left, right = (binary(sets) for sets in zip(*pairs))
    expected = [100 * len(u & v) >= 80 * len(u | v) for u, v in pairs]
    assert paragraph_dedup.similar(left, right).tolist() == expected and len(set(expected)) == 2
    assert paragraph_dedup.similar(left[2:9], right[2:9]).tolist() == expected[2:9]


def shuffle_files(spark):
    """Shuffle files that lie in the session's local folders."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for folder in folders for p in Path(folder).glob("*/shuffle_*.data")}


def test_kept_tables_leave_no_shuffle_files(spark):
    scratch = Scratch(spark, "test")
    grouped = spark.range(20_000, numPartitions=3).groupBy(F.col("id") % 5_000).count()
    before = shuffle_files(spark)
    grouped.write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before  # they are where this looks for them
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    tables = [scratch.keep(grouped, f"table{k}") for k in range(3)]
    until = time.time() + 20  # they are removed in the background, without the driver's garbage collection
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert [t.count() for t in [*tables, grouped]] == [5_000] * 4
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        scratch.keep(spark.range(3).select((F.lit(1) / (F.col("id") * 0)).alias("x")), "broken")
    assert spark.conf.get(CLEANUP) == setting


@pytest.mark.parametrize("rows", [[(3, 2), (2, 1), (7, 8)], []])
def test_components_drop_what_only_edges_read(spark, rows):
    scratch = Scratch(spark, "test")
    kept = [scratch.keep(spark.createDataFrame(rows, "a long, b long"), name) for name in ("one", "two")]
    found = components(kept[0].union(kept[1]), scratch, kept).collect()
    assert {tuple(r) for r in found} == ({(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)} if rows else set())
    assert not any(Path(t._tracewell_path.removeprefix("file://")).exists() for t in kept)


def test_records_travel_text_by_text(documents):
    """What a batch sends a bucket stands in the order of the texts, so that ids and places compress."""
    import pyarrow as pa
    from tracewell.llm.words import Powers, mix, word_slices

    texts = list(documents.values())
    made = [paragraph_dedup.records(w, np.arange(len(texts))[w.row0 :]) for w in word_slices(pa.array(texts), Powers())]
    first, edges = paragraph_dedup.equal_sets(np.concatenate(made))
    assert len(edges) and len({tuple(r) for r in first[["key", "set"]].tolist()}) == len(first)
    bucket = (mix(first["key"]) % np.uint64(16)).astype(np.int64)
    for part in paragraph_dedup._dealt(first, bucket, np.arange(16)):
        part = paragraph_dedup.from_planes(part, paragraph_dedup.RECORD)
        place = [tuple(r) for r in part[["doc", "start", "size"]].tolist()]
        assert len(place) > 100 and place == sorted(place)
