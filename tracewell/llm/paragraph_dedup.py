"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are of two kinds. Some the text has itself: its lines, of ``WIDTH`` words at least, and, up to ``WHOLE`` words, the
whole of it; near copies are found by these. The others are windows of ``WIDTH`` words that begin where the text itself says: at words
whose three-word hash is the least of ``REACH`` in a row. Texts that share ``REACH + WIDTH + 2`` words (50) in a row so share a
window wherever the passage stands, inside lines or across them. A text shorter than a window is one.

Bands of ``ROWS`` of ``BANDS * ROWS`` MinHash values of a paragraph's five-word shingles are its keys: at a similarity of
0.8 some key agrees with probability ``1 - (1 - 0.8**ROWS)**BANDS``, over 0.95. Paragraphs of the same shingles are linked to the
first of them; of the others that share a key, each is compared with every other on the texts, and those of an
exact Jaccard similarity of 0.8 or more are linked. Pairs of keys of ``SMALL_KEY`` sets at most are compared one by one; the
sets of others are dealt into chunks of ``CHUNK_SETS``, every two chunks of a key meet in a block, and a block returns a
spanning forest of its links. Of each connected component the first paragraph stays.

Each batch links its own equal paragraphs and sends on the first only, so a passage that a third of all documents hold costs
a row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.jaccard_join import forest, overlaps_linked
from tracewell.llm.storage import Scratch
from tracewell.llm.words import Powers, Words, binaries, mix, row_sets, word_slices

WIDTH, REACH = 30, 18
WHOLE = 256  # words of the longest text that is compared as a whole
SHINGLE = 5
BANDS, ROWS = 6, 4
BAND_KEYS = 8  # a key's remainder by this is its band
SMALL_KEY = 8
CHUNK_SETS = 512
PERCENT = 80
BUCKETS_PER_PARTITION = 8
BAND_BYTES = 1 << 18  # of texts whose shingles are hashed at once, so that a core's cache holds them
PLACE = ("doc", "start", "size")  # of a paragraph; in edges (a, s, m) and (b, t, n)
RECORD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4"), ("set", "<u4")])
EDGE = np.dtype([("a", "<i8"), ("s", "<i4"), ("m", "<i4"), ("b", "<i8"), ("t", "<i4"), ("n", "<i4"), ("equal", "u1")])
ENDS = "a long, s int, m int, b long, t int, n int"


def beginnings(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of each paragraph."""
    counts = words.lengths()
    h = words.hash
    three = h * np.uint64(3) + np.append(h[1:], h[:1] * 0) * np.uint64(5) + np.append(h[2:], h[:2] * 0) * np.uint64(7)
    three = mix(three) | np.uint64(1)
    row = np.repeat(np.arange(words.rows), counts)
    late = words.first[1:][row] - np.arange(len(h)) < WIDTH  # too near the end for a paragraph
    three[late] = ~np.uint64(0)
    chosen = np.zeros(len(h), dtype=bool)
    if len(h) >= REACH:
        runs = np.lib.stride_tricks.sliding_window_view(three, REACH)
        least = np.arange(len(runs)) + runs.argmin(axis=1)
        first = np.arange(len(runs))
        whole = (row[first] == row[first + REACH - 1]) & (three[least] != ~np.uint64(0))
        chosen[least[whole]] = True
    # texts of a paragraph at least, but of no whole run, begin one at their first word; shorter texts are one
    few = (counts > 0) & (counts < REACH + WIDTH)
    chosen[words.first[:-1][few]] = True
    at = np.flatnonzero(chosen)
    return row[at], at


def natural(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of the paragraphs that texts have themselves: lines of ``WIDTH`` words at least, and
    whole texts of ``WIDTH`` to ``WHOLE`` words."""
    row = np.repeat(np.arange(words.rows), words.lengths())
    line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
    heads = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))[: len(row)])
    size = np.diff(np.append(heads, len(row)))
    counts = words.lengths()
    whole = np.flatnonzero((counts >= WIDTH) & (counts <= WHOLE))
    at = np.concatenate([heads[size >= WIDTH], words.first[whole]])
    size = np.concatenate([size[size >= WIDTH], counts[whole]])
    return row[at], at, size


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of all paragraphs, each once."""
    row, at = beginnings(words)
    size = np.minimum(words.first[1:][row] - at, WIDTH)
    more = natural(words)
    row, at, size = np.concatenate([row, more[0]]), np.concatenate([at, more[1]]), np.concatenate([size, more[2]])
    order = np.lexsort((size, at))
    row, at, size = row[order], at[order], size[order]
    fresh = np.append(True, (at[1:] != at[:-1]) | (size[1:] != size[:-1]))[: len(at)]
    return row[fresh], at[fresh], size[fresh]


def spans(words: Words, first: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the paragraphs' shingles begin and end among those of all rows, of which ``first`` are the rows' first."""
    begin = first[:-1][row] + at - words.first[:-1][row]
    return begin, begin + np.where(size >= SHINGLE, size - SHINGLE + 1, 1)


def paragraph_sets(words: Words, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all paragraphs, one after another, and each one's first."""
    values, first = words.shingles(SHINGLE)
    begin, end = spans(words, first, row, at, size)
    many = end - begin
    starts = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(many, out=starts[1:])
    return values[np.repeat(begin - starts[:-1], many) + np.arange(starts[-1])], starts


def min_hashes(values: np.ndarray, ranges: np.ndarray) -> list[np.ndarray]:
    """For each hash function the minima of the ranges (begin, end, begin, end, …), which may overlap. Works in place: this is
    most of the operator's work."""
    hashed, shifted = np.empty(len(values) + 1, dtype=np.uint64), np.empty(len(values) + 1, dtype=np.uint64)
    out = []
    for i in range(BANDS * ROWS):
        np.add(values, np.uint64(0x51ED2701 * (i + 1)), out=hashed[:-1])
        for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(hashed, np.uint64(bits), out=shifted)
            np.bitwise_xor(hashed, shifted, out=hashed)
            if factor != 1:
                np.multiply(hashed, np.uint64(factor), out=hashed)
        hashed[-1] = ~np.uint64(0)  # ranges may end behind the last
        out.append(np.minimum.reduceat(hashed, ranges)[::2])
    return out


def records(words: Words, ids: np.ndarray) -> np.ndarray:
    """All bands of a paragraph one after another, so that what stands together is of one text and compresses."""
    row, at, size = paragraphs(words)
    if not len(at):
        return np.zeros(0, RECORD)
    values, first = words.shingles(SHINGLE)
    begin, end = spans(words, first, row, at, size)
    # paragraphs overlap: every shingle is hashed once, and minima are taken of ranges
    ranges = np.stack([begin, end], axis=1).ravel()
    least = min_hashes(values, ranges)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values), out=total[1:])
    total = mix(total[end] - total[begin] + (end - begin).astype(np.uint64))
    out = np.zeros((len(at), BANDS), RECORD)
    for band in range(BANDS):
        part = out[:, band]
        key = np.full(len(at), band, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[i])
        key = key - key % np.uint64(BAND_KEYS) + np.uint64(band)
        part["key"], part["doc"], part["start"], part["size"] = key, ids[row], at - words.first[:-1][row], size
        part["set"] = (total >> np.uint64(32)).astype(np.uint32)
    return out.ravel()


def apart(doc: np.ndarray, start: np.ndarray, size: np.ndarray, doc2: np.ndarray, start2: np.ndarray, size2: np.ndarray) -> np.ndarray:
    """Paragraphs of one text that overlap do not repeat each other."""
    return (doc != doc2) | (start + size <= start2) | (start2 + size2 <= start)


def _edges(first: np.ndarray, other: np.ndarray, equal: bool) -> np.ndarray:
    keep = apart(*(first[c] for c in PLACE), *(other[c] for c in PLACE))
    edges = np.zeros(int(keep.sum()), EDGE)
    for names, source in ((("a", "s", "m"), first), (("b", "t", "n"), other)):
        for name, column in zip(names, PLACE):
            edges[name] = source[column][keep]
    edges["equal"] = equal
    return edges


def place_in_text(found: np.ndarray) -> np.ndarray:
    return (found["start"].astype(np.int64) << 32) | found["size"]


def in_order(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The order of records by ``by``, doc and place. Most values of ``by`` occur once: only the others are sorted by all three.
    (Records are moved by ``take``, which is several times as fast as an index in brackets.)"""
    order = np.argsort(by)
    same = by[order][1:] == by[order][:-1]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same)[: len(order)])
    tied = np.sort(order[at])
    rows = found.take(tied)
    order[at] = tied[np.lexsort((place_in_text(rows), rows["doc"], by[tied]))]
    return order


def equal_sets(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record of each key and set, in the order they have, and edges from it to those it equals. Equal sets agree in
    every band, so the first band's keys are enough for the edges."""
    together = mix(found["key"]) ^ found["set"].astype(np.uint64)  # equal for equal key and set
    order = in_order(found, together)
    key, made = found["key"].take(order), found["set"].take(order)
    fresh = np.append(True, (key[1:] != key[:-1]) | (made[1:] != made[:-1]))[: len(found)]
    firsts = np.flatnonzero(fresh)
    first = np.repeat(firsts, np.diff(np.append(firsts, len(found))))
    other = np.flatnonzero(~fresh & (key % BAND_KEYS == 0))
    return found.take(np.sort(order[firsts])), _edges(found.take(order[first[other]]), found.take(order[other]), True)


def unequal_sets(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges between all sets of each key of ``SMALL_KEY`` sets at most; and the records of larger keys, each one's
    place in its key and its key's number of sets."""
    found = firsts.take(in_order(firsts, firsts["key"]))
    heads = np.flatnonzero(np.append(True, found["key"][1:] != found["key"][:-1])[: len(found)])
    many = np.diff(np.append(heads, len(found)))
    size, place = np.repeat(many, many), np.arange(len(found)) - np.repeat(heads, many)
    few = np.flatnonzero(size <= SMALL_KEY)
    pairs = [_edges(found[:0], found[:0], False)]
    for apart in range(1, int(size[few].max(initial=1))):
        first = few[place[few] + apart < size[few]]
        pairs.append(_edges(found.take(first), found.take(first + apart), False))
    large = np.flatnonzero(size > SMALL_KEY)
    return np.concatenate(pairs), found.take(large), place[large], size[large]


def in_planes(values: np.ndarray) -> bytes:
    """Records as the first bytes of all, then the second ones, and so on: bytes that hardly vary stand together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _dealt(values: np.ndarray, bucket: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    small = int(bucket.max(initial=0)) < 1 << 16  # sorted in two passes then
    order = np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")
    bucket, values = bucket[order], values.take(order)
    return [in_planes(values[a:b]) for a, b in zip(np.searchsorted(bucket, wanted), np.searchsorted(bucket, wanted, side="right"))]


def _band(buckets: int):
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [
                records(words, ids[words.row0 : words.row0 + words.rows])
                for words in word_slices(batch.column(1), powers, size=BAND_BYTES)
            ]
            if not found:
                continue
            first, edges = equal_sets(np.concatenate(found))
            n = np.uint64(buckets)
            spread = (mix(edges["b"].astype(np.uint64) + edges["t"].astype(np.uint64)) % n).astype(np.int64)
            place = (first["key"] % n).astype(np.int64)
            wanted = np.union1d(place, spread)  # buckets without any of either have no row
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(wanted.astype(np.int32)),
                    pa.array(_dealt(first, place, wanted), pa.binary()),
                    pa.array(_dealt(edges, spread, wanted), pa.binary()),
                ],
                ["bucket", "records", "edges"],
            )

    return band


def _meet(table: pa.Table) -> pa.Table:
    """Edges, and members of large keys: a row of ``key``, ``chunk`` and its key's ``chunks`` without a second end."""
    held = [from_planes(r, RECORD) for r in table.column("records").to_pylist()]
    edges = [from_planes(e, EDGE) for e in table.column("edges").to_pylist()]
    firsts, equal = equal_sets(np.concatenate(held))
    unsure, large, place, size = unequal_sets(firsts)
    edges = np.unique(np.concatenate([*edges, equal, unsure]))
    nothing, rows = np.zeros(len(large), dtype=np.int64), np.arange(len(edges) + len(large))
    is_edge, is_member = pa.array(rows >= len(edges)), pa.array(rows < len(edges))  # masks: true is null

    def column(of_edges: np.ndarray, of_large: np.ndarray, kind: pa.DataType, mask: pa.Array) -> pa.Array:
        values = np.concatenate([of_edges.astype(np.int64), of_large.astype(np.int64)])
        return pa.array(values, mask=mask.to_numpy(zero_copy_only=False)).cast(kind)

    none = np.zeros(len(edges), dtype=np.int64)
    all_there = pa.array(np.zeros(len(rows), dtype=bool))
    return pa.table({
        "a": column(edges["a"], large["doc"], pa.int64(), all_there), "s": column(edges["s"], large["start"], pa.int32(), all_there),
        "m": column(edges["m"], large["size"], pa.int32(), all_there),
        "b": column(edges["b"], nothing, pa.int64(), is_edge), "t": column(edges["t"], nothing, pa.int32(), is_edge),
        "n": column(edges["n"], nothing, pa.int32(), is_edge),
        "equal": column(edges["equal"], nothing, pa.bool_(), is_edge),
        "key": column(none, large["key"].view(np.int64), pa.int64(), is_member),
        "chunk": column(none, place // CHUNK_SETS, pa.int64(), is_member),
        "chunks": column(none, -(-size // CHUNK_SETS), pa.int64(), is_member),
    })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        ids, starts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        for words in word_slices(batch.column(1), powers):
            asked = starts[words.row0 : words.row0 + words.rows]
            row = np.repeat(np.arange(words.rows), [len(x) for x in asked])
            place = np.array([(x["start"], x["size"]) for part in asked for x in part], dtype=np.int64).reshape(-1, 2)
            there = place.sum(axis=1) <= words.lengths()[row]  # rows that share a doc_id may differ
            row, start, size = row[there], place[there, 0], place[there, 1]
            sets, first = row_sets(*paragraph_sets(words, row, words.first[:-1][row] + start, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[words.row0 + row]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), binaries(sets, first)],
                ["doc", "start", "size", "shingles"])


def similar(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Which pairs of sets (binaries of distinct values) have a Jaccard similarity of ``PERCENT``. Pairs of as many values in sum
    are sorted together; what stands twice in a pair is shared."""
    both = pc.binary_join_element_wise(left.cast(pa.large_binary()), right.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(both.buffers()[1], np.int64)[both.offset : both.offset + len(both) + 1] // 8
    values = np.frombuffer(both.buffers()[2] or b"", np.uint64)
    total = np.diff(offsets)
    shared = np.zeros(len(total), dtype=np.int64)
    for n in np.unique(total):
        rows = np.flatnonzero(total == n)
        sets = np.sort(values[offsets[rows][:, None] + np.arange(n)], axis=1)
        shared[rows] = (sets[:, 1:] == sets[:, :-1]).sum(axis=1)
    return 100 * shared >= PERCENT * (total - shared)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array(similar(batch.column(6), batch.column(7)))
        yield pa.RecordBatch.from_arrays(batch.columns[:6], list("asmbtn")).filter(keep)


def block_links(place: list[np.ndarray], sets: list[np.ndarray], left: int) -> np.ndarray:
    """A spanning forest of the links between the first ``left`` paragraphs of a block and all of it."""
    linked = overlaps_linked(sets, left, PERCENT)
    linked &= apart(*(p[:left, None] for p in place), *place)
    return np.array(forest(linked), dtype=np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks, whose rows come one after another, side 0 first."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if held is None or not held.num_rows:
            continue
        block = np.stack([held.column(name).to_numpy() for name in ("key", "i", "j")])
        heads = np.append(0, np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1)
        ends = np.append(heads[1:], held.num_rows)
        if batch is not None:  # the last block may go on
            heads, ends = heads[:-1], ends[:-1]
        *place, side = (held.column(name).to_numpy() for name in (*PLACE, "side"))
        shingles, ats = held.column("shingles"), []
        for lo, hi in zip(heads, ends):
            left = int(np.count_nonzero(side[lo:hi] == 0))
            sets = [np.frombuffer(x, np.uint64) for x in shingles.slice(lo, hi - lo).to_pylist()]
            ats.append(lo + block_links([p[lo:hi] for p in place], sets, left) if left else np.zeros((0, 2), dtype=np.int64))
        held = held.slice(ends[-1] if len(ends) else 0)
        at = np.concatenate(ats) if ats else np.zeros((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(p[at[:, k]]) for k in (0, 1) for p in place], list("asmbtn"))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, words, first_doc_id, first_start, first_words, removed)``: every paragraph that some other one repeats, ``start``
    and length in words, and the first paragraph (smallest doc_id, then start, then length) of its component; all but the
    first are removed.

    Null and empty texts have no paragraphs; texts of fewer than five words are one shingle. Rows without a
    ``doc_id`` take no part; rows that share one are one document. Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "paragraphs")
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    buckets = BUCKETS_PER_PARTITION * max(8, docs.rdd.getNumPartitions())
    packed = docs.mapInArrow(_band(buckets), "bucket int, records binary, edges binary")
    met = scratch.keep(packed.groupBy("bucket").applyInArrow(
        _meet, f"{ENDS.split(', b')[0]}, b long, t int, n int, equal boolean, key long, chunk long, chunks long"), "met")
    edges = met.where("key IS NULL")
    members = met.where("key IS NOT NULL").select(
        F.col("a").alias("doc"), F.col("s").alias("start"), F.col("m").alias("size"), "key", "chunk", "chunks")

    both = list("asmbtn")
    unsure = edges.where("NOT equal").select(both).distinct().join(edges.where("equal").select(both), both, "left_anti")
    unsure = scratch.keep(unsure, "unsure")
    end = lambda names: F.struct(*[F.col(c).alias(p) for c, p in zip(names, PLACE)])
    ends = unsure.select(F.inline(F.array(end("asm"), end("btn"))))
    asked = ends.union(members.select(*PLACE)).groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("places"))
    sets = docs.hint("merge").join(asked, docs["doc_id"] == asked["doc"]).select("doc_id", "text", "places").mapInArrow(
        _sets, "doc long, start int, size int, shingles binary")
    sets = scratch.keep(sets.dropDuplicates([*PLACE]), "sets")
    of = lambda names, made: sets.select(*[F.col(p).alias(c) for p, c in zip(PLACE, names)], F.col("shingles").alias(made))
    verified = unsure.join(of("asm", "left"), list("asm")).join(of("btn", "right"), list("btn")).select(
        *both, "left", "right").mapInArrow(_similar, ENDS)
    tiles = members.select(*PLACE, "key", "chunk", "chunks", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("other"))
    tiles = tiles.select(
        *PLACE, "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    blocks = tiles.join(sets, [*PLACE]).select("key", "i", "j", "side", *PLACE, "shingles").repartition(
        "key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(_blocks, ENDS)
    links = edges.where("equal").select(both).union(verified).union(blocks).select(end("asm").alias("a"), end("btn").alias("b"))
    found = components(links, scratch, (met, unsure, sets))
    return found.select(
        F.col("node.doc").alias("doc_id"), F.col("node.start").alias("start"), F.col("node.size").alias("words"),
        F.col("component.doc").alias("first_doc_id"), F.col("component.start").alias("first_start"),
        F.col("component.size").alias("first_words"), (F.col("node") != F.col("component")).alias("removed"))
