"""Source divergence audit: how far the words of each source of a language differ from the other sources' and the language's.

The vocabulary of a language is the terms that enough of its documents hold. In sorted order it is built into minimal
acyclic transducers, of ``SHARD`` terms at most, on the executors; a term's ordinal is its place in that order.
Texts are then streamed through the transducers: what they accept is counted by source and ordinal, so terms travel as
numbers, ties go by ordinal, and only the terms that are reported become text again, by the transducer read backwards.

Transducers go to the tasks while they have ``SENT_BYTES`` together; a larger vocabulary takes the texts through it in
several rounds, each with its own terms. All arithmetic is in integers and decimals.

Distances between sources are sums over blocks of ordinals: a task has some sources' counts of ``BLOCK_TERMS`` terms as
a dense block and returns sums for pairs of sources, which is what is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch
from tracewell.llm.transducer import Transducer, build
from tracewell.llm.words import byte_column, lower_table

LEAST_DOCUMENTS = 30
TOP = 50
SHARD = 1 << 16
SENT_BYTES = 64 << 20
BLOCK_TERMS = 4096
BLOCK_SOURCES = 128
SLICE_BYTES = 1 << 22
UNIT, PRIOR = 1_000_000_000, 5


def term_bytes() -> np.ndarray:
    letters = np.zeros(256, dtype=bool)
    letters[65:91] = letters[97:123] = letters[128:] = True
    return letters


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row numbers and terms (A-Z as a-z), some ``SLICE_BYTES`` at a time; a long row is cut between terms."""
    offsets, data = byte_column(column)
    letters, lower, at = term_bytes(), lower_table(), 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and letters[data[end]] and letters[data[end - 1]] and offsets[np.searchsorted(offsets, end)] != end:
            ahead = np.flatnonzero(~letters[data[end : end + 4096]])
            end += int(ahead[0]) if len(ahead) else min(4096, len(data) - end)
        part = data[at:end]
        inside = letters[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        here = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        edge[here] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        start = np.flatnonzero(begins)
        kept_before = np.concatenate(([0], np.cumsum(inside)))
        bounds = np.append(kept_before[start], kept_before[-1])
        terms = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(lower[part[inside]])])
        yield np.searchsorted(offsets, start + at, side="right") - 1, terms
        at = end


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, term, documents)`` of the batches."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        lang = langs.indices.to_numpy()
        seen = []
        for row, terms in terms_of(batch.column(0)):
            coded = terms.dictionary_encode()
            width = max(len(coded.dictionary), 1)
            pair = np.unique(row * width + coded.indices.to_numpy())
            seen.append((pair // width, coded.dictionary.take(pa.array(pair % width))))
        if not seen:
            continue
        # a document that lies in two slices counts once
        coded = pa.concat_arrays([t for _, t in seen]).dictionary_encode()
        width = len(coded.dictionary)
        pair = np.unique(np.concatenate([r for r, _ in seen]) * width + coded.indices.to_numpy())
        held, counts = np.unique(lang[pair // width] * np.int64(width) + pair % width, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(held // width)), coded.dictionary.take(pa.array(held % width)).cast(pa.binary()),
             pa.array(counts)], ["lang", "term", "documents"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers of the sorted terms that a task gets."""
    lang, held = None, []

    def made():
        fst = build(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([held[0]], pa.binary()), pa.array([len(held)], pa.int64()),
             pa.array([fst.to_bytes()], pa.binary())], ["lang", "least", "terms", "fst"])

    for batch in batches:
        for name, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (name != lang or len(held) == SHARD):
                yield made()
                held = []
            lang = name
            held.append(term)
    if held:
        yield made()


def vocabulary(docs: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """``(lang, base, terms, fst)``: the transducers of each language, ``base`` being the ordinal of the first term."""
    counted = docs.select("text", "lang").mapInArrow(_document_counts, "lang string, term binary, documents long")
    kept = scratch.keep(counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(
        F.col("documents") >= least).select("lang", "term"), "terms")
    shards = scratch.keep(kept.orderBy("lang", "term").mapInArrow(_shards, "lang string, least binary, terms long, fst binary"), "shards")
    # one row for up to SHARD terms
    before = F.sum("terms").over(Window.partitionBy("lang").orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    places = shards.select("lang", "least", "terms", F.coalesce(before, F.lit(0)).alias("base"))
    return scratch.keep(places.join(shards.select("lang", "least", "fst"), ["lang", "least"]).drop("least"), "vocabulary")


def rounds(vocabulary: DataFrame) -> Iterator[dict[str, list[tuple[int, bytes]]]]:
    """The transducers with their bases by language, ``SENT_BYTES`` at a time."""
    held, size = {}, 0
    for r in vocabulary.orderBy("lang", "base").toLocalIterator():
        if held and size + len(r["fst"]) > SENT_BYTES:
            yield held
            held, size = {}, 0
        held.setdefault(r["lang"], []).append((r["base"], bytes(r["fst"])))
        size += len(r["fst"])
    if held:
        yield held


def _opened(sent) -> dict[str, list[tuple[int, Transducer]]]:
    return {lang: [(base, Transducer.from_bytes(b)) for base, b in shards] for lang, shards in sent.value.items()}


def _recount(sent):
    """Texts through the transducers: ``(lang, source, ordinal, uses)``. Each term of a batch goes through once."""

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _opened(sent)
        for batch in batches:
            # rows of a batch by language and source
            names = pa.table({"lang": batch.column(1), "source": batch.column(2)})
            groups = names.group_by(["lang", "source"]).aggregate([])
            langs, sources = groups.column("lang").to_pylist(), groups.column("source").to_pylist()
            place = {pair: i for i, pair in enumerate(zip(langs, sources))}
            group = np.array([place[p] for p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], dtype=np.int64)
            kept = sorted(set(langs) & set(held))
            lang_of = np.array([kept.index(x) if x in held else -1 for x in langs], dtype=np.int64)
            for row, terms in terms_of(batch.column(0)):
                coded = terms.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                width = max(len(words), 1)
                offsets, data = _bytes_of(words)
                ordinal = np.full((len(kept), width), -1, dtype=np.int64)
                for i, name in enumerate(kept):
                    here = np.unique(code[lang_of[group[row]] == i])
                    for base, fst in held[name]:
                        got = fst.ordinals(data, offsets[here], offsets[here + 1])
                        hit = got >= 0
                        ordinal[i, here[hit]] = got[hit] + base
                        here = here[~hit]
                pair, uses = np.unique(group[row] * width + code, return_counts=True)
                of, code = pair // width, pair % width
                known = lang_of[of] >= 0
                of, code, uses = of[known], code[known], uses[known]
                at = ordinal[lang_of[of], code] if len(kept) else code
                hit = at >= 0
                index = pa.array(of[hit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()).take(index), pa.array(sources, pa.string()).take(index),
                     pa.array(at[hit]), pa.array(uses[hit])], ["lang", "source", "ordinal", "uses"])

    return recount


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return offsets, np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)


def _spelled(sent, width: int):
    """The terms of ordinals; rows of other rounds' terms fall away."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _opened(sent)
        for batch in batches:
            keep, terms = [], []
            for i, (lang, ordinal) in enumerate(zip(batch.column(0).to_pylist(), batch.column(width).to_pylist())):
                for base, fst in held.get(lang, ()):
                    if base <= ordinal < base + fst.terms:
                        keep.append(i)
                        terms.append(fst.term(ordinal - base).decode("utf-8", "replace"))
            part = batch.take(pa.array(keep, pa.int64()))
            columns = [part.column(i) for i in range(width)] + [pa.array(terms, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], "item"])

    return spelled


def _share(uses: str, total: str, size: str) -> str:
    """``1 + floor(UNIT * (uses + PRIOR) / (total + PRIOR * size))``, exactly."""
    top = f"cast({UNIT} AS decimal(10,0)) * cast({uses} + {PRIOR} AS decimal(27,0))"
    return f"1 + ({top}) div cast({total} + {PRIOR} * {size} AS decimal(27,0))"


DISTANCES = "lang string, a string, b string, value long"


def _block_distances(keys, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Distances of the pairs of two blocks of sources over a block of terms, in both directions."""
    row, column, width = (int(groups.column(c)[0].as_py()) for c in ("i", "j", "width"))
    names, base = groups.column("source").to_pylist(), groups.column("none").to_numpy()
    block = groups.column("block").to_numpy()
    place = {s: n for n, s in enumerate(names)}
    dense = np.repeat(base[:, None], width, axis=1)
    if len(cells):
        at = np.array([place[s] for s in cells.column("source").to_pylist()], dtype=np.int64)
        dense[at, cells.column("ordinal").to_numpy() % BLOCK_TERMS] = cells.column("p").to_numpy()
    left, right = np.flatnonzero(block == row), np.flatnonzero(block == column)
    a, b, value = [], [], []
    for x in left.tolist():
        others = right[right > x] if row == column else right
        if len(others):
            sums = np.abs(dense[others] - dense[x]).sum(axis=1).tolist()
            for y, s in zip(others.tolist(), sums):
                a += [names[x], names[y]]
                b += [names[y], names[x]]
                value += [s, s]
    lang = pa.array([groups.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def pair_distances(cells: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``(lang, a, b, value)`` of each two sources of a language, from ``cells(lang, source, ordinal, p)`` of terms that occur
    and ``groups(lang, source, size, none)``, ``none`` being ``p`` of a term that does not."""
    by_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).alias("blocks"))
    blocked = groups.join(by_lang, "lang").withColumn("block", F.expr("pmod(xxhash64(source), blocks)"))
    # a block of sources meets every block, itself included
    meets = blocked.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "lang", "source", "size", "none", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    spans = F.explode(F.expr(f"sequence(0L, greatest(0L, (size - 1) div {BLOCK_TERMS}))"))
    sides = meets.withColumn("part", spans).withColumn(
        "width", F.expr(f"least({BLOCK_TERMS}L, greatest(1L, size - part * {BLOCK_TERMS}))")).withColumn(
        "none", F.expr("if(size = 0, 0L, none)"))
    keys = ["lang", "part", "i", "j"]
    sides = scratch.keep(sides.select(*keys, "source", "none", "block", "width"), "sides")
    dealt = cells.withColumn("part", F.expr(f"ordinal div {BLOCK_TERMS}")).join(
        meets.select("lang", "source", "i", "j"), ["lang", "source"])
    parts = dealt.select(*keys, "source", "ordinal", "p").groupBy(*keys).cogroup(
        sides.groupBy(*keys)).applyInArrow(_block_distances, DISTANCES)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(text, lang, source)``.

    Part ``pair``: every other source of the language and the distance to it, all ranks. Part ``term``: the terms a source
    uses more than its language does, to rank ``top``. A share ``p`` is ``1 + floor(10**9 * (uses + 5) / (total + 5 * V))`` over the
    ``V`` terms that ``least`` rows of the language hold; a distance is the sum of the shares' differences, 0 if V is 0.

    Null text, lang and source read as empty; every (lang, source) that occurs is a group, also one without terms. Every
    row counts as a document, also repeated ones and those without ids. Long texts are read whole, in pieces. Ties
    go by the UTF-8 bytes of the item. Other columns are not read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "source-audit")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    words = vocabulary(rows, least, scratch)
    counted = None
    sent_rounds = [spark.sparkContext.broadcast(held) for held in rounds(words)]
    for sent in sent_rounds:
        part = rows.mapInArrow(_recount(sent), "lang string, source string, ordinal long, uses long")
        counted = part if counted is None else counted.union(part)
    if counted is None:
        counted = spark.createDataFrame([], "lang string, source string, ordinal long, uses long")
    uses = scratch.keep(counted.groupBy("lang", "source", "ordinal").agg(F.sum("uses").alias("uses")), "uses")

    sizes = words.groupBy("lang").agg(F.sum("terms").alias("size"))
    totals = uses.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("size", zero).alias("size"))
    none = F.expr(f"if(size = 0, 0L, cast({_share('0', 'total', 'if(size = 0, 1, size)')} AS bigint))")
    groups = scratch.keep(groups.withColumn("none", none), "groups")

    p = F.expr(f"cast({_share('uses', 'total', 'size')} AS bigint)")
    cells = uses.join(groups.select("lang", "source", "total", "size"), ["lang", "source"]).withColumn("p", p)
    pairs = pair_distances(cells.select("lang", "source", "ordinal", "p"), groups.select("lang", "source", "size", "none"), scratch)
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn(
        "rank", F.row_number().over(by_item))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    of_lang = uses.groupBy("lang", "ordinal").agg(F.sum("uses").alias("all_uses")).join(whole, "lang")
    q = F.expr(f"cast({_share('all_uses', 'whole', 'size')} AS bigint)")
    # few sources use a term, or as many as a language has: one row each on the left
    above = cells.join(of_lang, ["lang", "ordinal"]).withColumn("value", F.col("p") - q).where("value > 0")
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    ranked = above.select("lang", "source", F.lit("term").alias("part"), "value", "ordinal").withColumn(
        "rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    ranked = ranked.select("lang", "source", "part", "value", "rank", "ordinal")
    named = [ranked.mapInArrow(_spelled(sent, 5), "lang string, source string, part string, value long, rank int, item string")
             for sent in sent_rounds]
    return reduce(DataFrame.unionByName, named, pairs.select("lang", "source", "part", "item", "value", "rank"))
