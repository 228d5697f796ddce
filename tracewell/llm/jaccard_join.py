"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, exactly.

The document-by-shingle incidence matrix times its transpose holds every overlap count. It is never
made whole: the size-derived bound (two sets link only if they share one of each set's
``n - ceil(t n) + 1`` first shingles, in any one order of all shingles) leaves few rows in few columns,
and the product runs in blocks over those.

* Order: shingles of one document come first, those of many documents last, so that what documents share opens
  a block only where little else is in them. This is counted over all documents, in a bitmap and a list of
  bounded size. It only orders: any order gives the same links.
* Columns with up to ``SMALL_LIST`` documents give their pairs, each verified on the whole sets.
* Longer columns are dealt into chunks of sets of like size, of bounded rows and bytes. Sizes fall into classes by their
  logarithm, so that sets that link are in one class or in neighbouring ones: only chunks of those meet, each pair in one block, whose
  overlap counts are accumulated over blocks of shingle columns, pairs being discarded as soon as what is
  left cannot reach the bound. A block returns a spanning forest of the links it found: no link between
  different components is lost, and a group of thousands of near copies does not become millions of rows.

Documents with equal sets are one node; a group of copies of any size is aggregated before its exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.storage import Scratch
from tracewell.llm.words import Powers, binaries, mix, row_sets, shingle_slices

SMALL_LIST = 32
CHUNK_ROWS = 1024
CHUNK_SHINGLES = 1_000_000
COLUMN_BLOCK = 2048
COMMON = 64  # documents that make a shingle common
COMMON_MOST = 1_000_000  # entries of the list of common shingles that is sent to tasks (8 MB)
KEY_BITS = 40  # of a shingle's hash, for the order
LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 10, 20  # of a key, which name its bucket; more for more input
BITMAP_BITS = 27  # of the bitmap of keys held by several documents (16 MB)
LEVELS = tuple(2**i for i in range(1, 11))


def bucket_bits(docs: DataFrame) -> int:
    """Buckets grow with the input's partitions, so that one holds a fraction of a partition's keys."""
    return min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, (8 * docs.rdd.getNumPartitions()).bit_length()))


def _count_shingles(n: int, bits: int):
    """Per bucket of the key space that has any, the keys of a batch's shingles (a document's once), sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = []
            for part in shingle_slices(batch.column(0), powers, n):
                sets, _ = row_sets(part.values, part.first)
                keys.append((sets >> np.uint64(64 - KEY_BITS)))
            if not keys:
                continue
            keys = np.sort(np.concatenate(keys))
            bucket = keys >> np.uint64(KEY_BITS - bits)
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            low = (keys & np.uint64((1 << (KEY_BITS - bits)) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[begin].astype(np.int32)), binaries(low, np.append(begin, len(low)))],
                ["bucket", "keys"],
            )

    return count


def _count_bucket(bits: int):
    def count_bucket(table: pa.Table) -> pa.Table:
        """Of one bucket: bitmaps of the keys that at least 2, 4, ... documents hold, how full each is, and the
        keys of ``COMMON`` documents or more."""
        parts = [np.frombuffer(k, dtype=np.uint32) for k in table.column("keys").to_pylist()]
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        bucket = int(table.column("bucket")[0].as_py())
        slot = (keys >> np.uint32(KEY_BITS - BITMAP_BITS)).astype(np.int64)
        maps = []
        for level in LEVELS:
            held = np.zeros(1 << (BITMAP_BITS - bits), dtype=bool)
            held[slot[counts >= level]] = True
            maps.append(held)
        often = counts >= COMMON
        common = [
            {"key": int(k) + (bucket << (KEY_BITS - bits)), "documents": int(d)} for k, d in zip(keys[often], counts[often])
        ]
        columns = {"bucket": pa.array([bucket], pa.int32()), "common": pa.array([common], pa.list_(pa.struct(
            [("key", pa.int64()), ("documents", pa.int64())])))}
        columns |= {f"full{x}": pa.array([int(m.sum())]) for x, m in zip(LEVELS, maps)}
        columns |= {f"map{x}": pa.array([np.packbits(m, bitorder="little").tobytes()]) for x, m in zip(LEVELS, maps)}
        return pa.table(columns)

    return count_bucket


def shingle_order(docs: DataFrame, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """What orders shingles, of bounded size: a bitmap of the keys held by several documents (by as many as
    leave it at most a quarter full), and the keys of ``COMMON`` documents or more (of more where that list
    would pass ``COMMON_MOST`` entries)."""
    bits = bucket_bits(docs)
    packed = docs.select("text").mapInArrow(_count_shingles(n, bits), "bucket int, keys binary")
    schema = "bucket int, common array<struct<key:bigint,documents:bigint>>, " + ", ".join(
        [f"full{x} long" for x in LEVELS] + [f"map{x} binary" for x in LEVELS])
    counts = scratch.keep(packed.groupBy("bucket").applyInArrow(_count_bucket(bits), schema), "counts")
    full = counts.agg(*[F.sum(f"full{x}").alias(f"full{x}") for x in LEVELS]).first()
    level = next((x for x in LEVELS if (full[f"full{x}"] or 0) <= 1 << (BITMAP_BITS - 2)), LEVELS[-1])
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    width = 1 << (BITMAP_BITS - 3 - bits)
    for row in counts.select("bucket", F.col(f"map{level}").alias("bits")).toLocalIterator():
        bitmap[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["bits"], dtype=np.uint8)
    common, least = counts.select(F.inline("common")), COMMON
    while common.where(F.col("documents") >= least).count() > COMMON_MOST:
        least *= 2
    rows = common.where(F.col("documents") >= least).select("key").toArrow()
    scratch.drop(counts)
    return bitmap, np.sort(rows.column("key").to_numpy().astype(np.uint64))


def _describe(n: int, percent: int, order):
    """Per document: set size, the set's fingerprint and its first shingles in the common order."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (bitmap, often) = Powers(), order.value
        for batch in batches:
            ids = batch.column(0)
            for words in shingle_slices(batch.column(1), powers, n):
                sets, first = row_sets(words.values, words.first)
                size = np.diff(first)
                row = np.repeat(np.arange(words.rows), size)
                prints = [fingerprint(sets, first, salt) for salt in (1, 2)]
                key = sets >> np.uint64(64 - KEY_BITS)
                at = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
                late = often[at] == key if len(often) else np.zeros(len(key), dtype=bool)
                bit = (key >> np.uint64(KEY_BITS - BITMAP_BITS)).astype(np.int64)
                late = late.astype(np.int8) * 2 + ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                places = np.lexsort((sets, late, row))
                rank = np.arange(len(sets)) - first[:-1][row]
                wanted = size + (-percent * size // 100) + 1
                head = rank < wanted[row]
                heads = np.zeros(words.rows + 1, dtype=np.int64)
                np.cumsum(np.bincount(row[head], minlength=words.rows), out=heads[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(words.row0, words.rows),
                        pa.array(size.astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        binaries(sets[places][head], heads),
                    ],
                    ["doc_id", "n", "f1", "f2", "head"],
                )

    return describe


def fingerprint(sets: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(sets) + 1, dtype=np.uint64)
    np.cumsum(mix(sets + np.uint64(salt)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [np.frombuffer(h, dtype=np.int64) for h in batch.column(3).to_pylist()]
        counts = [len(h) for h in heads]
        if not sum(counts):
            continue
        fixed = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts)) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), *fixed], ["shingle", "node", "f1", "n"])


def _sets(n: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for words in shingle_slices(batch.column(1), powers, n):
                sets, first = row_sets(words.values, words.first)
                part = [batch.column(i).slice(words.row0, words.rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part[0], part[1], pa.array(fingerprint(sets, first, 1).view(np.int64)), binaries(sets, first)],
                    ["node", "wanted", "f1", "shingles"],
                )

    return sets_of


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(left), dtype=bool)
            for i, (x, y) in enumerate(zip(left, right)):
                u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate((u, v))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return verify


def overlaps_linked(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """Which of the first ``left`` sets link with which of all (a matrix). Overlaps are accumulated over
    blocks of columns; a pair is out once even sharing all that is left of the smaller set falls short."""
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    kept = shared[column]
    row, column = row[kept], (np.cumsum(shared) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    need = np.ceil(percent * (sizes[:left, None] + sizes[None, :]) / (100 + percent) - 1e-3)
    done = np.zeros((left, len(sets)), dtype=np.float32)
    open_rows = np.bincount(row, minlength=len(sets)).astype(np.float32)
    for start in range(0, int(shared.sum()), COLUMN_BLOCK):
        lo, hi = np.searchsorted(column, (start, start + COLUMN_BLOCK))
        block = np.zeros((len(sets), min(COLUMN_BLOCK, int(shared.sum()) - start)), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - start] = 1
        alive = np.flatnonzero((done + np.minimum(open_rows[:left, None], open_rows[None, :]) >= need).any(axis=1))
        if not len(alive):
            break
        done[alive] += block[alive] @ block.T
        open_rows -= np.bincount(row[lo:hi], minlength=len(sets))
    total = sizes[:left, None] + sizes[None, :] - done
    return 100.0 * done.astype(np.float64) >= percent * total.astype(np.float64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows and columns of a matrix (row i is also column i)."""
    n = linked.shape[1]
    seen = np.zeros(n, dtype=bool)
    links, left = [], linked.shape[0]
    for root in range(left):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            at = stack.pop()
            near = linked[at] if at < left else linked[:, at]
            fresh = np.flatnonzero(near & ~seen[: len(near)])
            seen[fresh] = True
            links += [(at, int(x)) for x in fresh]
            stack += fresh.tolist()
    return links


def _block(percent: int):
    def block(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        order = np.argsort(side, kind="stable")
        nodes = np.array(table.column("node").to_pylist(), dtype=np.int64)[order]
        held = table.column("shingles").to_pylist()
        sets = [np.frombuffer(held[i], dtype=np.uint64) for i in order]
        left = int(np.count_nonzero(side == 0))
        links = forest(overlaps_linked(sets, left, percent)) if left else []
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})

    return block


def describe_sets(docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, n, f1, f2, head)`` of every document, written in the shared folder."""
    docs = docs.select("doc_id", "text")
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, n, scratch))
    return scratch.keep(
        docs.mapInArrow(_describe(n, percent, order), "doc_id long, n long, f1 long, f2 long, head binary"), "described")


TILE = ["shingle", "size", "apart", "i", "j"]


def size_tiles(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``(shingle, size, apart, i, j, side, node)``: into which blocks each row ``(shingle, node, n)`` of a long column goes. A block is a
    pair of chunks ``i`` and ``j`` of one class of sizes (``apart`` 0), or of it and the next (1)."""
    if percent < 100:  # sets that link differ by less than one class, with room for rounding
        size = F.floor(F.log("n") / float(np.log(100 / percent) * 1.0001))
    else:
        size = F.col("n")
    classed = rows.withColumn("size", size.cast("long"))
    chunks = scratch.keep(classed.groupBy("shingle", "size").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks")), "chunks")
    beside = lambda step, name: chunks.select("shingle", (F.col("size") + step).alias("size"), F.col("chunks").alias(name))
    dealt = classed.join(chunks, ["shingle", "size"]).join(beside(-1, "above"), ["shingle", "size"], "left").join(
        beside(1, "below"), ["shingle", "size"], "left").withColumn("chunk", F.pmod(F.xxhash64("node", "shingle"), "chunks"))

    def met(count: str, size: str, apart: int, i: str, j: str, side: str) -> str:
        tile = f"named_struct('size', {size}, 'apart', {apart}, 'i', {i}, 'j', {j}, 'side', {side})"
        return f"slice(transform(sequence(0L, coalesce({count}, 0L)), o -> {tile}), 1, CAST(coalesce({count}, 0L) AS INT))"

    every = [met("chunks", "size", 0, "least(chunk, o)", "greatest(chunk, o)", "CAST(chunk > o AS INT)")]
    if percent < 100:
        every += [met("above", "size", 1, "chunk", "o", "0"), met("below", "size - 1", 1, "o", "chunk", "1")]
    return dealt.select("shingle", "node", F.expr(f"inline(concat({', '.join(every)}))")).select(*TILE, "side", "node")


def links(docs: DataFrame, described: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: links between class representatives (smallest doc_id of an equal set), enough of them
    to connect all that are connected."""
    nodes = described.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"))
    nodes = scratch.keep(nodes, "nodes")
    post = described.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "f1", "n", "head").mapInArrow(
        _postings, "shingle long, node long, f1 long, n long")
    # columns of two different sets at least; copies of one set open none
    open_columns = post.groupBy("shingle").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where(
        "low <> high").select("shingle")
    rows = post.join(open_columns, "shingle").join(nodes.select("node", "f1"), ["node", "f1"], "left_semi")
    rows = scratch.keep(rows.select("shingle", "node", "n"), "rows")
    columns = scratch.keep(rows.groupBy("shingle").agg(F.count("*").alias("docs"), F.sum("n").alias("cells")).where(
        "docs > 1"), "columns")

    found = rows.join(columns, "shingle").select("node").distinct()
    wanted = nodes.join(found, "node", "left_semi").select("node", F.col("f1").alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")
    sets = texts.mapInArrow(_sets(n), "node long, wanted long, f1 long, shingles binary").where("f1 = wanted")
    sets = scratch.keep(sets.select("node", "shingles"), "sets")

    small = rows.join(columns.where(F.col("docs") <= SMALL_LIST), "shingle").groupBy("shingle").agg(
        F.sort_array(F.collect_list(F.struct("node", "n"))).alias("held"))
    pairs = small.select(F.explode("held").alias("x"), "held").select("x", F.explode("held").alias("y")).where(
        "x.node < y.node AND 100 * least(x.n, y.n) >= {0} * greatest(x.n, y.n)".format(percent)
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    paired = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    cold = paired.select("a", "b", "left", "right").mapInArrow(_verify(percent), "a long, b long")

    tiles = size_tiles(rows.join(columns.where(F.col("docs") > SMALL_LIST).select("shingle"), "shingle"), percent, scratch)
    hot = tiles.join(sets, "node").select(*TILE, "side", "node", "shingles").groupBy(*TILE).applyInArrow(
        _block(percent), "a long, b long")
    return scratch.keep(cold.union(hot).distinct(), "links")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents linked when ``100 * shared >= percent * union`` of their
    ``n``-word shingle sets; ``component_id`` is the smallest ``doc_id`` reachable by links.

    Null or empty text has no shingles and links with nothing, itself excepted. Fewer than ``n`` words
    are one shingle. Rows that repeat a ``doc_id`` each return a row; they are one node. A null ``doc_id``
    is no node: its component is that of its equal set, else null. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    described = describe_sets(docs, n, percent, scratch)
    joined = components(links(docs, described, n, percent, scratch), scratch)
    nodes = described.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    classes = nodes.join(joined, "node", "left").select(
        "f1", "f2", F.coalesce("component", "node").alias("component"))
    out = described.drop("head").join(classes, ["f1", "f2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
