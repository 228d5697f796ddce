"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search in it.

Equal vectors are one node. Every node's first neighbours come from exact search inside small blocks (signs of random
projections, several draws). NN-descent then joins the graph with itself: around every node, those it has as
neighbours and the nearest of those that have it are compared pair by pair, and who finds a nearer neighbour than
its farthest takes it, until a round changes at most ``SETTLED`` of all edges. A query keeps the nearest nodes it has met
and goes on from those not yet expanded, one Spark join a round for all queries, until a round brings nothing nearer.
Queries of equal vectors are one search. How many draws make the first graph and how many nodes a query keeps grow
with the logarithm of the nodes.

Distances are Euclidean, in double precision. Work per node is bounded by the parameters; hubs are bounded because
only the nearest ``REVERSE`` of those that have a node as neighbour join around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

NEIGHBOURS = 32
REVERSE = 24
SETTLED = 0.002  # of the edges
BLOCK = 256  # nodes of a block on average
CENTRES = 512  # nodes compared around at once
OFFERS = 12  # nearest that a node is offered around each node
POOL_STEP, LEAST_POOL = 14, 64  # nodes a query keeps for each bit of the number of nodes
NODES_A_DRAW = 4  # bits of the number of nodes for each draw
ENTRIES = 16
MOST_BITS = 24


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, vec)``: no nulls, no zero vectors, nothing that is not finite, and of the commonest dimension."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec")).where("vec_id IS NOT NULL")
    good = rows.where(
        "size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
        "AND exists(vec, x -> x <> 0)")
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("vec") == (sizes[0]["n"] if sizes else 0))


def classes(vectors: DataFrame, members: int) -> DataFrame:
    """``(node, vec_id, vec)``: of each set of equal vectors the ``members`` smallest ids; the smallest is the node.
    Ranks are limited before the exchange, so a vector that a third of all rows hold costs no more than others."""
    by = Window.partitionBy("vec").orderBy("vec_id")
    ranked = vectors.distinct().withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= members)
    return ranked.withColumn("node", F.min("vec_id").over(Window.partitionBy("vec"))).drop("nth")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.sqrt(np.maximum(square, 0))


def _signs(bits: int, draw: int):
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column(1))
            planes = np.random.default_rng(1000 + draw).standard_normal((vec.shape[1], bits))
            key = ((vec @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vec), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], ["node", "vec", "key"])

    return signs


EDGES = "u long, v long, d double"


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u), "v": pa.array(v), "d": pa.array(d)})


def _block(k: int):
    def block(table: pa.Table) -> pa.Table:
        node, vec = table.column("node").to_numpy(), matrix(table.column("vec"))
        d = distances(vec, vec)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(node) - 1)]
        return _edges(np.repeat(node, near.shape[1]), node[near].ravel(), np.take_along_axis(d, near, 1).ravel())

    return block


def nearest(edges: DataFrame, k: int, by: str = "u", other: str = "v") -> DataFrame:
    ranked = edges.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("d", other)))
    return ranked.where(F.col("nth") <= k).drop("nth")


def draws(count: int) -> int:
    return max(2, -(-count.bit_length() // NODES_A_DRAW))


def pool_size(count: int) -> int:
    return max(LEAST_POOL, POOL_STEP * count.bit_length())


def first_graph(nodes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    bits = min(MOST_BITS, max(0, int(np.ceil(np.log2(max(count, 1) / BLOCK)))))
    found = None
    vec = nodes.schema["vec"].dataType.simpleString()
    for draw in range(draws(count)):
        keyed = scratch.keep(nodes.mapInArrow(_signs(bits, draw), f"node long, vec {vec}, key long"), "keyed")
        # a key of many nodes is dealt into blocks at random
        sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("parts"))
        dealt = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(draw)), "parts"))
        # after the join Spark would keep a key's parts together
        parts = dealt.select("key", "part", "node", "vec").repartition("key", "part").groupBy("key", "part")
        part = parts.applyInArrow(_block(NEIGHBOURS), EDGES)
        found = part if found is None else found.union(part)
    return scratch.keep(nearest(found.distinct(), NEIGHBOURS).withColumn("fresh", F.lit(True)), "graph")


def _around(table: pa.Table) -> pa.Table:
    """Of some centres: each member is offered the nearest other members, if nearer than its farthest neighbour."""
    order = np.argsort(table.column("centre").to_numpy(), kind="stable")
    centre, member = table.column("centre").to_numpy()[order], table.column("member").to_numpy()[order]
    far, vec = table.column("far").to_numpy()[order], matrix(table.column("vec"))[order]
    first = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
    size = np.diff(np.append(first, len(centre)))
    width = int(size.max())
    at = np.minimum(first[:, None] + np.arange(width), len(centre) - 1)
    there = np.arange(width) < size[:, None]
    u, v, d = [], [], []
    for lo in range(0, len(first), 64):
        part, on = at[lo : lo + 64], there[lo : lo + 64]
        dist = distances(vec[part], vec[part])
        dist[~(on[:, :, None] & on[:, None, :])] = np.inf
        dist[member[part][:, :, None] == member[part][:, None, :]] = np.inf
        near = np.argsort(dist, axis=2, kind="stable")[:, :, :OFFERS]
        got = np.take_along_axis(dist, near, 2)
        take = got < far[part][:, :, None]
        u.append(np.broadcast_to(member[part][:, :, None], got.shape)[take])
        v.append(member[part[np.arange(len(part))[:, None, None], near]][take])
        d.append(got[take])
    return _edges(np.concatenate(u), np.concatenate(v), np.concatenate(d))


def descend(nodes: DataFrame, graph: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """One round of NN-descent."""
    back = nearest(graph, REVERSE, "v", "u")
    around = graph.select(F.col("u").alias("centre"), F.col("v").alias("member")).union(
        back.select(F.col("v").alias("centre"), F.col("u").alias("member"))).distinct()
    far = graph.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.max("d")).otherwise(F.lit(float("inf"))).alias("far"))
    known = nodes.join(far, nodes["node"] == far["u"]).select(F.col("node").alias("member"), "far", "vec")
    buckets = max(1, -(-count // CENTRES))
    told = around.join(known, "member").withColumn("bucket", F.pmod(F.xxhash64("centre"), F.lit(buckets)))
    offers = told.select("bucket", "centre", "member", "far", "vec").groupBy("bucket").applyInArrow(_around, EDGES)
    offers = offers.withColumn("fresh", F.lit(True))
    merged = graph.withColumn("fresh", F.lit(False)).union(offers).groupBy("u", "v").agg(
        F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return scratch.keep(nearest(merged, NEIGHBOURS), "graph")


def neighbour_graph(nodes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """``(u, v, d)``: up to ``NEIGHBOURS`` neighbours of each of ``nodes(node, vec)``. Every round brings edges nearer, so
    the descent ends."""
    graph = first_graph(nodes, count, scratch)
    while True:
        moved = descend(nodes, graph, count, scratch)
        scratch.drop(graph)
        graph = moved
        facts = graph.agg(F.count("*").alias("edges"), F.count_if("fresh").alias("fresh")).first()
        if facts["fresh"] <= SETTLED * facts["edges"]:
            return graph.drop("fresh")


MEASURE = "sqrt(aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x))"


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, pool_nodes: int, scratch: Scratch) -> DataFrame:
    """``(query_id, node, d)``: the ``pool_nodes`` nearest nodes each of ``queries(query_id, vec, start)`` met. ``start`` is a node
    to begin at (null: none); a few nodes, the same for all, are begun at besides."""
    asked = scratch.keep(queries.select("query_id", F.col("vec").alias("a"), "start"), "queries")
    targets = scratch.keep(nodes.select("node", F.col("vec").alias("b")), "targets")
    entries = targets.orderBy(F.xxhash64("node")).limit(ENTRIES)  # a few rows, which go to the queries

    def measured(pairs: DataFrame, to: DataFrame) -> DataFrame:
        both = pairs.join(to, "node").join(asked.select("query_id", "a"), "query_id")
        return both.select("query_id", "node", F.expr(MEASURE).alias("d"), F.lit(False).alias("expanded"))

    places = F.array(*[F.lit(r["node"]) for r in entries.select("node").collect()]).cast("array<bigint>")
    begun = asked.select("query_id", F.explode(places).alias("node")).where("node IS NOT NULL")
    own = asked.where("start IS NOT NULL").select("query_id", F.col("start").alias("node"))
    met = measured(begun, F.broadcast(entries)).union(measured(own, targets)).distinct()
    pool = scratch.keep(nearest(met, pool_nodes, "query_id", "node"), "pool")
    while True:
        fresh = pool.where("NOT expanded").select("query_id", F.col("node").alias("u"))
        seen = pool.select("query_id", "node")
        offered = fresh.join(graph, "u").select("query_id", F.col("v").alias("node")).distinct().join(
            seen, ["query_id", "node"], "left_anti")
        grown = pool.withColumn("expanded", F.lit(True)).union(measured(offered, targets))
        grown = scratch.keep(nearest(grown, pool_nodes, "query_id", "node"), "pool")
        scratch.drop(pool)
        pool = grown
        if pool.where("NOT expanded").isEmpty():
            return pool.select("query_id", "node", "d")


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose ``vec_id`` is divisible by ``every``, the ``k`` nearest other rows
    found, nearest first, ties to the smaller ``vec_id``; all, if there are fewer.

    Rows whose vector is null, zero, has a null or non-finite component or another dimension than most take no part.
    Rows that repeat id and vector are one; an id with two vectors is as near as the nearer. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.keep(usable(vectors), "rows")
    held = scratch.keep(classes(rows, k + 1), "classes")
    nodes = scratch.keep(held.where("vec_id = node").select("node", "vec"), "nodes")
    count = nodes.count()
    graph = neighbour_graph(nodes, count, scratch)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec")
    queries = scratch.keep(asked.join(nodes, "vec").select(F.col("vec_id").alias("query_id"), F.col("node").alias("of")), "asked")
    searched = queries.select(F.col("of").alias("node")).distinct().join(nodes, "node").select(
        F.col("node").alias("query_id"), "vec", F.col("node").alias("start"))
    pool = greedy_search(searched, nodes, graph, pool_size(count), scratch)
    # of each searched vector one more id than asked for, as a query's own falls away
    near = pool.join(held.select("node", "vec_id"), "node").groupBy("query_id", "vec_id").agg(F.min("d").alias("score"))
    near = nearest(near.select("query_id", "vec_id", F.col("score").alias("d")), k + 1, "query_id", "vec_id")
    found = queries.join(near.select(F.col("query_id").alias("of"), "vec_id", "d"), "of").where("vec_id <> query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("d").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
