"""Exact clustering around centroids, with geometric drift tightening.

Components are integers, so distances and centroids are exact. Every vector keeps an upper bound of the distance to
its own centroid and one lower bound of that to all others. When centroids move, the upper bound grows by its own
centroid's drift; the lower bound shrinks by less than the others' drifts: the members of a cluster lie in a sphere
around its old centroid, and in the plane through that centre, another centroid's old place and its new one, only the
part of the drift that points to where the sphere is brings that centroid nearer. Seen from the midpoint of its
way, the sphere takes up an angle; with ``turn`` the angle between the way and the nearest edge of the sphere, no
member loses more than ``drift * cos(turn)``, and none loses anything where the sphere lies behind.

Vectors whose bounds (with a margin for rounding) tell their centroid from the others are left alone. Of the rest the
distance to their own centroid is measured first; what is ambiguous then is compared with every centroid, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

CENTROIDS = 16
DIMENSION = 64
SCALE = 64
ROUNDS = 3
MARGIN = 1e-9  # bounds must differ by more than this share of them
FITS = 1 << 26  # components up to this keep squared distances, and sums of them, in 64 bits
FAR = 10**100  # centroids with components beyond this tell nothing by bounds; all vectors are scanned
SALTS = 64  # partial sums of a cluster are added in so many groups first


def usable(vectors: DataFrame, vec_id: str, embedding: str, dimension: int) -> DataFrame:
    """``(vec_id, vec)`` of vectors of ``dimension`` components, none null or non-finite."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vec"))
    if rows.schema["vec"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    return rows.where(F.size("vec") == dimension).where(
        "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of the rows' components: 64-bit integers, Python's where those could overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if np.abs(scaled).max(initial=0) <= FITS:
        return scaled.astype(np.int64)
    # a power of two as scale only moves the exponent; beyond a double's range, multiply as integers
    return np.array([[int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(r, q)] for r, q in zip(flat, scaled)], dtype=object)


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of the points to one centroid, or each to its own."""
    if points.dtype != object and np.abs(centre).max(initial=0) > FITS:
        points = points.astype(object)
    gap = points - (centre if points.dtype == object else centre.astype(np.int64))
    return (gap * gap).sum(axis=1)


def scan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties to the smaller number), its squared distance and that of the second nearest."""
    every = np.stack([squares(points, c) for c in centroids], axis=1)
    nearest = every.argmin(axis=1)
    rows = np.arange(len(points))
    best = every[rows, nearest]
    every[rows, nearest] = every.max(axis=1) + 1
    return nearest, best, every.min(axis=1) if len(centroids) > 1 else np.full(len(points), FAR**2, dtype=object)


def roots(square: np.ndarray, beyond: float) -> np.ndarray:
    """Square roots; ``beyond`` for squares past a double's range."""
    if square.dtype == object:
        return np.array([np.sqrt(float(v)) if v < FAR**2 else beyond for v in square], dtype=np.float64)
    return np.sqrt(square.astype(np.float64))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and for each cluster by how much its members' lower bounds shrink."""
    if any(abs(x) > FAR for c in (old, new) if c.dtype == object for x in c.ravel()):
        return np.full(len(old), np.inf), np.full(len(old), np.inf)
    old, new = old.astype(np.float64), new.astype(np.float64)
    way = new - old
    drift = np.sqrt((way * way).sum(axis=1))
    middle = (old + new) / 2
    to = old[:, None, :] - middle[None, :, :]  # [cluster, other]
    far = np.sqrt((to * to).sum(axis=2))
    along = (to * way[None]).sum(axis=2)
    safe = np.maximum(far * drift[None, :], 1e-300)
    angle = np.arccos(np.clip(along / safe, -1, 1))
    outside = far > radius[:, None]
    sine = np.divide(np.broadcast_to(radius[:, None], far.shape), far, out=np.ones_like(far), where=outside)
    half = np.where(outside, np.arcsin(sine), np.pi)
    turn = np.maximum(angle - half - 1e-7, 0)  # the rounding of arccos
    loss = drift[None, :] * np.maximum(np.cos(turn), 0)
    np.fill_diagonal(loss, 0)
    return drift, loss.max(axis=1)


STATE = "vec_id {id}, vec {vec}, cluster int, distance decimal(38,0), upper double, lower double, scans int"
SUMS = "salt int, cluster int, members long, radius double, total array<string>"


def _assign(model, scale: int, last: bool):
    """One assignment; the last one measures every vector's own distance."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, drift, loss = model.value
        for batch in batches:
            points = whole(batch.column(1), scale)
            cluster = batch.column(2).to_numpy().astype(np.int64)
            fresh = cluster < 0
            own = np.maximum(cluster, 0)
            upper = np.where(fresh, np.inf, batch.column(4).to_numpy() + drift[own])
            lower = np.where(fresh, 0.0, batch.column(5).to_numpy() - loss[own])
            scans = batch.column(6).to_numpy().astype(np.int32)
            near = np.flatnonzero(_unclear(upper, lower) & ~fresh)
            if len(near):
                upper[near] = roots(squares(points[near], centroids[own[near]]), np.inf)
            unclear = np.flatnonzero(_unclear(upper, lower))
            if len(unclear):
                own[unclear], best, second = scan(points[unclear], centroids)
                upper[unclear], lower[unclear] = roots(best, np.inf), roots(second, float(FAR))
                scans[unclear] += 1
            distance = _decimals(squares(points, centroids[own])) if last and len(own) else pa.nulls(len(own), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), distance, pa.array(upper),
                 pa.array(lower), pa.array(scans)],
                ["vec_id", "vec", "cluster", "distance", "upper", "lower", "scans"])

    return assign


def _unclear(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return upper * (1 + MARGIN) >= lower * (1 - MARGIN)


def _decimals(values: np.ndarray) -> pa.Array:
    if values.dtype != object:
        return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))
    import decimal

    return pa.array([decimal.Decimal(int(v)) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def _sums(scale: int):
    """A task's members, greatest upper bound and component sums of each cluster."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            points, cluster = whole(batch.column(0), scale), batch.column(1).to_numpy()
            upper = batch.column(2).to_numpy()
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                before = held.get(c, [0, 0.0, None])
                total = [int(x) for x in points[mine].sum(axis=0)]
                held[c] = [
                    before[0] + int(mine.sum()), max(before[1], float(upper[mine].max())),
                    total if before[2] is None else [a + b for a, b in zip(total, before[2])]]
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(salt, c, n, r, [str(x) for x in t]) for c, (n, r, t) in sorted(held.items())]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["salt", "cluster", "members", "radius", "total"])

    return sums


def _added(table: pa.Table) -> pa.Table:
    totals = reduce(lambda a, b: [x + int(y) for x, y in zip(a, b)], table.column("total").to_pylist(), [0] * len(table["total"][0]))
    return pa.table({
        "salt": pa.array([0], pa.int32()), "cluster": table.column("cluster").slice(0, 1),
        "members": pa.array([sum(table.column("members").to_pylist())], pa.int64()),
        "radius": pa.array([max(table.column("radius").to_pylist())]),
        "total": pa.array([[str(x) for x in totals]], pa.list_(pa.string()))})


def cluster_sums(state: DataFrame, scale: int) -> dict[int, tuple[int, float, list[int]]]:
    """Members, radius and component sums of each cluster: added up in the tasks, by salt, then by cluster."""
    parts = state.select("vec", "cluster", "upper").mapInArrow(_sums(scale), SUMS)
    for keys in (("cluster", "salt"), ("cluster",)):
        parts = parts.groupBy(*keys).applyInArrow(_added, SUMS)
    return {r["cluster"]: (r["members"], r["radius"], [int(x) for x in r["total"]]) for r in parts.collect()}


def first_centroids(rows: DataFrame, count: int, scale: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``1:<vec_id>``, in that order; equal hashes by their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = rows.select(key.alias("key"), "vec").orderBy("key", "vec").limit(count).collect()
    return _held([whole(pa.array([r["vec"]], pa.list_(pa.float64())), scale)[0] for r in least])


def _held(centroids: list) -> np.ndarray:
    """Centroids as an array: 64-bit where they fit, Python integers else."""
    values = [[int(x) for x in c] for c in centroids]
    small = all(abs(x) <= FITS for c in values for x in c)
    return np.array(values, dtype=np.int64 if small else object)


def cluster_vectors(
    vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, scans)`` of each vector after ``rounds`` rounds and a last assignment, and the
    centroids. ``distance`` is squared, in integers; ``scans`` says how often the vector was compared with every centroid.

    Takes part: a vector of ``dimension`` components, none null or non-finite, each as ``floor(scale * x)`` (``scale`` a power
    of two). Repeated rows each count and return a row; a null id is hashed as empty; with fewer vectors than ``count`` there
    are fewer centroids; an empty table gives none. Ties go to the smaller number. Components too large for 64-bit
    squares are handled exactly in Python's integers; a squared distance of 10**38 or more is null. Other columns are
    not read."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = usable(vectors, vec_id, embedding, dimension)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = STATE.format(id=kind, vec=rows.schema["vec"].dataType.simpleString())
    centroids = first_centroids(rows, count, scale)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance decimal(38,0), scans int"), centroids
    fresh = "-1 AS cluster", "cast(0 AS decimal(38,0)) AS distance", "0D AS upper", "0D AS lower", "0 AS scans"
    state = rows.selectExpr("vec_id", "vec", *fresh)
    drift, loss = np.zeros(len(centroids)), np.zeros(len(centroids))
    kept = None
    for step in range(rounds + 1):
        model = spark.sparkContext.broadcast((centroids, drift, loss))
        state = scratch.keep(state.mapInArrow(_assign(model, scale, step == rounds), schema), "state")
        if kept is not None:
            scratch.drop(kept)
        kept = state
        if step == rounds:
            break
        found = cluster_sums(state, scale)
        moved = [[x // found[c][0] for x in found[c][2]] if c in found else old for c, old in enumerate(centroids.tolist())]
        moved = _held(moved)
        radius = np.array([found[c][1] if c in found else 0.0 for c in range(len(centroids))])
        drift, loss = loosening(centroids, moved, radius)
        centroids = moved
    return state.select("vec_id", "cluster", "distance", "scans"), centroids


def centroid_digest(centroid) -> str:
    import hashlib

    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
