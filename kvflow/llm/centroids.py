"""Exact k-means over integer vectors, with distances skipped by geometry.

Every vector keeps its cluster, an upper bound of the distance to its centroid and one lower bound of
the distance to all others. When centroids move, the upper bound grows by its own centroid's drift. The
lower bound is loosened by less than the largest drift: all vectors of a cluster lie in the sphere
around its centroid that reaches to the largest upper bound, and for a point x and a centroid moved from
p to q,

    |x - p| - |x - q| = 2 |q - p| t / (|x - p| + |x - q|) <= |q - p| cos(angle)

where t is the place of x along the way from p to q, counted from the middle, and the angle is that
between this way and the line from the middle to x, as the two distances add up to twice that line at
least. In the plane of p, q and the sphere's centre the least angle is the centre's angle less the one
under which the sphere's radius is seen from the middle. So a sphere that lies aside is loosened by part of
the drift, one that is left behind not at all. Vectors whose bounds still meet have the distance to their own centroid
computed, and if that doesn't settle it, all distances, in integers.

Bounds are doubles with a margin far above their rounding; a vector is skipped only if its bounds are
strictly apart, so ties are always decided exactly.

Defined results: vectors that are null, of another length, or with a component that is null or not finite
are left out; with fewer vectors than centroids each has one of its own; equal vectors and repeated or
null ids are rows of their own; no vectors give no rows. Integers so large that squared distances
might exceed 64 bits are an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.llm.common import stored, written
from kvflow.sources.paths import delete_path

K, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Relative margins of stored distances, and of sines and cosines.
_MARGIN, _TURN = 1e-12, 1e-6


class Drift(NamedTuple):
    """What a move of the centroids does to bounds, by cluster."""

    raise_upper: np.ndarray
    loosen_lower: np.ndarray


class Clusters(NamedTuple):
    """One row per vector that was kept, (id, cluster, distance), and the final centroids by number."""

    rows: DataFrame
    centroids: list[list[int]]


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that are whole: ``floor(scale * x)`` of each component."""
    whole = F.col("raw").isNotNull() & (F.size("raw") == dimensions) & F.forall(
        "raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    # the components' squared differences have to add up within 62 bits
    limit = 1 << ((62 - (dimensions - 1).bit_length()) // 2 - 1)
    message = F.lit(f"a component times {scale} exceeds {limit}: squared distances might not fit 64 bits")

    def integer(x):
        scaled = F.floor(x * scale)
        return F.when(F.abs(x * scale) < limit, scaled.cast("int")).otherwise(F.raise_error(message).cast("int"))

    raw = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("raw"))
    return raw.filter(whole).select("id", F.transform("raw", integer).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of least SHA-256 of ``<seed>:<id>``; ids that are equal or null come by their vectors."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(named, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) squared distances, exact."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, centroid in enumerate(centroids):
        apart = vectors - centroid
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def drift(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> Drift:
    """Bounds' changes when centroids move; ``radii`` reach from each old centroid to all its vectors."""
    p, q = old.astype(float), new.astype(float)
    way = q - p
    moved = np.sqrt((way**2).sum(axis=1)) * (1 + _MARGIN)
    k = len(p)
    loosen = np.zeros(k)
    for a in range(k):
        for j in range(k):
            if j == a or not way[j].any():
                continue
            line = p[a] - (p[j] + q[j]) / 2
            far = np.sqrt((line**2).sum())
            cosine = 1.0
            if far > radii[a]:
                along = np.clip((line @ way[j]) / (far * moved[j]), -1, 1)
                seen = min(1.0, radii[a] / far)
                aside, level = np.sqrt(1 - along**2), np.sqrt(1 - seen**2)
                # the sphere does not reach the axis: turn its centre's angle by the one it is seen under
                if along < level - _TURN:
                    cosine = along * level + aside * seen + _TURN
            loosen[a] = max(loosen[a], moved[j] * min(1.0, max(0.0, cosine)))
    return Drift(moved, loosen * (1 + _MARGIN))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def assign(state: DataFrame, centroids: np.ndarray, change: Drift | None) -> DataFrame:
    """``state`` (id, v, cluster, was, upper, lower) with clusters and bounds for these centroids."""
    kind, dimensions = dict(state.dtypes)["id"], centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), dimensions)
            if change is None:
                was, open_ = None, np.arange(len(vectors))
                own, upper, lower = np.zeros(len(vectors), np.int32), np.zeros(len(vectors)), np.zeros(len(vectors))
            else:
                was = batch.column(2).to_numpy()
                own = was.copy()
                upper = (batch.column(4).to_numpy() + change.raise_upper[own]) * (1 + _MARGIN)
                lower = batch.column(5).to_numpy()
                lower = lower - change.loosen_lower[own] - np.where(np.isfinite(lower), lower, 0) * _MARGIN
                open_ = np.flatnonzero(upper >= lower)
                apart = vectors[open_] - centroids[own[open_]]
                upper[open_] = np.sqrt(np.einsum("ij,ij->i", apart, apart)) * (1 + _MARGIN)
                open_ = open_[upper[open_] >= lower[open_]]
            if len(open_):
                away = distances(vectors[open_], centroids)
                near = away.argmin(axis=1)
                own[open_] = near
                rows = np.arange(len(open_))
                upper[open_] = np.sqrt(away[rows, near]) * (1 + _MARGIN)
                if len(centroids) > 1:
                    away[rows, near] = np.iinfo(np.int64).max
                    lower[open_] = np.sqrt(away.min(axis=1)) * (1 - _MARGIN)
                else:
                    lower[open_] = np.inf
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(own, pa.int32()),
                    pa.nulls(len(own), pa.int32()) if was is None else pa.array(was, pa.int32()),
                    pa.array(upper), pa.array(lower),
                ],
                names=["id", "v", "cluster", "was", "upper", "lower"],
            )

    return state.select("id", "v", "cluster", "was", "upper", "lower").mapInArrow(
        task, f"id {kind}, v array<int>, cluster int, was int, upper double, lower double"
    )


def sum_changes(state: DataFrame, k: int, dimensions: int) -> np.ndarray | None:
    """(clusters, dimensions): what vectors that changed their cluster add to sums; None if none did."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((k, dimensions), np.int64), False
        for batch in batches:
            vectors = _matrix(batch.column(0), dimensions)
            any_ |= len(vectors) > 0
            now = batch.column(1).to_numpy()
            was = batch.column(2).fill_null(-1).to_numpy()
            np.add.at(total, now, vectors)
            np.subtract.at(total, was[was >= 0], vectors[was >= 0])
        if any_:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], names=["cluster", "sums"]
            )

    moved = state.filter("was IS NULL OR was <> cluster").select("v", "cluster", "was")
    parts = moved.mapInArrow(task, "cluster int, sums array<bigint>")
    rows = parts.select("cluster", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(
        F.sum("part").alias("total")
    ).collect()
    if not rows:
        return None
    out = np.zeros((k, dimensions), np.int64)
    for r in rows:
        out[r["cluster"], r["place"]] = r["total"]
    return out


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "3",
) -> Clusters:
    """k-means from the ``k`` vectors of least hash: ``rounds`` times assign and move, then assign.

    A moved centroid is the floor of its vectors' mean, component by component; an empty one stays.
    The driver holds centroids, sums and counts, nothing per vector. Vectors and bounds are written
    once a round, and the table of the round before is removed.
    """
    spark = df.sparkSession
    vectors = stored(integer_vectors(df, id_col, vector_col, dimensions, scale), "vectors")
    kind = dict(vectors.dtypes)["id"]
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], f"id {kind}, cluster int, distance long"), [])
    state = vectors.select(
        "id", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("int").alias("was"),
        F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"),
    )
    change, before, sums = None, None, np.zeros(centroids.shape, np.int64)
    for _ in range(rounds):
        state, path = written(assign(state, centroids, change), "clusters")
        if before:
            delete_path(spark, before)
        before = path
        more = sum_changes(state, *centroids.shape)
        if more is None:
            # no vector has moved, so no centroid will any more
            change = Drift(np.zeros(len(centroids)), np.zeros(len(centroids)))
            break
        sums += more
        new, radii = centroids.copy(), np.zeros(len(centroids))
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius")).collect():
            new[r["cluster"]] = sums[r["cluster"]] // r["n"]
            radii[r["cluster"]] = r["radius"]
        change, centroids = drift(centroids, new, radii), new
    last = assign(state, centroids, change).select("id", "v", "cluster")
    rows = stored(_measured(last, centroids, kind), "cluster-rows")
    if before:
        delete_path(spark, before)
    return Clusters(rows, [[int(x) for x in c] for c in centroids])


def _measured(state: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(id, cluster, distance): squared distances to the own centroid."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _matrix(batch.column(1), centroids.shape[1]) - centroids[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", apart, apart), pa.int64())],
                names=["id", "cluster", "distance"],
            )

    return state.mapInArrow(task, f"id {kind}, cluster int, distance long")


def with_inertia(clusters: Clusters) -> DataFrame:
    """The rows with cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas)."""
    spark = clusters.rows.sparkSession
    sums = {r["cluster"]: r["s"] for r in clusters.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    # one row per centroid
    per = [
        (j, sums[j], total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(clusters.centroids) if j in sums
    ]
    facts = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.rows.join(F.broadcast(facts), "cluster")
