"""Centroid clustering in integers: Lloyd's rounds whose distances are filtered in a PCA-rotated space.

Each vector is stored with its integers, its leading coordinates after a
rotation by the principal axes, and the norm of the rest. For a vector x and a
centroid c the projected distance plus the squared difference of their residual
norms never exceeds |x - c|^2, so that most centroids are ruled out by a few
coordinates; those that are not are compared in integers. The rotation only
decides what is compared, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop, ship, stored

#: Components whose integers lie beyond this have squared distances beyond a long.
LARGEST = 1 << 27
SCALE = 1024


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and the vector as doubles, of those with exactly dim components that are all there, finite and of an integer within LARGEST."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x) <= LARGEST / SCALE, F.lit(False)))
    return own.where((F.size("embedding") == dim) & fits)


def integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of "seed:vec_id"; equal ids by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return np.floor(np.array([r.embedding for r in rows], np.float64).reshape(-1, dim) * SCALE).astype(np.int64)


def principal_axes(vectors: DataFrame, dim: int, share: float, most: int) -> np.ndarray:
    """Orthonormal axes, one a column: as many leading ones as hold this share of the variance, at most `most`, and the mean's influence left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim + 1)), 0
        for batch in batches:
            x = integers(batch.column(0), dim).astype(np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "total"])

    cells = np.zeros((dim + 1) ** 2)
    for r in vectors.select("embedding").mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        cells[r.cell] = r.total
    moments = cells.reshape(dim + 1, dim + 1)
    mean = moments[-1, :-1] / max(1.0, moments[-1, -1])
    values, axes = np.linalg.eigh(moments[:-1, :-1] / max(1.0, moments[-1, -1]) - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    enough = int(np.searchsorted(np.cumsum(values), share * values.sum())) + 1
    return np.ascontiguousarray(axes[:, : max(1, min(enough, most, dim))])


def rotated(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of each row, and the norm of what they leave."""
    lead = x.astype(np.float64) @ axes
    rest = (x.astype(np.float64) ** 2).sum(1) - (lead**2).sum(1)
    return lead, np.sqrt(np.maximum(rest, 0))


def indexed(vectors: DataFrame, axes: np.ndarray) -> DataFrame:
    """vec_id, the integers v, and the leading rotated coordinates followed by the residual norm."""
    dim = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), dim)
            near = np.column_stack(rotated(x, axes))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (x.astype(np.int32), near)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["vec_id", "v", "near"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, near array<double>")


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid (the smallest number of several) and its squared distance, and how many distances were taken."""
    lead, rest = rotated(centroids, axes)
    own, own_rest = near[:, :-1], near[:, -1]
    squares, own_squares = (centroids.astype(np.float64) ** 2).sum(1), (own**2).sum(1) + own_rest**2
    low = (own**2).sum(1)[:, None] - 2 * own @ lead.T + (lead**2).sum(1) + (own_rest[:, None] - rest) ** 2
    # far more than what rounding can add: residual norms are roots of differences of squares
    low -= 1e-6 * np.sqrt((own_squares[:, None] + squares) * (1 + np.maximum(low, 0))) + 1e-9 * (own_squares[:, None] + squares) + 1
    guess = low.argmin(1)
    best = ((x - centroids[guess]) ** 2).sum(1)
    at, which = np.nonzero(low <= best[:, None])
    found = np.full(low.shape, np.iinfo(np.int64).max)
    found[np.arange(len(x)), guess] = best
    new = which != guess[at]
    at, which = at[new], which[new]
    for lo in range(0, len(at), 1 << 15):
        a, c = at[lo : lo + (1 << 15)], which[lo : lo + (1 << 15)]
        found[a, c] = ((x[a] - centroids[c]) ** 2).sum(1)
    chosen = found.argmin(1)
    return chosen, found[np.arange(len(x)), chosen], len(x) + len(at)


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            v, near = batch.column(batch.schema.get_field_index("v")), batch.column(batch.schema.get_field_index("near"))
            yield batch, v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64), near.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def moved(index: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors; one without vectors stays."""
    dim, k = len(axes), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for _, x, near in _batches(batches, dim):
            chosen = nearest(x, near, centroids, axes)[0]
            by = np.argsort(chosen, kind="stable")
            own, head = np.unique(chosen[by], return_index=True)
            total[own, :dim] += np.add.reduceat(x[by], head, axis=0)
            total[own, dim] += np.diff(np.r_[head, len(by)])
        some = np.flatnonzero(total[:, dim])
        if len(some):
            cells = (some[:, None] * (dim + 1) + np.arange(dim + 1)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[some].ravel())], ["cell", "total"])

    sums = index.select("v", "near").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {r.cell: int(r.total) for r in sums}
    out = centroids.copy()
    for c in range(k):
        if n := totals.get(c * (dim + 1) + dim):
            out[c] = [totals[c * (dim + 1) + j] // n for j in range(dim)]
    return out


def assigned(index: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector of the index."""
    dim = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, near in _batches(batches, dim):
            chosen, distance, _ = nearest(x, near, centroids, axes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return index.select("vec_id", "v", "near").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, share: float = 0.9, lead: int = 16) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, and the final centroids.

    Vectors of another length, with null or non-finite components, or with one
    beyond LARGEST are left out (usable). Repeated rows and ids count as often as
    they come; a null vec_id is clustered and is a first centroid only if there
    are too few others; fewer vectors than k give as many centroids; an empty
    table gives no rows. Rounds end early once no centroid moves, since none
    would again. What comes to the driver: k vectors, the (dim + 1)^2 moments
    and k * (dim + 1) sums a round, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = usable(vectors, dim)
    centroids = first_centroids(good, k, seed, dim)
    axes = principal_axes(good, dim, share, lead)
    index = stored(indexed(good, axes), "vectors")
    if not len(centroids):
        empty = index.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return empty.where("false"), []
    for _ in range(rounds):
        new = moved(index, centroids, axes)
        if (new == centroids).all():
            break
        centroids = new
    found = stored(assigned(index, centroids, axes), "clusters")
    drop(spark, index)
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return out, centroids.tolist()
