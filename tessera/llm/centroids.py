"""Centroid clustering of integer vectors with a LAESA pivot table.

A few fixed pivots are chosen among the starting centroids.  The distance of
every vector to every pivot is computed once and written beside the vector.
In each round the centroids' distances to the pivots are known too, and the
largest difference of the two to any pivot is a lower bound of the distance
between vector and centroid.  The centroid with the lowest bound is measured
first; every other one whose bound lies over the best distance so far is left
out, and the survivors get exact distances on whole numbers.  Bounds are
lowered by more than floating-point error, so nothing that could win or tie
is left out.

Each task adds up its vectors by cluster, so a round moves a few rows per
task, and the driver holds nothing but the centroids.  The table of vectors
is written once and read by every round; a lost executor repeats its tasks.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out; numbers beyond 2**27 after scaling count
as 2**27, so that squared distances fit 64 bits; a null id never starts a
centroid while others are left, and equal ids are told apart by their
vectors; fewer vectors than centroids start fewer centroids; an empty cluster
keeps its centroid; no vectors give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import literal_table, ship, written

ship(__name__)

LIMIT = 1 << 27


def whole_vectors(vectors: DataFrame, size: int, scale: float, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): the usable vectors as whole numbers floor(scale * x)."""
    x = F.col(f"`{column}`")
    usable = (F.size(x) == size) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return vectors.where(x.isNotNull() & usable).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), whole.alias("v"))


def starting_centroids(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The k first vectors by ``order`` (ties: by their components), one row each."""
    rows = vectors.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def choose_pivots(points: np.ndarray, number: int) -> np.ndarray:
    """Points far from each other: each next one is farthest from those chosen."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(number, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between the rows of x and of y, as floats."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1).astype(np.float64)) for p in y], 1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray):
    """Number of the nearest centroid of each row (ties: the smaller), its squared distance, and how many
    distances were measured."""
    lower = np.zeros((len(x), len(centroids)))
    for j in range(to_pivots.shape[1]):
        a, b = to_pivots[:, j, None], centroid_pivots[None, :, j]
        np.maximum(lower, np.abs(a - b) - 1e-9 * (a + b) - 1e-6, out=lower)
    which = lower.argmin(1)
    best = ((x - centroids[which]) ** 2).sum(1)
    measured = len(x)
    first, square = which.copy(), lower * lower
    for c in range(len(centroids)):
        rows = np.flatnonzero((square[:, c] <= best) & (first != c))
        measured += len(rows)
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
        best[rows[better]], which[rows[better]] = d[better], c
    return which, best, measured


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, d): the vectors with their distances to the pivots. Written."""
    size, number = pivots.shape[1], len(pivots)

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            d = pa.array(distances(x, pivots).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * number)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, d)],
                                             ["vec_id", "v", "d"])

    return written(vectors.mapInArrow(work, "vec_id long, v array<int>, d array<double>"), "pivots")


def _matrix(column, size: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(kind)


def cluster_sums(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For every cluster that has vectors: how many, and the sums of their components."""
    size, centroid_pivots = centroids.shape[1], distances(centroids, pivots)

    def work(batches):
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            which, _, _ = nearest(x, _matrix(batch.column("d"), len(pivots), np.float64), centroids, centroid_pivots)
            np.add.at(sums, which, x)
            count += np.bincount(which, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": used, "n": count[used], "sums": list(sums[used])},
                                         pa.schema([("cluster", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = table.select("v", "d").mapInArrow(work, "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(size)]) for r in total.collect()}


def assigned(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared)."""
    size, centroid_pivots = centroids.shape[1], distances(centroids, pivots)

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            which, best, _ = nearest(x, _matrix(batch.column("d"), len(pivots), np.float64), centroids, centroid_pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(best)],
                                             ["vec_id", "cluster", "distance"])

    return table.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, size: int = 64, k: int = 40, rounds: int = 5, pivots: int = 8, scale: float = 256.0,
            order: Column | None = None) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    ``order`` ranks the vectors that start the centroids (column vec_id may be used)."""
    spark = vectors.sparkSession
    order = F.col("vec_id") if order is None else order
    whole = whole_vectors(vectors, size, scale)
    centroids = starting_centroids(whole, k, order)
    if not len(centroids):
        return whole.select("vec_id", F.lit(None).cast("int").alias("cluster"), *[F.lit(None).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")], F.lit(None).cast("string").alias("centroid_sha256"),
            F.lit(None).cast("array<int>").alias("centroid"))
    points = choose_pivots(centroids, pivots)
    table = pivot_table(whole, points)
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(table, points, centroids).items():
            centroids[c] = [s // n for s in sums]
    last = written(assigned(table, points, centroids), "assigned")
    inertia = {r["cluster"]: r["i"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    rows = [dict(cluster=c, cluster_inertia=i, centroid=centroids[c].tolist(),
                 centroid_sha256=hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, i in sorted(inertia.items())]
    about = literal_table(spark, rows, "cluster int, cluster_inertia long, centroid_sha256 string, centroid array<int>")
    return last.join(F.broadcast(about), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        "centroid_sha256", "centroid")


def hash_order(seed: str = "2:") -> Column:
    """Ranks vectors by the hash of a seed and their id; a null id has no rank."""
    return F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
