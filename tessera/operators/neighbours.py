"""Exact k-nearest-neighbour join by pivots.

Points fall into the Voronoi cells of a few pivots, and every cell knows how
near and how far its points lie from its pivot.  A query first searches the
cell that it lies in, which bounds the distance of its k-th neighbour from
above; the k smallest distances to each pivot bound it too, for cells with
few points.  Then it is sent only to those other cells that the triangle
inequality and the half-space between two pivots cannot exclude.

A search pairs blocks: a cell's points are cut into blocks of bounded size,
and so are the queries that reach the cell, so that a cell with a large share
of all points or queries is many tasks, none larger than two blocks.  Each
block gives k candidates per query, and the best k of all candidates remain.
Distances inside a block come from one matrix product; those within its
rounding error of the k-th best are measured again by differences, so the
result is that of comparing every pair.

Defined cases: vectors that are null, of another length than ``size``, or
with a null or non-finite component have no neighbours and are none; rows
that repeat an id are points (or queries) of their own; equal distances go by
the smaller point id, a null id last; fewer than k points give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship, written

ship(__name__)

BLOCK = 16384
#: Points that are met first on either side of some queries, beside k.
NEXT = 64
_LAST = np.iinfo(np.int64).max


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _usable(df: DataFrame, id_column: str, vector: str, size: int) -> DataFrame:
    x = F.transform(_q(vector), lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.select(_q(id_column).cast("long").alias("id"), x.alias("v")).where((F.size("v") == size) & ~bad)


def _matrix(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in y], 1)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def in_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, d): every point with its nearest pivot and the distance to it."""
    def work(batches):
        for batch in batches:
            d = _distances(_matrix(batch.column("v"), pivots.shape[1]), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)),
                                              pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    return points.mapInArrow(work, "id long, v array<double>, cell int, d double")


def to_pivots(queries: DataFrame, pivots: np.ndarray, nearest: np.ndarray, k: int) -> DataFrame:
    """(id, v, ds, cell, bound): every query with its distances to the pivots, its cell, and what its k-th neighbour's
    distance cannot exceed. ``nearest[j]`` are the k smallest distances to pivot j in its cell (infinite where there are fewer)."""
    def work(batches):
        for batch in batches:
            d = _distances(_matrix(batch.column("v"), pivots.shape[1]), pivots)
            bound = np.empty(len(d))
            for a in range(0, len(d), 1024):
                reach = (d[a:a + 1024, :, None] + nearest[None]).reshape(len(d[a:a + 1024]), -1)
                bound[a:a + 1024] = np.partition(reach, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), _lists(d),
                                              pa.array(d.argmin(1).astype(np.int32)), pa.array(bound)], ["id", "v", "ds", "cell", "bound"])

    return queries.mapInArrow(work, "id long, v array<double>, ds array<double>, cell int, bound double")


def reached_cells(bounded: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(n, id, v, cell) for every other cell that may hold a neighbour of the query (n, id, v, ds, cell, bound).

    ``low`` and ``high`` are the smallest and largest distance of a cell's points to its pivot (an empty cell: infinite low)."""
    between = _distances(pivots, pivots)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d, own = _matrix(batch.column("ds"), len(pivots)), batch.column("cell").to_numpy()
            bound = batch.column("bound").to_numpy()
            apart = np.maximum(d - high, low - d)
            half = between[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                side = (d ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * half)
            apart = np.maximum(apart, np.where(half > 0, side, 0))
            # Bounds are loosened by more than their rounding error.
            reach = (apart <= bound[:, None] * (1 + 1e-9) + 1e-9 * (1 + d)) & np.isfinite(low)
            reach[np.arange(len(d)), own] = False
            row, cell = np.nonzero(reach)
            taken = batch.select(["n", "id", "v"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32))], ["n", "id", "v", "cell"])

    return bounded.mapInArrow(work, "n long, id long, v array<double>, cell int")


def main_direction(y: np.ndarray) -> np.ndarray:
    """A unit vector near the direction in which the rows of y differ most."""
    middle = y - y.mean(0)
    u = np.linspace(1, 2, y.shape[1])
    for _ in range(4):
        u = middle.T @ (middle @ u)
        size = np.sqrt((u ** 2).sum())
        if not np.isfinite(size) or size == 0:
            return np.eye(1, y.shape[1])[0]
        u /= size
    return u


def best_in_block(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y to each row of x, by (distance, id).

    Both are put in order along the direction in which the rows of y differ most. Places on it lie no further apart than
    the rows themselves, so of a few queries that stand together only the stretch of points is measured that reaches as
    far on either side as the k-th best of the points next to them: all points where nothing can be left out."""
    rows, cols, dist = [], [], []
    y2, x2 = (y ** 2).sum(1), (x ** 2).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        u = main_direction(y)
        px, py = x @ u, y @ u
        in_x, in_y = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
        wide = 1e-12 * y.shape[1] * (np.sqrt(x2.max(initial=0)) + np.sqrt(y2.max()))
    x, x2, px, y, y2, py, ids = x[in_x], x2[in_x], px[in_x], y[in_y], y2[in_y], py[in_y], ids[in_y]
    ordered = len(y) > 4 * (k + NEXT) and np.isfinite(wide) and np.isfinite(px).all() and np.isfinite(py).all()
    step = max(1, (1 << 22) // len(y))

    def measured(a: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squares to the points from lo to hi, the k-th smallest and what rounding may have made of it."""
        square = x2[a:a + step, None] + y2[None, lo:hi] - 2 * x[a:a + step] @ y[lo:hi].T
        slack = 1e-12 * y.shape[1] * (x2[a:a + step, None] + y2.max())
        return square, np.partition(square, min(k, hi - lo) - 1, axis=1)[:, [min(k, hi - lo) - 1]], slack

    for a in range(0, len(x), step):
        part, at = x[a:a + step], px[a:a + step]
        lo, hi = 0, len(y)
        if ordered:
            lo = max(0, np.searchsorted(py, at[0]) - k - NEXT)
            hi = min(len(y), np.searchsorted(py, at[-1], "right") + k + NEXT)
            _, last, slack = measured(a, lo, hi)
            reach = np.sqrt(np.maximum(last + slack, 0) + slack)[:, 0] * (1 + 1e-9) + wide
            lo, hi = np.searchsorted(py, (at - reach).min()), np.searchsorted(py, (at + reach).max(), "right")
        square, last, slack = measured(a, lo, hi)
        r, c = np.nonzero(square <= last + slack)
        c += lo
        d = np.empty(len(r))
        for b in range(0, len(r), 1 << 16):
            d[b:b + (1 << 16)] = np.sqrt(((part[r[b:b + (1 << 16)]] - y[c[b:b + (1 << 16)]]) ** 2).sum(1))
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        begin = np.searchsorted(r, np.arange(len(part)))
        keep = np.arange(len(r)) - begin[r] < k
        rows.append(in_x[r[keep] + a])
        cols.append(in_y[c[keep]])
        dist.append(d[keep])
    order = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(rows)[order], np.concatenate(cols)[order], np.concatenate(dist)[order]


def search(asked: DataFrame, cells: DataFrame, counts: dict[int, int], k: int, size: int, block: int) -> DataFrame:
    """(n, query, point, distance): the k nearest points of each asked (n, id, v, cell), per block of the cell."""
    asked = written(asked, "asked")
    many = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = F.create_map(*[x for c in many for x in (F.lit(c), F.struct(
        F.lit(math.ceil(counts.get(c, 0) / block)).alias("points"), F.lit(math.ceil(many[c] / block)).alias("queries")))]) if many else None
    if table is None:
        return asked.select("n", F.col("id").alias("query"), F.col("id").alias("point"), F.lit(0.0).alias("distance"))
    shares = table[F.col("cell")]
    left = asked.select("n", "id", "v", "cell", (F.col("n") % shares["queries"]).cast("int").alias("q"),
                        F.explode(F.sequence(F.lit(0), shares["points"] - 1)).alias("p"))
    right = cells.where(F.col("cell").isin(list(many))).select(
        "id", "v", "cell", F.explode(F.sequence(F.lit(0), shares["queries"] - 1)).alias("q"),
        (F.col("m") % shares["points"]).cast("int").alias("p"))

    def work(key, a, b):
        schema = pa.schema([("n", pa.int64()), ("query", pa.int64()), ("point", pa.int64()), ("distance", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ids = b.column("id").combine_chunks()
        rank = ids.fill_null(_LAST).to_numpy()
        r, c, d = best_in_block(_matrix(a.column("v"), size), _matrix(b.column("v"), size), rank, k)
        return pa.Table.from_arrays([a.column("n").take(pa.array(r)), a.column("id").take(pa.array(r)), ids.take(pa.array(c)),
                                     pa.array(d)], schema=schema)

    by = ["cell", "q", "p"]
    # The work is in the pairs of blocks, not in their bytes, which Spark would merge into a few tasks.
    blocks = sum(math.ceil(counts.get(c, 0) / block) * math.ceil(many[c] / block) for c in many)
    met = sum(math.ceil(counts.get(c, 0) / block) * many[c] for c in many)
    tasks = max(1, min(blocks, math.ceil(4 * met / block)))
    left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, "n long, query long, point long, distance double")


def knn_join(queries: DataFrame, points: DataFrame, k: int, size: int, vector: str = "embedding", id_column: str = "vec_id",
             pivots: int = 32, block: int = BLOCK) -> DataFrame:
    """One row per query and neighbour: n (number of the query row), query, rank (from 1), point, distance (Euclidean)."""
    given = _usable(points, id_column, vector, size)
    chosen = given.orderBy(F.xxhash64("v"), "v").limit(8 * pivots).select("v").distinct().collect()  # a bounded draw by hash
    found = np.array(sorted(r["v"] for r in chosen), float)
    if len(found) > pivots:     # from all of their range: the first ones alone would leave most points in one cell
        found = found[np.arange(pivots) * len(found) // pivots]
    if not len(found):
        return given.select(F.lit(0).cast("long").alias("n"), F.col("id").alias("query"), F.lit(1).alias("rank"),
                            F.col("id").alias("point"), F.lit(0.0).alias("distance"))
    cells = written(in_cells(given, found).withColumn("m", F.monotonically_increasing_id()), "cells")
    about = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    first = cells.select("cell", "d", nth.alias("nth")).where(f"nth <= {k}").collect()  # at most k for each pivot
    nearest = np.full((len(found), k), np.inf)
    for r in first:
        nearest[r["cell"], r["nth"] - 1] = r["d"]
    low = np.array([about[j]["low"] if j in about else np.inf for j in range(len(found))])
    high = np.array([about[j]["high"] if j in about else -np.inf for j in range(len(found))])
    counts = {j: r["n"] for j, r in about.items()}

    asked = to_pivots(_usable(queries, id_column, vector, size), found, nearest, k)
    asked = written(asked.withColumn("n", F.monotonically_increasing_id()), "queries")
    own = written(search(asked.select("n", "id", "v", "cell"), cells, counts, k, size, block), "near")
    # The k-th best point met so far is one that the k-th neighbour cannot lie beyond.
    best = own.select("n", "distance", F.row_number().over(Window.partitionBy("n").orderBy("distance")).alias("nth")).where(f"nth = {k}")
    bounded = asked.join(best.select("n", F.col("distance").alias("kth")), "n", "left").select(
        "n", "id", "v", "ds", "cell", F.least("bound", F.coalesce("kth", "bound")).alias("bound"))
    others = search(reached_cells(bounded, found, low, high), cells, counts, k, size, block)
    order = Window.partitionBy("n").orderBy("distance", F.col("point").asc_nulls_last())
    return own.unionByName(others).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select(
        "n", "query", "rank", "point", "distance")


def without_itself(neighbours: DataFrame, k: int) -> DataFrame:
    """The first k neighbours of each query that are not the query's own id; ask ``knn_join`` for one more."""
    other = neighbours.where(~F.col("query").eqNullSafe(F.col("point")))
    order = Window.partitionBy("n").orderBy("distance", F.col("point").asc_nulls_last())
    return other.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def vote(neighbours: DataFrame, labels: DataFrame, label: str, id_column: str = "vec_id") -> DataFrame:
    """One row per query row: n, query, predicted (the commonest label of its neighbours, ties: the smallest), share."""
    known = labels.select(_q(id_column).cast("long").alias("point"), _q(label).alias("label")).where("label is not null")
    counts = neighbours.join(known, "point").groupBy("n", "query", "label").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("n").orderBy(F.desc("votes"), "label")
    every = Window.partitionBy("n")
    return counts.select("n", "query", F.col("label").alias("predicted"), (F.col("votes") / F.sum("votes").over(every)).alias("share"),
                         F.row_number().over(order).alias("nth")).where("nth = 1").drop("nth")
