"""Blocks of a nearest-neighbour search: the stretch of points that is measured, cells of like size, tasks."""

import numpy as np
import pytest

from tessera.operators import model as md
from tessera.operators import neighbours as nb


def _brute(x, y, ids, k):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    return [[(int(j), float(d[i, j])) for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(x))]


def _features(rng, n):
    chars = np.round(rng.lognormal(7, 0.8, n))
    return np.column_stack([chars, np.round(chars / 6 + rng.normal(0, 5, n)), np.eye(4)[rng.integers(0, 4, n)]])


@pytest.mark.parametrize("kind", ["features", "ties", "normal", "far", "outlier", "few", "equal"])
def test_block_search_equals_brute_force(kind):
    rng = np.random.default_rng(5)
    x, y = {"features": lambda: (_features(rng, 300), _features(rng, 2000)),
            "ties": lambda: (rng.integers(0, 3, (300, 2)) * 1.0, rng.integers(0, 3, (900, 2)) * 1.0),
            "normal": lambda: (rng.normal(size=(200, 8)), rng.normal(size=(900, 8))),
            "far": lambda: (1e6 + rng.normal(size=(200, 3)), 1e6 + rng.normal(size=(900, 3))),
            "outlier": lambda: (rng.normal(size=(200, 3)) + [1e4, 0, 0], np.vstack([[1e5, 0, 0], rng.normal(size=(900, 3))])),
            "few": lambda: (rng.normal(size=(50, 3)), rng.normal(size=(3, 3))),
            "equal": lambda: (np.zeros((50, 3)), np.zeros((600, 3)))}[kind]()
    ids = rng.permutation(len(y))
    row, col, dist = nb.best_in_block(x, y, ids, 5)
    got = [[] for _ in x]
    for r, c, d in zip(row, col, dist):
        got[r].append((int(c), float(d)))
    assert got == _brute(x, y, ids, 5)


def test_a_block_measures_a_stretch_of_its_points(monkeypatch):
    """Of 16,384 points that differ in one direction far more than in others, few are met by each query."""
    rng, met, partition = np.random.default_rng(6), [], np.partition
    y = _features(rng, nb.BLOCK)
    monkeypatch.setattr(nb.np, "partition", lambda a, *b, **c: met.append(a.size) or partition(a, *b, **c))
    nb.best_in_block(y, y, np.arange(len(y)), 5)
    assert sum(met) < len(y) ** 2 / 5


def test_cells_are_of_like_size(spark, monkeypatch):
    sizes, in_cells = [], nb.in_cells

    def seen(points, pivots):
        out = in_cells(points, pivots)
        sizes.extend(r["count"] for r in out.groupBy("cell").count().collect())
        return out

    monkeypatch.setattr(nb, "in_cells", seen)
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(2000)], "vec_id long, embedding array<double>")
    assert nb.knn_join(rows, rows, 2, 2, pivots=8).count() == 4000
    assert len(sizes) == 8 and max(sizes) < 1000


def test_partitions_of_a_fit_stop_at_two_for_each_core(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 400 * cores, 1, 100 * cores)
    monkeypatch.setattr(md, "ROWS", 40)
    assert md.compacted(rows).rdd.getNumPartitions() == 2 * cores
    assert md.compacted(rows, 16).rdd.getNumPartitions() == max(16, 10 * cores)
    monkeypatch.setattr(md, "NUMBERS", 50)
    assert md.compacted(rows).rdd.getNumPartitions() == 8 * cores
