"""k-nearest neighbours against comparing every pair."""

import math

import numpy as np
import pytest

from tessera.operators import neighbours as nb
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, n string"


def truth(queries, points, k, size):
    ok = lambda e: e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)
    out = []
    for i, e in queries:
        if ok(e):
            near = sorted((math.dist(e, f), j is None, j or 0, j) for j, f in points if ok(f))[:k]
            out.append((str(i), [(round(d, 9), str(j)) for d, _, _, j in near]))
    return sorted(out)


def result(frame):
    by = {}
    for r in frame.collect():
        by.setdefault((r["n"], r["query"]), []).append((r["rank"], round(r["distance"], 9), str(r["point"])))
    for v in by.values():
        assert [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))
    return sorted((str(i), [x[1:] for x in sorted(v)]) for (_, i), v in by.items())


def _frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "clash") for i, e in rows], SCHEMA)


@pytest.mark.parametrize("spread,k,block,pivots", [(0.1, 3, 16384, 8), (0.1, 3, 37, 8), (3.0, 7, 50, 5), (0.02, 1, 11, 20)])
def test_groups_of_points(spark, spread, k, block, pivots):
    rng = np.random.default_rng(int(spread * 100) + k)
    hubs = rng.normal(0, 2, (9, 4))
    points = [(i, (hubs[i % 9] + rng.normal(0, spread, 4)).tolist()) for i in range(400)]
    points += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]  # a point that a third of the rows share
    queries = points[::23] + [(7, [9.0, -9.0, 9.0, 9.0]), (1005, [0.5, 0.5, 0.5, 0.5])]
    got = nb.knn_join(_frame(spark, queries), _frame(spark, points), k, 4, pivots=pivots, block=block)
    assert result(got) == truth(queries, points, k, 4)


def test_defined_cases(spark):
    points = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]),
              (7, [math.nan, 0.0]), (8, [math.inf, 1.0]), (9, [0.0, 0.0])]
    got = nb.knn_join(_frame(spark, points), _frame(spark, points), 4, 2)
    assert result(got) == truth(points, points, 4, 2)
    few = nb.knn_join(_frame(spark, points[:1]), _frame(spark, points[2:3]), 4, 2)
    assert result(few) == [("1", [(5.0, "2")])]
    for q, p in ((points, []), ([], points), ([], [])):
        assert nb.knn_join(_frame(spark, q), _frame(spark, p), 4, 2).count() == 0


def test_pivots_exclude_most_cells(spark):
    """Well separated groups: a query reaches few cells beside its own."""
    rng = np.random.default_rng(3)
    hubs = rng.normal(0, 50, (16, 8))
    rows = [(i, (hubs[i % 16] + rng.normal(0, 1, 8)).tolist()) for i in range(1600)]
    met = []
    reached = nb.reached_cells

    def counted(*a):
        out = reached(*a)
        met.append(out.count())
        return out
    nb.reached_cells = counted
    try:
        got = nb.knn_join(_frame(spark, rows[:200]), _frame(spark, rows), 5, 8, pivots=16)
        assert result(got) == truth(rows[:200], rows, 5, 8)
    finally:
        nb.reached_cells = reached
    assert met[0] < 200 * 4


def test_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    got = nb.knn_join(rows.where("vec_id % 10 = 0"), rows, 5, 64)
    assert [x[0] for x in result(got)] == [x[0] for x in truth([r for r in data if r[0] % 10 == 0], data, 5, 64)]
    assert [[p for _, p in x[1]] for x in result(got)] == [[p for _, p in x[1]] for x in truth([r for r in data if r[0] % 10 == 0], data, 5, 64)]


def test_vote(spark):
    near = spark.createDataFrame([(0, 5, 1, 10, 0.1), (0, 5, 2, 11, 0.2), (0, 5, 3, 12, 0.3), (1, 5, 1, 10, 0.1), (1, 5, 2, 12, 0.1)],
                                 "n long, query long, rank int, point long, distance double")
    labels = spark.createDataFrame([(10, "b"), (11, "b"), (12, "a"), (13, None)], "vec_id long, label string")
    assert sorted(map(tuple, nb.vote(near, labels, "label").collect())) == [(0, 5, "b", 2 / 3), (1, 5, "a", 0.5)]
