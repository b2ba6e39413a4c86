"""Centroid clustering against a plain version, and its defined cases."""

import hashlib
import math

import numpy as np

from tessera.llm import centroids
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, v string, cluster int"


def truth(rows, size, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows
            if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c[j] for j in range(len(c))]
    last = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, d, x in last if x == j) for j in range(len(c))}
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, d, j in last), key=str)


def result(data, size, k, rounds, **settings):
    got = centroids.cluster(data, size=size, k=k, rounds=rounds, order=centroids.hash_order(), **settings)
    return sorted((tuple(r)[:6] for r in got.collect()), key=str)


def test_embeddings_equal_brute_force(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in data.collect()]
    assert result(data, 64, 40, 5) == truth(rows, 64, 40, 5)


def test_defined_cases(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 256]) for i in range(120)]  # many ties
    rows += [(5, [0.5, 0.5, 0.5, 0.5])] * 40 + [(None, [0.1, -0.1, 3.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    rows += [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 0.0, 0.0]), (204, [math.nan, 0.0, 0.0, 0.0]),
             (205, [math.inf, 0.0, 0.0, 0.0]), (206, [0.0] * 5)]
    data = spark.createDataFrame([(i, e, "clash", 3) for i, e in rows], SCHEMA)
    for k, pivots in ((1, 1), (7, 3), (300, 8)):
        assert result(data, 4, k, 3, pivots=pivots) == truth(rows, 4, k, 3)
    assert result(data.limit(0), 4, 3, 2) == []
    huge = spark.createDataFrame([(1, [3e38, -3e38, 0.0, 0.0], "c", 1), (2, [0.0] * 4, "c", 1)], SCHEMA)
    assert {r[2] for r in result(huge, 4, 1, 0)} <= {0, 2 * centroids.LIMIT ** 2}


def test_pivots_leave_out_what_cannot_win():
    rng = np.random.default_rng(8)
    hubs = rng.integers(-2000, 2000, (40, 8))
    x = hubs[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 8))
    points = centroids.choose_pivots(hubs, 8)
    which, best, measured = centroids.nearest(x, centroids.distances(x, points), hubs, centroids.distances(hubs, points))
    every = ((x[:, None, :] - hubs[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (best == every.min(1)).all()
    assert measured < 0.2 * every.size
