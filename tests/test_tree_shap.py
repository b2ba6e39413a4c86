"""Exact Shapley values of tree models against enumerating all subsets of features."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import explain as xp
from tessera.operators import model as md
from tessera.operators.prepare import fit_model_matrix


def _worth(paths, row, known):
    """The ensemble's expectation when only the features in ``known`` are known."""
    total = 0.0
    for p in paths:
        for f, lo, hi, z, v in zip(p.feature, p.low, p.high, p.share, p.value):
            for j, a, b, s in zip(f, lo, hi, z):
                v = v * (float(a < row[j] <= b) if j in known else s)
            total += v
    return total


def _enumerated(paths, row, n):
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                       * (_worth(paths, row, {*s, i}) - _worth(paths, row, set(s)))
                       for k in range(n) for s in combinations(rest, k)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = [(i, *map(float, rng.normal(size=4))) for i in range(300)]
    made = [(*r, int(r[1] * r[2] + r[3] > 0.2), r[1] * r[2] - 2 * r[4]) for r in rows]
    return spark.createDataFrame(made, "id long, a double, b double, c double, d double, y int, z double")


def _fit(data, matrix, kind, task, params):
    """A small model."""
    build = md.build_estimator
    md.build_estimator = lambda mt, tk, n, w, p=None: build(mt, tk, n, w, dict(params))
    try:
        return md.fit_model(data, matrix, kind, task)
    finally:
        md.build_estimator = build


@pytest.mark.parametrize("kind,target,task,params", [
    ("random_forest", "y", "classification", {"numTrees": 8, "maxDepth": 4}), ("gradient_boosting", "y", "classification", {"maxIter": 6, "maxDepth": 3}),
    ("random_forest", "z", "regression", {"numTrees": 5, "maxDepth": 6}), ("gradient_boosting", "z", "regression", {"maxIter": 5, "maxDepth": 3})])
def test_equals_enumeration_and_adds_up(spark, data, kind, target, task, params):
    matrix = fit_model_matrix(data, target, ["a", "b", "c", "d"])
    pm = _fit(data, matrix, kind, task, params)
    tm = md.TrainedModel(kind, task, pm, matrix, None, classes=[0.0, 1.0] if task == "classification" else None)
    shap = {}
    for r in xp.tree_shap(tm, data, "id").collect():
        shap.setdefault(r["id"], {})[r["feature"]] = r["shap"]
    scored = tm.predict_keep(data, ["id"])
    if task == "regression":
        out = {r["id"]: r["prediction"] for r in scored.collect()}
    elif kind == "random_forest":
        out = {r["id"]: r["score"] for r in scored.collect()}
    else:
        out = {r["id"]: r["margin"] for r in scored.select("id", vector_to_array("rawPrediction")[1].alias("margin")).collect()}
    base = xp.tree_base(tm)
    assert len(shap) == 300 and max(abs(sum(shap[i].values()) + base - out[i]) for i in out) < 1e-6
    paths = xp.leaf_paths(pm.stages[-1])
    rows = {r["id"]: [r[c] for c in "abcd"] for r in data.limit(6).collect()}
    for i, row in rows.items():
        assert np.allclose([shap[i][c] for c in "abcd"], _enumerated(paths, row, 4), atol=1e-9)
    assert abs(_worth(paths, rows[next(iter(rows))], set()) - base) < 1e-9


def test_features_that_no_tree_uses_get_nothing(spark, data):
    matrix = fit_model_matrix(data.withColumn("flat", F.lit(1.0)), "y", ["a", "b", "flat"])
    pm = _fit(data.withColumn("flat", F.lit(1.0)), matrix, "random_forest", "classification", {"numTrees": 5})
    tm = md.TrainedModel("random_forest", "classification", pm, matrix, 0.5, classes=[0.0, 1.0])
    mean = {r["feature"]: r["mean_abs_shap"] for r in xp.mean_abs_shap(xp.tree_shap(tm, data.withColumn("flat", F.lit(1.0)), "id")).collect()}
    assert mean["flat"] == 0 and set(mean) == {"a", "b", "flat"}


def test_waterfall_of_given_rows(spark, data):
    matrix = fit_model_matrix(data, "y", ["a", "b", "c", "d"])
    pm = md.fit_model(data, matrix, "logistic_regression", "classification")
    tm = md.TrainedModel("logistic_regression", "classification", pm, matrix, 0.5, classes=[0.0, 1.0])
    every = {(r["id"], r["feature"]): r["shap"] for r in xp.linear_shap(tm, data, "id").collect()}
    some = xp.linear_shap(tm, data, "id", data.orderBy("id").limit(3)).collect()
    assert len(some) == 12 and all(abs(every[r["id"], r["feature"]] - r["shap"]) < 1e-12 for r in some)
