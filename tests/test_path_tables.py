"""Shapley values of forests by tables of passed tests: equal to scoring every coalition, without a row per coalition."""

import numpy as np
import pytest

from tessera.operators import explain as xp
from tessera.operators import model as md
from tessera.operators.prepare import fit_model_matrix


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = [(i, *map(float, r), "pqr"[i % 3], int(r[0] * r[1] + r[2] > 0.1)) for i, r in enumerate(rng.normal(size=(150, 3)))]
    return spark.createDataFrame(made, "id long, a double, b double, c double, k string, y int").cache()


def _values(df):
    return {(r["id"], r["feature"]): r["shap"] for r in df.collect()}


@pytest.fixture(scope="module", params=["classification", "regression"])
def forest(request, rows):
    target = "y" if request.param == "classification" else "a"
    matrix = fit_model_matrix(rows, target, [c for c in ("a", "b", "c", "k") if c != target])
    pm = md.fit_model(rows, matrix, "random_forest", request.param)
    return md.TrainedModel("random_forest", request.param, pm, matrix, None, classes=[0.0, 1.0] if target == "y" else None)


def test_permutation_values_equal_scored_coalitions(rows, forest, monkeypatch):
    doubled = rows.unionByName(rows.where("id < 20"))
    fast = xp.permutation_shap(forest, doubled, "id", permutations=3)
    assert "Window" not in fast._jdf.queryExecution().toString()
    fast = _values(fast)
    monkeypatch.setattr(xp, "_adds_leaves", lambda tm: False)
    slow = _values(xp.permutation_shap(forest, doubled, "id", permutations=3))
    assert fast.keys() == slow.keys() and max(abs(fast[k] - slow[k]) for k in slow) < 1e-9


def test_tables_equal_the_rows_own_terms(rows, forest):
    paths, n = xp.leaf_paths(forest.pipeline.stages[-1]), len(forest.matrix.feature_names)
    x = np.random.default_rng(1).normal(size=(40, n))
    terms = [xp._shapley_terms(p) for p in paths]
    tables = [xp._by_pattern(p, t) for p, t in zip(paths, terms)]
    assert all(t is not None for t in tables)
    assert np.allclose(xp._path_sums(x, paths, terms, tables, n), xp.path_shapley(x, paths, n), rtol=0, atol=1e-12)
    wide = xp.LeafPaths(*(np.zeros((9, 20), t) for t in (np.int64, float, float, float)), np.zeros(9))
    assert xp._by_pattern(wide, xp._shapley_terms(wide)) is None


def test_rows_are_dealt_out_by_number(rows, forest, monkeypatch):
    monkeypatch.setattr(xp, "ROWS", 50)
    every = rows.repartition(1)
    assert xp.tree_shap(forest, every, "id").rdd.getNumPartitions() == 3
    assert len(_values(xp.tree_shap(forest, every, "id"))) == 150 * len(forest.matrix.feature_names)


def test_nan_goes_right(rows, forest):
    paths, n = xp.leaf_paths(forest.pipeline.stages[-1]), len(forest.matrix.feature_names)
    x = np.random.default_rng(2).normal(size=(5, n))
    x[:, 0] = np.nan
    large = np.where(np.isnan(x), np.inf, x)
    assert np.allclose(xp.path_shapley(x, paths, n), xp.path_shapley(large, paths, n), rtol=0, atol=1e-12)
