"""Feature construction, imputation, encoding and scaling (E*, W1, W2)."""

import math

import pytest

from tessera.operators import prepare as pp


@pytest.fixture()
def numeric(spark):
    return spark.createDataFrame([(1.0, 10.0, 100.0, "x"), (2.0, 20.0, 200.0, "y"),
                                  (3.0, 30.0, 300.0, "x"), (4.0, 40.0, 400.0, "y")],
                                 "a double, b double, c double, label string")


def test_interaction_first_row(numeric):
    out = pp.interaction_features(numeric, [("a", "b")])
    assert out.orderBy("a").first()["a_x_b"] == 10.0


def test_polynomial_names_and_errors(numeric):
    out = pp.polynomial_features(numeric, ["a", "b"], 2)
    assert {"a^2", "a b", "b^2"} <= set(out.columns)
    with pytest.raises(ValueError):
        pp.polynomial_features(numeric, ["a", "missing"], 2)
    with pytest.raises(ValueError):
        pp.polynomial_features(numeric, ["label"], 2)
    inter = pp.polynomial_features(numeric, ["a", "b", "c"], 3, interaction_only=True)
    assert "a b c" in inter.columns and "a^2" not in inter.columns


def test_standard_scaling_population(numeric):
    out = pp.fit_scaler(numeric, ["a", "b"], "standard").transform(numeric)
    r = out.agg({"a": "avg"}).first()[0]
    assert abs(r) < 1e-12
    vals = [x["a"] for x in out.collect()]
    pop = math.sqrt(sum(v * v for v in vals) / len(vals))
    assert abs(pop - 1.0) < 1e-12


def test_robust_and_minmax(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    sc = pp.fit_scaler(df, ["x"], "robust")
    q1, med, q3 = sc.params["x"]
    assert (q1, med, q3) == (1.75, 3.0, 5.5)
    mm = pp.fit_scaler(df, ["x"], "minmax").transform(df).agg({"x": "max"}).first()[0]
    assert mm == 1.0


def test_impute_strategies_and_errors(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, None, "b")],
                               "id bigint, v double, s string")
    out, rep = pp.handle_missing(df, {"v": "mean", "s": "mode", "zz": "mean", "id": "bogus"})
    rows = {r["id"]: r for r in out.collect()}
    assert rows[2]["v"] == 2.0 and rows[3]["s"] == "b"
    assert any("not found" in e for e in rep.errors) and any("unknown strategy" in e for e in rep.errors)
    _, rep2 = pp.handle_missing(df, {"s": "mean"})
    assert rep2.errors


def test_fill_forward_backward(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 4.0), (5, None)], "t bigint, v double")
    f = {r["t"]: r["v"] for r in pp.fill_along(df, ["v"], ["t"], partitions=3).collect()}
    assert f == {1: 1.0, 2: 1.0, 3: 1.0, 4: 4.0, 5: 4.0}
    b = {r["t"]: r["v"] for r in pp.fill_along(df, ["v"], ["t"], backward=True, partitions=3).collect()}
    assert b == {1: 1.0, 2: 4.0, 3: 4.0, 4: 4.0, 5: None}


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    oh = pp.fit_encoder(df, "s", "one_hot").transform(df)
    assert oh.columns == ["s_a", "s_b", "s_c"]
    assert [tuple(r) for r in oh.collect()][2] == (0, 0, 0)
    lab = [r["s"] for r in pp.fit_encoder(df, "s", "label").transform(df).collect()]
    assert lab == [1, 0, None, 2]
    enc = pp.fit_encoder(df, "s", "ordinal")
    new = spark.createDataFrame([("zzz",), (None,)], "s string")
    assert [r["s"] for r in enc.transform(new).collect()] == [-1, enc.categories.index("nan")]


def test_step_chain_replays(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a")], "x double, s string")
    chain = pp.StepChain([pp.Step("impute", ["x"], "median"), pp.Step("encode", ["s"], "label"),
                          pp.Step("scale", ["x"], "minmax")]).fit(train)
    test = spark.createDataFrame([(None, "b")], "x double, s string")
    r = chain.transform(test).first()
    assert r["x"] == 0.5 and r["s"] == 1


def test_change_log_counts(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, "b"), (3, None, None)], "id bigint, v double, s string")
    out, rep = pp.handle_missing(df, {"v": "mean", "s": "drop"})
    log = {c["column"]: c for c in rep.changes}
    assert log["v"]["n_filled"] == 2 and log["s"]["n_removed"] == 2
    assert out.count() == 1


def test_polynomial_tool_errors(numeric):
    out, errs = pp.create_polynomial_features(numeric, ["a", "missing"], 2)
    assert out is not None and "a^2" in out.columns and errs == ["column not found: missing"]
    none, errs = pp.create_polynomial_features(numeric, ["label"], 2)
    assert none is None and errs


def test_correlation_matrix_equals_numpy(spark):
    import numpy as np
    from tessera.operators import explore
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x[:, 1] += x[:, 0]
    rows = [(*map(float, r), 7.0) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(6)))
    got = {(r["row"], r["col"]): r["r"] for r in explore.correlation_matrix(df).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 36
    assert all(abs(got[f"c{i}", f"c{j}"] - want[i, j]) < 1e-9 for i in range(5) for j in range(5))
    assert all(got["c5", f"c{i}"] is None for i in range(6))  # a constant column
