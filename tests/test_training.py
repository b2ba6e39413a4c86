"""Training on targets of every kind, class weights, splits and wide categories."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.operators import model as md
from tessera.operators import prepare as pr


def _frame(spark, n, target, kind, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), "pq"[int(c)]) for i, (a, b, c) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 2, n)))]
    return spark.createDataFrame([(*r, target(r)) for r in rows], f"id long, a double, b double, c string, y {kind}")


def _splits(df):
    return {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_continuous_targets_are_not_stratified(spark):
    df = _frame(spark, 60, lambda r: 3 * r[1] - 2 * r[2] + 5, "double")
    assert _splits(md.split_random(df, "y", ["id"])) == {"train": 42, "validation": 9, "test": 9}


def test_regression(spark):
    df = _frame(spark, 300, lambda r: 3 * r[1] - 2 * r[2] + 5, "double")
    res, models = md.train_compare(df, "y", ["id"], ["logistic_regression", "svm", "knn", "random_forest"])
    test = {r["model_type"]: r for r in res.where("split = 'test'").collect()}
    assert set(test) == set(models) and test["logistic_regression"]["r2"] > 0.999 and test["svm"]["r2"] > 0.99
    assert test["knn"]["r2"] > 0.8 and all(r["accuracy"] is None for r in test.values())
    assert res.where("is_best").select("model_type").distinct().first()[0] in ("logistic_regression", "svm")


def test_three_classes(spark):
    df = _frame(spark, 400, lambda r: ["low", "mid", "top"][(r[1] > -0.5) + (r[1] > 0.5)], "string")
    res, models = md.train_compare(df, "y", ["id"], ["random_forest", "svm", "knn"])
    rows = {r["model_type"]: r for r in res.where("split = 'test'").collect()}
    assert set(rows) == set(models) and rows["random_forest"]["f1"] > 0.9 and rows["random_forest"]["auc"] > 0.95
    assert all(r["auc"] is not None and r["threshold"] is None for r in rows.values())
    tm = models["random_forest"]
    pred = tm.predict(df).withColumnRenamed("y", "label")
    again = ev.classification_metrics(pred, "label", "prediction", average="weighted").first()
    assert again["accuracy"] > 0.9 and {r[0] for r in pred.select("prediction").distinct().collect()} == {0.0, 1.0, 2.0}
    imp = {r["feature"]: r["importance"] for r in md.feature_importance(models["svm"]).collect()}     # one model per class
    assert max(imp, key=imp.get) == "a" and imp["a"] > 0


@pytest.mark.parametrize("mt", ["logistic_regression", "svm", "knn"])
def test_labels_one_and_two(spark, mt):
    df = _frame(spark, 300, lambda r: 1 + int(r[1] + r[2] > 0), "int")
    res, models = md.train_compare(df, "y", ["id"], [mt])
    test = res.where("split = 'test'").first()
    assert test["f1"] > 0.85 and test["accuracy"] > 0.85 and test["auc"] > 0.9
    tm = models[mt]
    assert {r[0] for r in tm.predict(df).select("prediction").distinct().collect()} == {1.0, 2.0}
    got = tm.predict_keep(df, ["id"])
    assert got.where((F.col("score") >= tm.threshold) != (F.col("prediction") == 2.0)).count() == 0
    path = tm.save(tempfile.mkdtemp(prefix="tessera-model-"))
    a = {r["id"]: (r["score"], r["prediction"]) for r in got.collect()}
    assert a == {r["id"]: (r["score"], r["prediction"]) for r in md.load_model(path).predict_keep(df, ["id"]).collect()}


def test_rare_classes_weigh_more(spark):
    df = _frame(spark, 600, lambda r: int(r[1] + 0.8 * r[2] + r[0] * 37 % 100 / 50 > 3.2), "int")
    matrix = pr.fit_model_matrix(df, "y", ["a", "b"])
    weighted = md.class_weights(df, "y", name="w")
    assert weighted.select("w").distinct().count() == 2
    plain, heavy = (md.fit_model(weighted, matrix, "logistic_regression", "classification", 2, weight_col=w) for w in (None, "w"))
    found = [m.transform(matrix.transform(df)).where("prediction = 1").count() for m in (plain, heavy)]
    assert found[1] > found[0]
    met = []
    fit = md.fit_model
    md.fit_model = lambda train, *a, **k: met.append(train.select(k["weight_col"]).distinct().count()) or fit(train, *a, **k)
    try:
        md.train_compare(df, "y", ["id"], ["logistic_regression"], ["a", "b"])
    finally:
        md.fit_model = fit
    assert met == [2]


def test_auto_split(spark):
    base = _frame(spark, 100, lambda r: int(r[1] > 0), "int")
    assert _splits(md.split_auto(base, "y", ["id"])) == _splits(md.split_random(base, "y", ["id"]))
    dated = base.withColumn("order_date", F.expr("date_format(date_add(date'2020-01-01', int(100 - id)), 'yyyy-MM-dd')"))
    s = md.split_auto(dated, "y", ["id"])
    assert _splits(s) == {"train": 70, "validation": 15, "test": 15} and s.columns == [*dated.columns, "split"]
    assert s.where("split = 'train'").agg(F.max("order_date")).first()[0] < s.where("split = 'validation'").agg(F.min("order_date")).first()[0]
    res, _ = md.train_compare(dated, "y", ["id"], ["logistic_regression"], ["a", "b"], split="auto")
    assert res.where("error is not null").count() == 0


def test_wide_categories_equal_the_dense_form(spark):
    rows = [(i, f"v{i * 7 % 13:02d}" if i % 11 else None, float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    fresh = spark.createDataFrame([(900, "v01", 1.0), (901, "unseen", 1.0), (902, None, 1.0)], "id long, c string, y double")
    for method in ("label", "ordinal", "target"):
        few = pr.fit_encoder(df, "c", method, "y")
        wide = pr.fit_encoder(df, "c", method, "y", max_categories=3)
        assert few.table is None and wide.table is not None
        for part in (df, fresh):
            assert sorted(map(tuple, few.transform(part).collect()), key=str) == sorted(map(tuple, wide.transform(part).select(*part.columns).collect()), key=str)
    from pyspark.ml.functions import vector_to_array
    for drop in (False, True):
        few = pr.fit_encoder(df, "c", "one_hot", drop_first=drop)
        wide = pr.fit_encoder(df, "c", "one_hot", max_categories=3, drop_first=drop)
        assert few.names() == wide.names()
        for part in (df, fresh):
            a = {r["id"]: [r[n] for n in few.names()] for r in few.transform(part).collect()}
            b = {r["id"]: r["v"] for r in wide.transform(part).select("id", vector_to_array(wide.vector).alias("v")).collect()}
            assert a == b


def test_wide_model_equals_the_dense_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), f"v{int(rng.integers(0, 30))}") for i in range(500)]
    df = spark.createDataFrame([(*r, int(r[1] + (r[2] < "v2") > 0.5)) for r in rows], "id long, a double, c string, y int")
    dense, wide = pr.fit_model_matrix(df, "y", ["a", "c"]), pr.fit_model_matrix(df, "y", ["a", "c"], max_categories=5)
    assert dense.feature_names == wide.feature_names and wide.inputs == ["a", "c_onehot"]
    one, two = (md.fit_model(df, m, "logistic_regression", "classification") for m in (dense, wide))
    assert np.allclose(one.stages[-1].coefficients.toArray(), two.stages[-1].coefficients.toArray(), atol=1e-4)
    tm = md.TrainedModel("logistic_regression", "classification", two, wide, 0.5, classes=[0.0, 1.0])
    again = md.load_model(tm.save(tempfile.mkdtemp(prefix="tessera-model-")))
    a = {r["id"]: r["score"] for r in tm.predict_keep(df, ["id"]).collect()}
    assert a == {r["id"]: r["score"] for r in again.predict_keep(df, ["id"]).collect()}
    assert md.feature_importance(tm).count() == len(wide.feature_names)


def test_a_hundred_thousand_categories(spark):
    df = spark.range(120_000).select("id", F.concat(F.lit("k"), (F.col("id") % 100_000).cast("string")).alias("c"),
                                     (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    matrix = pr.fit_model_matrix(df, "y", ["a", "c"])
    assert matrix.encoders[0].size == 100_000
    model = md.fit_model(df, matrix, "logistic_regression", "classification")
    tm = md.TrainedModel("logistic_regression", "classification", model, matrix, 0.5, classes=[0.0, 1.0])
    assert tm.predict_keep(df, ["id"]).where("prediction = id % 2").count() > 119_000
