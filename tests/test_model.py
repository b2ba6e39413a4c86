"""Model layer on the reference's fixture shapes."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import explain as xp
from tessera.operators import model as md


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(42)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, (a, b, c, t) in enumerate(zip(
        rng.normal(0, 1, 200), rng.normal(5, 2, 200), rng.normal(-1, 0.5, 200), rng.integers(0, 2, 200)))]
    return spark.createDataFrame(rows, "id bigint, feat_a double, feat_b double, feat_c double, target bigint")


def test_task_type(binary):
    assert md.task_type(binary, "target") == "classification"
    assert md.task_type(binary, "feat_a") == "regression"


def test_split_exact_and_reproducible(binary):
    s1 = md.split_random(binary, "target", ["id"])
    s2 = md.split_random(binary, "target", ["id"])
    a = {r["id"]: r["split"] for r in s1.collect()}
    assert a == {r["id"]: r["split"] for r in s2.collect()}
    per = {(r["target"], r["split"]): r["n"] for r in s1.groupBy("target", "split").agg(F.count("*").alias("n")).collect()}
    for t in (0, 1):
        n = sum(v for (tt, _), v in per.items() if tt == t)
        assert per[(t, "train")] == int(n * 0.7)


def test_temporal_split_order(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, date date, feat_a double, target bigint")
    s = md.split_temporal(df, "date", ["id"], "target")
    g = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in
         s.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n")).collect()}
    assert g["train"][2] == 140 and g["validation"][2] == 30 and g["test"][2] == 30
    assert g["train"][1] < g["validation"][0] and g["validation"][1] < g["test"][0]


def test_unknown_type_and_user_threshold(binary):
    res, models = md.train_compare(binary, "target", ["id"], ["logistic_regression", "no_such_model"],
                                   threshold=0.3)
    err = res.where(F.col("model_type") == "no_such_model").collect()
    assert len(err) == 1 and err[0]["error"] == -1.0
    lr = res.where(F.col("model_type") == "logistic_regression").collect()
    assert {r["split"] for r in lr} == {"train", "validation", "test"}
    assert all(r["threshold_method"] == "user_specified" and r["threshold"] == 0.3 for r in lr)
    assert res.where("is_best").first()["model_type"] == "logistic_regression"


def test_linear_shap_additive_and_persist(spark, binary):
    res, models = md.train_compare(binary, "target", ["id"], ["logistic_regression"])
    tm = models["logistic_regression"]
    shap = xp.linear_shap(tm, binary, "id")
    sums = {r["id"]: r["s"] for r in shap.groupBy("id").agg(F.sum("shap").alias("s")).collect()}
    margin = {r["id"]: r["m"] for r in tm.predict_keep(binary, ["id"]).select(
        "id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    means = binary.agg(*[F.avg(c).alias(c) for c in ("feat_a", "feat_b", "feat_c")]).first()
    coef = tm.pipeline.stages[-1].coefficients.toArray()
    base = float(tm.pipeline.stages[-1].intercept + sum(coef[i] * means[c] for i, c in
                                                        enumerate(tm.matrix.feature_names)))
    for k in list(sums)[:20]:
        assert abs(sums[k] - (margin[k] - base)) < 1e-6
    path = md.TrainedModel.save(tm, tempfile.mkdtemp(prefix="tessera-model-"))
    again = md.load_model(path)
    a = [r["score"] for r in tm.predict(binary).orderBy("feat_a").collect()]
    b = [r["score"] for r in again.predict(binary).orderBy("feat_a").collect()]
    assert np.allclose(a, b)
    top = xp.waterfall(shap, "id", rows=2, top=2)
    assert top.select("id").distinct().count() == 2
