"""Fits over few partitions: as many as the rows ask for, the rows drawn as before."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator

from tessera.operators import model as md
from tessera.operators.prepare import fit_model_matrix


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(i, float(a), float(b), int(a + b > 0.1)) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    return spark.createDataFrame(made, "id long, a double, b double, y int").repartition(12, "id").sortWithinPartitions("id").cache()


def _seen(monkeypatch):
    met, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: met.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    return met


def test_partitions_follow_the_rows(rows, monkeypatch):
    matrix, met = fit_model_matrix(rows, "y", ["a", "b"]), _seen(monkeypatch)
    md.fit_model(rows, matrix, "logistic_regression", "classification", 2)
    forest = md.fit_model(rows, matrix, "random_forest", "classification", 2)
    monkeypatch.setattr(md, "ROWS", 60)
    md.fit_model(rows, matrix, "svm", "classification", 2)
    assert met == [1, 12, 4]
    plain = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), md.build_estimator("random_forest", "classification")])
    assert forest.stages[-1].toDebugString.partition("\n")[2] == plain.fit(
        matrix.transform(rows).withColumnRenamed("y", "label")).stages[-1].toDebugString.partition("\n")[2]


def test_search_draws_the_same_folds(rows, monkeypatch):
    matrix, met, folds = fit_model_matrix(rows, "y", ["a", "b"]), _seen(monkeypatch), []
    k_fold = CrossValidator._kFold

    def seen(self, df):
        out = k_fold(self, df)
        folds.append([sorted(r["a"] for r in part.collect()) for _, part in out])
        return out

    monkeypatch.setattr(CrossValidator, "_kFold", seen)
    grid = md.param_grid
    monkeypatch.setattr(md, "param_grid", lambda est, kind: grid(est, kind, 2))
    md.fit_model(rows, matrix, "logistic_regression", "classification", 2, search=True)
    assert met == [1]
    est = md.build_estimator("logistic_regression", "classification")
    cv = CrossValidator(estimator=est, estimatorParamMaps=md.param_grid(est, "logistic_regression"),
                        evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=3, seed=md.SEED)
    cv._kFold(matrix.transform(rows))
    assert folds[0] == folds[1] and sum(map(len, folds[0])) == 240
