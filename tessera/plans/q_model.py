"""Queries for splits, training, scoring and explanations.

Model outputs have no SQL twin (MLlib fits); they get rows-only checks and
property tests.  Splits and weights are exact and have DuckDB twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import explain as xp
from tessera.operators import model as md
from tessera.plans.registry import load, query, round_doubles
from tessera.session import scratch_path


def doc_features(spark, d):
    """labels ⋈ documents with text measures computed from the whole texts."""
    lab = load(spark, d, "labels")
    doc = load(spark, d, "documents")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", "quality", "toxic", "n_chars",
                    F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"),
                    F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
                    "lang", "source")


FEATURES = ["n_chars", "n_words", "n_lines", "lang", "source"]


@query("split_time", """
SELECT o_orderkey, o_orderdate,
  CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.7) THEN 'train'
       WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.85) THEN 'validation'
       ELSE 'test' END AS split
FROM orders""")
def split_time(spark, d):
    """Chronological 70/15/15 split by position (ties on the key)."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return md.split_temporal(o, "o_orderdate", ["o_orderkey"])


@query("split_random")
def split_random(spark, d):
    """M2: reproducible stratified 70/15/15 split of the labelled documents."""
    return md.split_random(doc_features(spark, d), "quality", ["doc_id"])


@query("split_counts", """
WITH c AS (SELECT quality, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)
SELECT quality, 'train' AS split, CAST(floor(n * 0.7) AS BIGINT) AS count FROM c
UNION ALL SELECT quality, 'validation', CAST(floor(n * 0.85) - floor(n * 0.7) AS BIGINT) FROM c
UNION ALL SELECT quality, 'test', CAST(n - floor(n * 0.85) AS BIGINT) FROM c""")
def split_counts(spark, d):
    """M2: exact per-class sizes of the stratified split."""
    s = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    return s.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("count"))


@query("class_weights", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
s AS (SELECT sum(n) AS n_all, count(*) AS k, min(n) AS mn, max(n) AS mx FROM c)
SELECT l.doc_id, l.toxic, round((CASE WHEN mn / mx < 0.2 THEN n_all / (k * c.n) ELSE 1.0 END) + sign((CASE WHEN mn / mx < 0.2 THEN n_all / (k * c.n) ELSE 1.0 END)) * 1e-9, 6) AS weight
FROM labels l JOIN c ON l.toxic = c.toxic, s""")
def class_weights(spark, d):
    """M4: balanced class weights for the imbalanced toxic label."""
    lab = load(spark, d, "labels").select("doc_id", "toxic")
    return round_doubles(md.class_weights(lab, "toxic"))


@query("train_compare")
def train_compare(spark, d):
    """Task type, six model types (and an unknown one →
    error row), metrics on three splits, F1-optimal thresholds, best flag."""
    res, _ = md.train_compare(doc_features(spark, d), "quality", ["doc_id"],
                              list(md.MODEL_TYPES) + ["no_such_model"], FEATURES)
    return res


def _lr(spark, d):
    data = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    res, models = md.train_compare(data, "quality", ["doc_id"], ["logistic_regression"], FEATURES,
                                   split_col="split")
    return data, models["logistic_regression"]


@query("predict")
def predict(spark, d):
    """Persist the model (pipeline + metadata) to the shared
    folder, load it back and score every document (labelled or not) with the
    columns aligned to the trained schema."""
    data, tm = _lr(spark, d)
    path = md.TrainedModel.save(tm, scratch_path(spark, "model"))
    loaded = md.load_model(path)
    doc = load(spark, d, "documents")
    feats = doc.select("doc_id", "n_chars", F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"),
                       F.size(F.split("text", "\n")).cast("double").alias("n_lines"), "lang", "source")
    return loaded.predict_keep(feats.withColumn("quality", F.lit(None).cast("int")), ["doc_id"]).select(
        "doc_id", "score", "prediction")


@query("importance")
def importance(spark, d):
    """Model feature importance (random forest)."""
    data = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    _, models = md.train_compare(data, "quality", ["doc_id"], ["random_forest"], FEATURES, split_col="split")
    return md.feature_importance(models["random_forest"])


@query("shap_linear")
def shap_linear(spark, d):
    """Exact linear Shapley values over all rows, mean |value| per feature."""
    data, tm = _lr(spark, d)
    return xp.mean_abs_shap(xp.linear_shap(tm, data, "doc_id"))


@query("shap_permutation")
def shap_permutation(spark, d):
    """Permutation Shapley (all rows × 10 orderings) for a forest."""
    data = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    _, models = md.train_compare(data, "quality", ["doc_id"], ["random_forest"], FEATURES, split_col="split")
    return xp.mean_abs_shap(xp.permutation_shap(models["random_forest"], data, "doc_id"))


@query("waterfall")
def waterfall(spark, d):
    """Top-15 terms of the first three rows, rest as 'other'; only those rows are explained."""
    data, tm = _lr(spark, d)
    first = data.orderBy("doc_id").limit(3)
    return xp.waterfall(xp.linear_shap(tm, data, "doc_id", first), "doc_id")


def _forest(spark, d):
    data = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    _, models = md.train_compare(data, "quality", ["doc_id"], ["random_forest"], FEATURES, split_col="split")
    return data, models["random_forest"]


@query("shap_tree")
def shap_tree(spark, d):
    """Exact Shapley values of a forest for all rows, mean |value| per feature."""
    data, tm = _forest(spark, d)
    return xp.mean_abs_shap(xp.tree_shap(tm, data, "doc_id"))


@query("shap_tree_sums", """
SELECT doc_id, count(*) AS n_rows, true AS adds_up FROM labels JOIN documents USING (doc_id) GROUP BY doc_id""")
def shap_tree_sums(spark, d):
    """Whether each row's values add up to its score less the base value, within 1e-6."""
    data, tm = _forest(spark, d)
    sums = xp.tree_shap(tm, data, "doc_id").groupBy("doc_id").agg(F.sum("shap").alias("total"))
    scored = tm.predict_keep(data, ["doc_id"]).select("doc_id", "score")
    base = xp.tree_base(tm)
    return scored.join(sums, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("total") + base - F.col("score")) < 1e-6).alias("adds_up"))


@query("learning_curve")
def learning_curve(spark, d):
    """Five train sizes × five hash folds over the fallback feature
    set (every numeric column but the target and the key)."""
    from tessera.operators.rules import fallback_features
    data = doc_features(spark, d)
    feats = [c for c in fallback_features(data, "quality") if c != "doc_id"]
    return md.learning_curve(data.select("doc_id", "quality", *feats), "quality", ["doc_id"])


@query("model_card")
def model_card(spark, d):
    """One-row model card."""
    data = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    res, models = md.train_compare(data, "quality", ["doc_id"], ["logistic_regression"], FEATURES,
                                   split_col="split")
    return md.model_card(models["logistic_regression"], res, data, "quality")


@query("search_train")
def search_train(spark, d):
    """Randomised search (≤ 10 sampled maps × 3 folds, CrossValidator)
    for logistic regression and a forest, metrics on three splits."""
    data = md.split_random(doc_features(spark, d), "quality", ["doc_id"])
    res, _ = md.train_compare(data, "quality", ["doc_id"], ["logistic_regression", "random_forest"], FEATURES,
                              search=True, split_col="split")
    return res
