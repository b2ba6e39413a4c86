"""Evaluation from predictions.

Every metric is an aggregation over (label, prediction) or (label, score)
counts: exact at any size, and the same arithmetic a SQL engine does, so
each has an oracle.  Curves run over DISTINCT scores with range-partitioned
running sums — never a single-partition window over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import stable_round as sround
from tessera.operators.ordered import running_sum


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction) in long form."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           positive=1, average: str = "binary") -> DataFrame:
    """Accuracy, precision, recall, F1 (binary for ``positive``, or
    support-weighted), 4 places, zero division → 0.  One grouped count."""
    c = confusion(df, label, prediction)
    if average == "binary":
        pos = F.lit(positive)
        one = c.agg(
            F.sum("count").alias("n"),
            F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("correct"),
            F.sum(F.when((F.col("label") == pos) & (F.col("prediction") == pos), F.col("count")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("label") != pos) & (F.col("prediction") == pos), F.col("count")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("label") == pos) & (F.col("prediction") != pos), F.col("count")).otherwise(0)).alias("fn"))
        p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
        r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
        return one.select(
            sround(_safe_div(F.col("correct"), F.col("n")), 4).alias("accuracy"),
            sround(p, 4).alias("precision"), sround(r, 4).alias("recall"),
            sround(_safe_div(2 * p * r, p + r), 4).alias("f1"))
    # weighted over classes
    per_label = c.groupBy("label").agg(F.sum("count").alias("support"),
                                       F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count"))
                                             .otherwise(0)).alias("tp"))
    per_pred = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    cls = per_label.join(per_pred, "label", "full").fillna(0)
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    f = _safe_div(2 * p * r, p + r)
    one = cls.agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"),
                  F.sum(p * F.col("support")).alias("wp"), F.sum(r * F.col("support")).alias("wr"),
                  F.sum(f * F.col("support")).alias("wf"))
    return one.select(sround(_safe_div(F.col("correct"), F.col("n")), 4).alias("accuracy"),
                      sround(_safe_div(F.col("wp"), F.col("n")), 4).alias("precision"),
                      sround(_safe_div(F.col("wr"), F.col("n")), 4).alias("recall"),
                      sround(_safe_div(F.col("wf"), F.col("n")), 4).alias("f1"))


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == F.lit(positive), 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) != F.lit(positive), 1).otherwise(0)).cast("bigint").alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Exact ROC-AUC, ties counted half (the Mann-Whitney statistic),
    from counts per distinct score and a running count of negatives."""
    sc = _score_counts(df, label, score, positive)
    cum = running_sum(sc, [F.col("s")], ["neg"])
    one = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                  F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("pos") * F.col("neg")).alias("u"))
    return one.select(F.when((F.col("P") > 0) & (F.col("N") > 0), sround(F.col("u") / (F.col("P") * F.col("N")), 4))
                      .alias("auc"))


def multiclass_auc(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """M13 multiclass: mean one-vs-rest AUC over the classes in ``score_cols``
    (class value → column with that class's score)."""
    parts = [roc_auc(df, label, col, cls) for cls, col in score_cols.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(sround(F.avg("auc"), 4).alias("auc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R² and RMSE from sums."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    one = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"),
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return one.select(sround(F.when(sst > 0, 1 - F.col("sse") / sst), 4).alias("r2"),
                      sround(F.sqrt(F.col("sse") / F.col("n")), 4).alias("rmse"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Precision / recall / F1 at every distinct score used as threshold
    (predict positive when score ≥ threshold)."""
    sc = _score_counts(df, label, score, positive)
    cum = running_sum(sc, [F.col("s").desc()], ["pos", "neg"])
    total_pos = sc.agg(F.sum("pos")).first()[0] or 0      # one number, applied as a literal
    j = cum
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    rec = _safe_div(F.col("cum_pos"), F.lit(total_pos))
    return j.select(F.col("s").alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                    _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def optimal_threshold(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Threshold with the highest F1; the first maximum in ascending
    threshold order (a TakeOrdered of one row)."""
    return (pr_curve(df, label, score, positive).orderBy(F.desc("f1"), F.asc("threshold")).limit(1)
            .select(F.col("threshold"), sround("f1", 4).alias("f1")))


def apply_threshold(df: DataFrame, score: str, threshold: float, name: str = "prediction") -> DataFrame:
    """Label 1 when score ≥ threshold."""
    return df.withColumn(name, F.when(F.col(score) >= F.lit(threshold), 1).otherwise(0))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    thresholds=(0.3, 0.4, 0.5, 0.6, 0.7), positive=1) -> DataFrame:
    """Precision, recall, F1 at fixed thresholds, computed from the
    predictions (each row meets each of the few thresholds once, inside the
    partial aggregation)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    e = df.where(F.col(score).isNotNull()).select(t, F.col(score).alias("s"), F.col(label).alias("y"))
    g = e.groupBy("threshold").agg(
        F.sum(F.when((F.col("s") >= F.col("threshold")) & (F.col("y") == positive), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("s") >= F.col("threshold")) & (F.col("y") != positive), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("s") < F.col("threshold")) & (F.col("y") == positive), 1).otherwise(0)).alias("fn"))
    p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("threshold", sround(p, 4).alias("precision"), sround(r, 4).alias("recall"),
                    sround(_safe_div(2 * p * r, p + r), 4).alias("f1"))


def threshold_for_goal(sweep: DataFrame, min_recall: float | None = None,
                       min_precision: float | None = None) -> DataFrame:
    """Highest threshold reaching ``min_recall``, or lowest reaching
    ``min_precision`` (re-aimed from fixed per-use-case constants)."""
    if min_recall is not None:
        return sweep.where(F.col("recall") >= min_recall).agg(F.max("threshold").alias("threshold"))
    return sweep.where(F.col("precision") >= min_precision).agg(F.min("threshold").alias("threshold"))


def calibration(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10,
                hist_bins: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brier score (well calibrated below 0.1), the reliability curve
    over ``bins`` right-closed bins, and a ``hist_bins`` score histogram."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    data = df.where(s.isNotNull() & y.isNotNull())
    brier = data.agg(sround(F.avg((s - y) * (s - y)), 6).alias("brier")).withColumn(
        "well_calibrated", F.col("brier") < 0.1)
    b = F.least(F.greatest(F.ceil(s * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    curve = data.groupBy(b.alias("bin")).agg(sround(F.avg(s), 6).alias("mean_predicted"),
                                             sround(F.avg(y), 6).alias("fraction_positive"),
                                             F.count(F.lit(1)).alias("count"))
    hb = F.least(F.floor(s * hist_bins), F.lit(hist_bins - 1)).cast("int")
    hist = data.groupBy(hb.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return brier, curve, hist


def fit_diagnosis(train_score: float, test_score: float, metric: str = "f1",
                  gap: float = 0.10) -> str:
    """Overfitting when train − test > gap; underfitting when both are
    low (< 0.60 for F1, < 0 for R²); else good fit."""
    low = 0.60 if metric != "r2" else 0.0
    if train_score is None or test_score is None:
        return "unknown"
    if train_score - test_score > gap:
        return "overfitting"
    if train_score < low and test_score < low:
        return "underfitting"
    return "good_fit"


def fit_diagnosis_col(train, test, metric: str = "f1", gap: float = 0.10):
    """M18 as a column expression over joined train/test metric rows."""
    low = 0.60 if metric != "r2" else 0.0
    return (F.when(train - test > gap, "overfitting")
            .when((train < low) & (test < low), "underfitting").otherwise("good_fit"))


def rank_window(partition: list[str], order):
    return Window.partitionBy(*partition).orderBy(order)
