"""Queries for evaluation metrics on a fixed score.

The score is a fixed formula of the document length so the numbers have an
exact SQL twin: score = (n_chars mod 997) / 997, label = quality.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.plans.registry import load, query

SCORED_SQL = """
WITH sc AS (SELECT l.doc_id, l.quality AS label, (d.n_chars % 997) / 997.0 AS score,
                   CASE WHEN (d.n_chars % 997) / 997.0 >= 0.5 THEN 1 ELSE 0 END AS prediction
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(spark, d):
    lab = load(spark, d, "labels")
    doc = load(spark, d, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    s = ((F.col("n_chars") % 997) / F.lit(997.0)).alias("score")
    out = j.select("doc_id", F.col("quality").alias("label"), s)
    return ev.apply_threshold(out, "score", 0.5)


@query("confusion", SCORED_SQL + " SELECT label, prediction, count(*) AS count FROM sc GROUP BY 1, 2")
def confusion(spark, d):
    """Confusion matrix (long form)."""
    return ev.confusion(scored(spark, d))


@query("metrics", SCORED_SQL + """,
c AS (SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS correct,
             sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS fn FROM sc),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT round((CASE WHEN n > 0 THEN correct / n ELSE 0 END) + sign((CASE WHEN n > 0 THEN correct / n ELSE 0 END)) * 1e-7, 4) AS accuracy, round((p) + sign((p)) * 1e-7, 4) AS precision,
       round((r) + sign((r)) * 1e-7, 4) AS recall, round((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) + sign((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)) * 1e-7, 4) AS f1 FROM pr""")
def metrics(spark, d):
    """Binary accuracy / precision / recall / F1."""
    return ev.classification_metrics(scored(spark, d))


@query("metrics_weighted", SCORED_SQL + """,
c AS (SELECT label, prediction, count(*) AS cnt FROM sc GROUP BY 1, 2),
pl AS (SELECT label, sum(cnt) AS support, sum(CASE WHEN label = prediction THEN cnt ELSE 0 END) AS tp FROM c GROUP BY 1),
pp AS (SELECT prediction AS label, sum(cnt) AS predicted FROM c GROUP BY 1),
cls AS (SELECT coalesce(pl.label, pp.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted FROM pl FULL OUTER JOIN pp ON pl.label = pp.label),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM cls),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
SELECT round((sum(tp) / sum(support)) + sign((sum(tp) / sum(support))) * 1e-7, 4) AS accuracy, round((sum(p * support) / sum(support)) + sign((sum(p * support) / sum(support))) * 1e-7, 4) AS precision,
       round((sum(r * support) / sum(support)) + sign((sum(r * support) / sum(support))) * 1e-7, 4) AS recall, round((sum(f * support) / sum(support)) + sign((sum(f * support) / sum(support))) * 1e-7, 4) AS f1 FROM f""")
def metrics_weighted(spark, d):
    """Support-weighted metrics."""
    return ev.classification_metrics(scored(spark, d), average="weighted")


@query("auc", SCORED_SQL + """,
g AS (SELECT score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM sc GROUP BY 1),
c AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM g)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
  round((sum(pos * (cum_neg - neg) + 0.5 * pos * neg) / (sum(pos) * sum(neg))) + sign((sum(pos * (cum_neg - neg) + 0.5 * pos * neg) / (sum(pos) * sum(neg)))) * 1e-7, 4) END AS auc FROM c""")
def auc(spark, d):
    """Exact ROC-AUC with ties counted half."""
    return ev.roc_auc(scored(spark, d))


@query("pr_threshold", SCORED_SQL + """,
g AS (SELECT score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM sc GROUP BY 1),
c AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
             sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
             sum(pos) OVER () AS P FROM g),
m AS (SELECT s, cp / (cp + cn) AS p, CASE WHEN P > 0 THEN cp / P ELSE 0 END AS r FROM c),
f AS (SELECT s, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT s AS threshold, round((f1) + sign((f1)) * 1e-7, 4) AS f1 FROM f ORDER BY f1 DESC, s ASC LIMIT 1""")
def pr_threshold(spark, d):
    """F1-optimal threshold from the precision-recall curve."""
    return ev.optimal_threshold(scored(spark, d))


_SWEEP_SQL = SCORED_SQL + """,
t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS threshold),
g AS (SELECT threshold, sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN score >= threshold AND label <> 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END) AS fn FROM sc, t GROUP BY 1),
m AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM g),
sw AS (SELECT threshold, round((p) + sign((p)) * 1e-7, 4) AS precision, round((r) + sign((r)) * 1e-7, 4) AS recall,
              round((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) + sign((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)) * 1e-7, 4) AS f1 FROM m)"""


@query("threshold_sweep", _SWEEP_SQL + " SELECT * FROM sw")
def threshold_sweep(spark, d):
    """Metrics at thresholds 0.3 … 0.7 computed from predictions."""
    return ev.threshold_sweep(scored(spark, d))


@query("threshold_for_recall", _SWEEP_SQL + " SELECT max(threshold) AS threshold FROM sw WHERE recall >= 0.4")
def threshold_for_recall(spark, d):
    """Highest threshold that still reaches recall 0.4."""
    return ev.threshold_for_goal(ev.threshold_sweep(scored(spark, d)), min_recall=0.4)


@query("calibration", SCORED_SQL + """
SELECT CAST(least(greatest(ceil(score * 10) - 1, 0), 9) AS INTEGER) AS bin, round((avg(score)) + sign((avg(score))) * 1e-9, 6) AS mean_predicted,
       round((avg(label)) + sign((avg(label))) * 1e-9, 6) AS fraction_positive, count(*) AS count FROM sc GROUP BY 1""")
def calibration(spark, d):
    """10-bin reliability curve (right-closed bins)."""
    return ev.calibration(scored(spark, d))[1]


@query("brier", SCORED_SQL + """
SELECT round((avg((score - label) * (score - label))) + sign((avg((score - label) * (score - label)))) * 1e-9, 6) AS brier,
       round((avg((score - label) * (score - label))) + sign((avg((score - label) * (score - label)))) * 1e-9, 6) < 0.1 AS well_calibrated FROM sc""")
def brier(spark, d):
    """Brier score."""
    return ev.calibration(scored(spark, d))[0]


@query("regression_metrics", """
SELECT round((1 - sum((o_totalprice - p) * (o_totalprice - p)) /
             (sum(o_totalprice * o_totalprice) - sum(o_totalprice) * sum(o_totalprice) / count(*))) + sign((1 - sum((o_totalprice - p) * (o_totalprice - p)) /
             (sum(o_totalprice * o_totalprice) - sum(o_totalprice) * sum(o_totalprice) / count(*)))) * 1e-7, 4) AS r2,
       round((sqrt(sum((o_totalprice - p) * (o_totalprice - p)) / count(*))) + sign((sqrt(sum((o_totalprice - p) * (o_totalprice - p)) / count(*)))) * 1e-7, 4) AS rmse
FROM (SELECT o_totalprice, o_totalprice * 0.9 + 1000 AS p FROM orders)""")
def regression_metrics(spark, d):
    """R² and RMSE of a fixed linear prediction of the order total."""
    o = load(spark, d, "orders").select("o_totalprice", (F.col("o_totalprice") * 0.9 + 1000).alias("p"))
    return ev.regression_metrics(o, "o_totalprice", "p")
