"""Queries for nearest neighbours (M10) over the embeddings: the rows whose id is divisible by 100 against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import neighbours as nb
from tessera.plans.registry import load, query, round_doubles

SIZE, K = 64, 5

_PAIRS = f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {SIZE}),
p AS (
  SELECT q.vec_id AS q, q.label AS truth, s.vec_id AS s, s.label AS label, list_distance(q.e, s.e) AS d
  FROM v AS q, v AS s WHERE q.vec_id % 100 = 0)"""


def _neighbours(spark, d, k):
    rows = load(spark, d, "embeddings")
    return rows, nb.knn_join(rows.where("vec_id % 100 = 0"), rows, k, SIZE)


@query("knn_join", _PAIRS + f"""
SELECT q AS query, row_number() OVER (PARTITION BY q ORDER BY d, s) AS rank, s AS point,
       round(d + 1e-9, 6) AS distance
FROM p QUALIFY rank <= {K}""")
def knn_join(spark, d):
    """The five nearest rows (itself among them) by Euclidean distance, found by pivots."""
    return round_doubles(_neighbours(spark, d, K)[1].drop("n"))


@query("knn_classify", _PAIRS + f""",
n AS (SELECT * FROM p WHERE q <> s QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, s) <= {K}),
c AS (SELECT q, truth, label, count(*) AS votes FROM n GROUP BY ALL)
SELECT q AS vec_id, truth AS label, label AS predicted, round(votes / {K} + 1e-9, 6) AS share
FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) = 1""")
def knn_classify(spark, d):
    """Each row's label by the vote of its five nearest others."""
    rows, near = _neighbours(spark, d, K + 1)
    voted = nb.vote(nb.without_itself(near, K), rows, "label")
    return round_doubles(voted.join(rows.select(F.col("vec_id").alias("query"), "label"), "query").select(
        F.col("query").alias("vec_id"), "label", "predicted", "share"))
