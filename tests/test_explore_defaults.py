"""Exploration and feature construction cover all columns, values and groups unless fewer are asked for."""

from tessera.operators import explore as ex
from tessera.operators import prepare as pp
from tessera.plans import q_explore
from tests.conftest import SF


def test_defaults_cover_everything(spark):
    wide = spark.range(30).selectExpr("cast(id as string) AS name", "id % 2 AS y", *[f"id * {k + 1} AS c{k}" for k in range(8)])
    columns = [f"c{k}" for k in range(8)]
    assert ex.auto_features(wide, "y") == columns and ex.auto_features(wide, "y", 3) == columns[:3]
    assert ex.crosstab(wide, "name", "y").count() == 30 and ex.crosstab(wide, "name", "y", 20).count() == 20
    assert ex.scatter_density(wide, "c0", "c1", "name").select("hue").distinct().count() == 30
    assert ex.scatter_density(wide, "c0", "c1", "name", max_groups=4).select("hue").distinct().count() == 4
    made = pp.feature_chain(wide, target="y", scale=None).columns
    assert set(pp.polynomial_features(wide, columns).columns) == set(made)


def test_target_analysis_covers_every_numeric_column(spark):
    features = {r["feature"] for r in q_explore.target_analysis_lineitem(spark, SF).select("feature").distinct().collect()}
    assert features == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}
