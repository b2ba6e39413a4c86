"""Rows of few groups are not shuffled by group for box statistics."""

import numpy as np
import pytest

from tessera.operators import explore as ex
from tessera.operators import ordered
from tessera.operators import quantiles as qt


@pytest.fixture
def no_automatic_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("most,hinted", [(10_000, 2), (1, 0)])
def test_rows_of_few_groups_stay_where_they_are(spark, no_automatic_broadcast, monkeypatch, most, hinted):
    rng = np.random.default_rng(2)
    made = [("ab"[i % 2] if i % 7 else None, float(x)) for i, x in enumerate(rng.normal(size=3000))]
    df, hints = spark.createDataFrame(made, "g string, x double"), []
    join = ordered.null_safe_join
    for m in (ex, qt):
        monkeypatch.setattr(m, "null_safe_join", lambda a, b, on, how="inner", small=False: hints.append(small) or join(a, b, on, how, small))
    monkeypatch.setattr(qt, "FEW_GROUPS", most)
    out = ex.box_stats(df, "x", "g")
    assert sum(hints) == hinted
    assert ("BroadcastHashJoin" in out._jdf.queryExecution().toString()) == bool(hinted)
    for r in out.collect():
        v = np.array([x for k, x in made if k == r["group"]])
        assert np.allclose([r["q1"], r["median"], r["q3"]], np.quantile(v, [0.25, 0.5, 0.75])) and r["n"] == len(v)
