"""Exact quantiles (sketched bands, counted inside) vs numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles as qt
from tessera.operators.explore import box_stats

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    hot = np.full(7000, 42.0)                       # one value holds a third of the rows
    tail = rng.lognormal(3, 2, 13000)               # long right tail
    ints = rng.integers(0, 5, 20000).astype(float)  # heavy ties
    a = np.concatenate([hot, tail])
    rng.shuffle(a)
    rows = [(float(x), float(y), "g%d" % (i % 3) if i % 50 else None) for i, (x, y) in enumerate(zip(a, ints))]
    return spark.createDataFrame(rows, "a double, b double, g string").repartition(5).cache(), a, ints


def test_columns_match_numpy(skewed):
    df, a, b = skewed
    got = qt.column_quantiles(df, ["a", "b"], PROBS)
    assert np.allclose(got["a"], np.quantile(a, PROBS), rtol=0, atol=1e-9)
    assert np.allclose(got["b"], np.quantile(b, PROBS), rtol=0, atol=1e-9)


def test_two_scans(skewed, monkeypatch):
    df, _, _ = skewed
    met = []
    pick = qt._picked
    monkeypatch.setattr(qt, "_picked", lambda counts, *a: met.append(counts) or pick(counts, *a))
    qt.column_quantiles(df, ["a", "b"], PROBS)
    assert len(met) == 1
    inside = met[0].where("v is not null").agg(F.sum("c")).first()[0]
    # bands hold a small share of the values (those of the two ends, and values that many rows have, aside)
    lonely = qt.column_quantiles(df.where("a <> 42"), ["a"], [0.25, 0.5])
    assert len(met) == 2 and lonely["a"][0] < lonely["a"][1]
    assert met[1].where("v is not null").agg(F.sum("c")).first()[0] < 13000 * 2 * 4 * qt.MARGIN
    assert inside > 0


def test_a_missed_band_is_counted_whole(skewed):
    df, a, b = skewed
    got = qt.column_quantiles(df, ["a", "b"], PROBS, margin=1e-9)
    assert np.allclose(got["a"], np.quantile(a, PROBS), rtol=0, atol=1e-9)
    rows = {r["g"]: [r[f"q{i}"] for i in range(7)] for r in qt.quantiles_long(df, ["g"], "a", PROBS, margin=-0.2).collect()}
    assert rows == {r["g"]: [r[f"q{i}"] for i in range(7)] for r in qt.quantiles_long(df, ["g"], "a", PROBS).collect()}


def test_grouped(skewed):
    df, a, _ = skewed
    rows = {r["g"]: r for r in qt.group_quantiles(df, "a", "g", PROBS).collect()}
    index = np.arange(len(a))
    for g, part in [(f"g{i}", a[(index % 3 == i) & (index % 50 > 0)]) for i in range(3)] + [(None, a[index % 50 == 0])]:
        assert np.allclose([rows[g][f"q{i}"] for i in range(7)], np.quantile(part, PROBS), rtol=0, atol=1e-9)


def test_odd_columns(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(None, inf, 1.0, nan), (None, -inf, 1.0, 2.0), (None, 3.0, 1.0, None), (None, inf, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "none double, ends double, same double, some double")
    got = qt.column_quantiles(df, df.columns, [0.0, 0.5, 1.0])
    assert got == {"none": [None] * 3, "ends": [-inf, inf, inf], "same": [1.0] * 3, "some": [2.0, 3.0, 4.0]}
    assert qt.column_quantiles(df.limit(0), ["same"], [0.5]) == {"same": [None]}
    assert qt.column_quantiles(df, [], [0.5]) == {} and qt.quantiles_long(df, ["none"], "none", [0.5]).count() == 0


def test_box_of_many_groups_and_null(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 101 == 0 else f"k{i % 100}", float(x)) for i, x in enumerate(rng.normal(size=5000))] + [("k1", 90.0), (None, None), ("k2", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["group"]: r for r in box_stats(df, "x", "g").collect()}
    assert len(got) == 101
    for g, r in got.items():
        v = np.array([x for k, x in rows if k == g and x is not None and x == x])
        q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        fence = 1.5 * (q3 - q1)
        near = v[(v >= q1 - fence) & (v <= q3 + fence)]
        assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]], [q1, m, q3, near.min(), near.max()])
        assert (r["n"], r["n_outliers"]) == (len(v), len(v) - len(near))
    assert got["k1"]["n_outliers"] >= 1
