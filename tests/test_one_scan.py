"""Statistics of many columns from one scan: correlations, sample values, densities, payload keys."""

import json
import math

import numpy as np
import pytest

from tessera.functions.scalar import safe_corr
from tessera.operators import explore as ex
from tessera.operators import payload as pl
from tessera.operators import profile as prof


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_two_hundred_columns_in_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 6))
    x = 1e6 + base @ rng.normal(size=(6, 200)) + rng.normal(size=(900, 200)) * 0.5
    gone = rng.random((900, 200)) < 0.1
    x[:, 7] = 0.1
    cells = np.where(gone, None, x)
    import pandas as pd
    spark.createDataFrame(pd.DataFrame({f"c{i}": pd.array(cells[:, i], "Float64") for i in range(200)}).astype(object).where(~gone, None),
                          ", ".join(f"c{i} double" for i in range(200))).repartition(4).write.parquet(f"{tmp_path}/wide")
    df = spark.read.parquet(f"{tmp_path}/wide")
    made = ex.correlation_matrix(df)
    assert _scans(made) == 1
    got = {(r["row"], r["col"]): r["r"] for r in made.collect()}
    assert len(got) == 200 * 200
    for a, b in [(0, 1), (5, 150), (199, 3), (42, 43), (0, 0)]:
        both = ~gone[:, a] & ~gone[:, b]
        assert abs(got[f"c{a}", f"c{b}"] - np.corrcoef(x[both, a], x[both, b])[0, 1]) < 1e-9
    assert all(got["c7", f"c{i}"] is None and got[f"c{i}", "c7"] is None for i in range(200))


def test_correlations_equal_the_pairwise_form(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(float(i), None if i % 3 else float(i * i), 5.0 if i % 2 else None, float(i % 4) if i % 3 else 2.0, nan if i == 7 else float(-i),
             inf if i == 8 else 1.0 * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(3)
    got = {(r["row"], r["col"]): r["r"] for r in ex.correlation_matrix(df).collect()}
    pairs = [(a, b) for a in "abcdef" for b in "abcdef" if a != b]
    want = df.agg(*[safe_corr(a, b).alias(a + b) for a, b in pairs]).first()
    for a, b in pairs:
        w = want[a + b]
        assert (got[a, b] is None) == (w is None) and (w is None or abs(got[a, b] - w) < 1e-9), (a, b, got[a, b], w)
    none = ex.correlation_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(none) == 4 and all(r["r"] is None for r in none)


def test_sample_values(spark, tmp_path):
    rows = [(f"é{i % 7}" if i % 2 else None, i, None, "x" * (i % 3)) for i in range(500)]
    spark.createDataFrame(rows, "s string, n int, none int, t string").repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    made = prof.sample_values(df, 4)
    assert _scans(made) == 1
    got = {r["column_name"]: r["sample_values"] for r in made.collect()}
    assert got == {"s": ["é0", "é1", "é2", "é3"], "n": ["0", "1", "10", "100"], "none": [], "t": ["", "x", "xx"]}
    assert {tuple(r["sample_values"]) for r in prof.sample_values(df.limit(0)).collect()} == {()}


@pytest.mark.parametrize("error,close", [(1e-4, 1e-4), (1e-8, 1e-8)])
def test_density_keeps_its_error_bound(spark, error, close):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=400), rng.normal(8, 0.2, 300), [50.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    got = sorted((r["grid_index"], r["x"], r["density"]) for r in ex.kde(df, "x", 50, error).collect())
    bw = x.std(ddof=1) * len(x) ** -0.2
    peak = 1 / (bw * math.sqrt(2 * math.pi))
    for k, at, density in got:
        exact = np.exp(-0.5 * ((at - x) / bw) ** 2).sum() * peak / len(x)
        assert abs(at - (x.min() + k * (x.max() - x.min()) / 49)) < 1e-9 and abs(density - exact) <= close * peak
    assert len(got) == 50 and ex.kde(df.where("x = 50"), "x").count() == 0


def test_payload_keys_and_fields(spark):
    rows = [None, "", "{", "3", "[1, [2, {\"z\": 1}]]", "{}", '{"a": {"b": {"c": null}}, "d": true}', '{"a": "t", "d": 1.25, "é": [[]]}', "null"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "id int, p string")

    def walk(path, v, out):
        for key, x in (v.items() if isinstance(v, dict) else ((None, x) for x in v) if isinstance(v, list) else ()):
            at = f"{path}[]" if key is None else f"{path}.{key}"
            kind = {dict: "object", list: "list", str: "text", bool: "flag", type(None): "null"}.get(type(x), "number")
            out[at, kind] = out.get((at, kind), 0) + 1
            walk(at, x, out)
    want, bad = {}, 0
    for p in rows:
        try:
            walk("$", json.loads(p) if p is not None else None, want)
        except ValueError:
            bad += 1
    assert {(r["path"], r["kind"]): r["n"] for r in pl.payload_keys(df, "p").collect()} == want
    one = pl.payload_summary(df, "p").first()
    assert (one["n_rows"], one["n_missing"], one["n_malformed"]) == (len(rows), 1, bad)
    got = {r["id"]: (r["d"], r["c"]) for r in pl.with_fields(df, "p", {"d": ("$.d", "double"), "c": ("$.a.b", "string")}).collect()}
    assert got[7] == (1.25, None) and got[0] == got[2] == got[8] == (None, None) and "c" in got[6][1]
    assert pl.payload_keys(df.limit(0), "p").count() == 0
