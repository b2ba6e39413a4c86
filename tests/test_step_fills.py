"""Imputation steps of a chain: one fit for all columns of a step, equal to column by column."""

from pyspark.sql import functions as F

from tessera.operators import prepare as pp

ROWS = [(1, 1.5, "b", None, None), (2, None, "a", None, True), (2, 4.0, "a", None, True), (1, None, "b", None, False),
        (None, 9.0, None, None, False), (None, 9.0, "c", None, None), (None, 4.0, "", None, None)]
SCHEMA = "k int, x double, s string, gone string, flag boolean"


def test_modes_equal_single_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("a.b", F.col("x") * 2)
    for columns in (df.columns, ["s"], []):
        for at_once in (1, 2, 32):
            assert pp.mode_values(df, columns, at_once) == {c: pp.mode_value(df, f"{c}") for c in columns}
    assert pp.mode_values(df, ["k", "s", "gone"]) == {"k": 1, "s": "a", "gone": None}
    assert pp.mode_values(df.limit(0), ["k", "s"]) == {"k": None, "s": None}


def test_modes_take_one_scan(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    scans = []
    seen = df.withColumn("k", F.col("k"))
    collect = type(seen).collect
    try:
        type(seen).collect = lambda self: scans.append(self) or collect(self)
        pp.mode_values(seen, seen.columns)
    finally:
        type(seen).collect = collect
    assert len(scans) == 1


def test_steps_fill_all_their_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("y", F.col("x") + 1)
    steps = [pp.Step("impute", ["x"], "mean"), pp.Step("impute", ["y", "k"], "median"), pp.Step("impute", ["s", "flag", "gone"], "mode")]
    got = [tuple(r) for r in pp.StepChain(steps).fit(df).transform(df).collect()]
    x = [1.5, 4.0, 9.0, 9.0, 4.0]
    mean = sum(x) / len(x)
    want = [(k if k is not None else 1, a if a is not None else mean, s if s is not None else "a", None, f if f is not None else False,
             a + 1 if a is not None else 5.0) for k, a, s, _, f in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_missing_values_take_modes_at_once(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out, report = pp.handle_missing(df, {"s": "mode", "x": "mean", "k": "mode", "gone": "mode", "nowhere": "mode"})
    assert report.errors == ["column not found: nowhere"]
    got = sorted((r["k"], r["s"], r["gone"]) for r in out.collect())
    assert got == sorted((k or 1, s if s is not None else "a", None) for k, _, s, *_ in ROWS)
