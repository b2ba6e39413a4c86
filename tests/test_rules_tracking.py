"""Type hints, target identification, tracking and lineage (D*, R1, L*, W*)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import dtypes as dty
from tessera.operators import evaluate as ev
from tessera.operators import profile as prof
from tessera.operators import rules as ru
from tessera.operators import tracking as tr


def test_type_hints_by_name(spark):
    p = spark.createDataFrame(
        [("created_date", "string", ["2024-01-01"]), ("customer_id", "bigint", ["1"]),
         ("revenue", "double", ["1.5"]), ("is_active", "double", ["0.0", "1.0"])],
        "column_name string, dtype string, sample_values array<string>")
    got = {r["column"]: r["suggested_dtype"] for r in dty.suggest_from_names(p).collect()}
    assert got == {"created_date": "datetime", "customer_id": "string", "is_active": "boolean"}


def test_value_type_suggestions(spark):
    df = spark.createDataFrame([("1", "2024-01-15", "1.5", 1.0), ("2", "01/15/2024", "2.5", 2.0),
                                ("3", "15.01.2024", "x", 3.0)], "n string, d string, f string, w double")
    got = {r["column"]: r["suggested_dtype"] for r in dty.suggest_types(df).collect()}
    assert got["n"] == "int" and got["d"] == "datetime" and got["w"] == "int"


def test_identify_target(spark):
    for name in ("churn", "target", "label", "class", "outcome"):
        df = spark.createDataFrame([(0, 1), (1, 2)], f"{name} bigint, feature_a bigint")
        assert ru.identify_target(df).first()["target"] == name
    df = spark.createDataFrame([(1, 5), (0, 6), (1, 7)], "Churn bigint, Revenue bigint")
    assert ru.identify_target(df).first()["target"] == "Churn"
    df = spark.createDataFrame([(1, 10), (0, 20), (1, 30), (0, 40)], "is_active bigint, revenue bigint")
    assert ru.identify_target(df).first()["target"] == "is_active"
    df = spark.createDataFrame([(True, 1), (False, 2)], "flag boolean, value bigint")
    assert ru.identify_target(df).first()["target"] == "flag"
    df = spark.createDataFrame([(1, 2, "n"), (2, 3, "s"), (3, 4, "e")], "revenue bigint, cost bigint, region string")
    assert ru.identify_target(df).first()["target"] is None


def test_run_comparison_best(spark):
    runs = spark.createDataFrame([("s", "r1", 0.75), ("s", "r2", 0.85), ("s", "r3", 0.82)],
                                 "session string, run string, f1_score double")
    assert tr.best_by(runs, ["session"], "f1_score").first()["run"] == "r2"
    ranks = {r["run"]: r["rank"] for r in tr.rank_by_metric(runs, ["session"], "f1_score").collect()}
    assert ranks == {"r2": 1, "r3": 2, "r1": 3}


def test_lineage_closure_cycle_safe(spark):
    edges = spark.createDataFrame([("ingest", "profile"), ("profile", "modeling"), ("modeling", "explain"),
                                   ("explain", "modeling"), ("upstream", "ingest")], "src string, dst string")
    changed = spark.createDataFrame([("modeling",)], "node string")
    c = {r["node"]: r["depth"] for r in tr.lineage_closure(edges, changed).collect()}
    assert c == {"modeling": 0, "explain": 1}
    states = spark.createDataFrame([("profile", "completed"), ("modeling", "completed"), ("explain", "completed")],
                                   "node string, state string")
    got = {r["node"]: r["state"] for r in tr.mark_stale(states, tr.lineage_closure(edges, changed)).collect()}
    assert got == {"profile": "completed", "modeling": "ready", "explain": "stale"}


def test_versions_and_latest(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", "step", t0 + dt.timedelta(minutes=i), f"v{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "session string, step string, created_at timestamp, code string")
    v = tr.with_versions(df, ["session", "step"], ["created_at"]).orderBy("created_at")
    assert [r["version"] for r in v.collect()] == [1, 2, 3, 4, 5]
    assert tr.latest_per_group(df, ["session", "step"], "created_at").first()["code"] == "v4"


def test_given_threshold_and_auc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    assert ev.roc_auc(df).first()["auc"] == 0.75
    p = ev.apply_threshold(df, "score", 0.3)
    assert [r["prediction"] for r in p.collect()] == [1, 1, 1, 0]


def test_profile_values(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x bigint, s string")
    p = {r["column_name"]: r for r in prof.profile(df).collect()}
    assert p["x"]["null_count"] == 1 and p["x"]["null_pct"] == 33.33 and p["x"]["min_value"] == "1"
    assert p["s"]["unique_count"] == 2 and p["s"]["mean_value"] is None
    sv = {r["column_name"]: r["sample_values"] for r in prof.sample_values(df).collect()}
    assert sv["s"] == ["a", "b"]
    assert df.select(F.lit(1)).count() == 3


def test_model_override(spark):
    models = spark.createDataFrame([("s", "m1", 0.80), ("s", "m2", 0.85), ("t", "m3", 0.5)],
                                   "session string, model string, f1_score double")
    pick = spark.createDataFrame([("s", "m1")], "session string, model string")
    got = {r["session"]: r["model"] for r in tr.best_with_override(models, ["session"], "f1_score", "model",
                                                                    pick).collect()}
    assert got == {"s": "m1", "t": "m3"}


def test_tables_by_name_or_index(spark):
    import tempfile
    from tessera.sources import tables as src
    d = tempfile.mkdtemp(prefix="tessera-book-")
    spark.createDataFrame([(1, 2), (3, 4)], "a bigint, b bigint").write.parquet(d + "/Customers.parquet")
    spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "x bigint, y bigint").write.parquet(d + "/Orders.parquet")
    spark.createDataFrame([(1, 2)], "p bigint, q bigint").write.parquet(d + "/Products.parquet")
    assert src.load_by_name_or_index(spark, d, "Orders").count() == 3
    assert src.load_by_name_or_index(spark, d, 2).count() == 1
    info = {r["table_name"]: r["n_rows"] for r in src.table_info(spark, d).collect()}
    assert info == {"Customers": 2, "Orders": 3, "Products": 1}


def test_null_group_keys_are_a_group(spark):
    rows = [(None if i % 2 else "a", i, float(i % 5)) for i in range(24)]
    df = spark.createDataFrame(rows, "g string, t int, m double").repartition(4)
    v = tr.with_versions(df, ["g"], ["t"]).collect()
    for g in (None, "a"):
        assert [r["version"] for r in sorted((r for r in v if r["g"] == g), key=lambda r: r["t"])] == list(range(1, 13))
    ranks = tr.rank_by_metric(df, ["g"], "m").collect()
    assert len(ranks) == 24
    for r in ranks:
        assert r["rank"] == 1 + sum(1 for g, _, m in rows if g == r["g"] and m > r["m"])


def test_register_null_path_and_override_without_model(spark):
    reg = spark.createDataFrame([("s", 1, None), (None, 1, "p")], "s string, v int, path string")
    new = spark.createDataFrame([("s", None), (None, "p"), ("s", "q")], "s string, path string")
    assert [tuple(r) for r in tr.register_if_changed(reg, new, ["s"], "v", "path").collect()] == [("s", "q")]
    models = spark.createDataFrame([("s", "m1", 0.5), ("s", "m2", 0.9), (None, "m3", 0.1), (None, "m4", 0.2)],
                                   "s string, model string, f double")
    pick = spark.createDataFrame([("s", "absent"), (None, "m3")], "s string, model string")
    got = {r["s"]: r["model"] for r in tr.best_with_override(models, ["s"], "f", "model", pick).collect()}
    assert got == {"s": "m2", None: "m3"}


def test_detect_date_reads_the_whole_column(spark):
    rows = [("2024-01-01", "2024-01-02")] * 40 + [("never", None)]
    df = spark.createDataFrame(rows, "start_date string, end_date string")
    assert dty.detect_date_column(df) == "end_date"
    assert dty.detect_date_column(df.where("false")) is None
