"""p-value functions against textbook values, and the tests themselves."""

import math

from tessera.functions import special as sp
from tessera.operators import stats as st


def test_t_distribution_table():
    # two-sided 5 % critical values of Student's t
    assert abs(sp.t_two_sided(2.228, 10) - 0.05) < 5e-4
    assert abs(sp.t_two_sided(1.960, 1e7) - 0.05) < 5e-4
    assert abs(sp.t_two_sided(0.0, 5) - 1.0) < 1e-12


def test_chi2_and_f_tables():
    assert abs(sp.chi2_sf(3.841, 1) - 0.05) < 5e-4
    assert abs(sp.chi2_sf(5.991, 2) - 0.05) < 5e-4
    assert abs(sp.f_sf(3.35, 2, 27) - 0.05) < 1e-3
    assert abs(sp.betainc(2, 3, 0.4) - 0.5248) < 1e-4
    assert math.isnan(sp.chi2_sf(float("nan"), 1))


def test_welch_and_anova(spark):
    df = spark.createDataFrame([(float(v), g) for g, vals in (("a", [1, 2, 3, 4, 5]), ("b", [6, 7, 8, 9, 10]))
                                for v in vals], "v double, g string")
    t = st.welch_stats(df, "v", "g").first()
    assert abs(t["statistic"] - (-5.0)) < 1e-9 and abs(t["dof"] - 8.0) < 1e-9
    r = st.with_conclusions(st.welch_stats(df, "v", "g")).first()
    assert r["conclusion"] == "supported" and r["p_value"] < 0.01
    a = st.anova_stats(df, "v", "g").first()
    assert abs(a["statistic"] - 25.0) < 1e-9


def test_chi_square_yates(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40
    df = spark.createDataFrame(rows, "a string, b string")
    s = st.chi_square_stats(df, "a", "b").first()
    # Yates-corrected statistic of [[10, 20], [30, 40]]
    assert abs(s["statistic"] - 0.44642857) < 1e-6 and s["dof"] == 1


def test_leakage_flags_copy(spark):
    rows = [(float(i), float(i % 2), i % 2 + 0.001 * (i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "clean_feat double, target double, leaky_feat double")
    flagged = [r["feature"] for r in st.leakage(df, "target").collect()]
    assert flagged == ["leaky_feat"]
    assert st.leakage(df, "missing").count() == 0
    lower = [r["feature"] for r in st.leakage(df, "target", 0.0).collect()]
    assert set(flagged) <= set(lower)


def test_hypotheses_by_name_and_context():
    hs = st.generate_hypotheses_by_name(["monthly_revenue", "region", "usage_minutes", "churn"], "churn",
                                        context="predict churn")
    kinds = {(h.test_type, h.variables[0]) for h in hs}
    assert ("t_test", "monthly_revenue") in kinds and ("chi_square", "region") in kinds
    assert sum(1 for h in hs if h.variables[0] == "usage_minutes") == 2   # typed + churn extra
    assert st.context_hypotheses(["usage_minutes"], "churn", "") == []


def test_typed_hypotheses(spark):
    df = spark.createDataFrame([(1.0, "a", i % 2) for i in range(10)], "x double, s string, y bigint")
    kinds = sorted(h.test_type for h in st.generate_hypotheses(df, "y"))
    assert kinds == ["chi_square", "t_test"]


def test_infinite_statistics_have_p_zero():
    inf = float("inf")
    assert sp.t_two_sided(inf, 5) == sp.t_two_sided(-inf, 5) == sp.chi2_sf(inf, 2) == sp.f_sf(inf, 2, 9) == 0.0
    assert math.isnan(sp.t_two_sided(float("nan"), 5)) and math.isnan(sp.f_sf(2.0, 0, 9)) and math.isnan(sp.t_two_sided(1.0, float("nan")))


def test_every_hypothesis_gives_one_row(spark):
    rows = [(float(i), 2.0 * i + 1, f"g{i % 2}", f"l{i}", "text", 3.0, None, float(i % 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "x double, y double, g string, level string, word string, same double, none double, fixed double")
    cases = [("correlation", "x", "y", "supported"), ("correlation", "x", "same", "inconclusive"), ("t_test", "word", "g", "inconclusive"),
             ("chi_square", "level", "g", "rejected"), ("anova", "fixed", "g", "supported"), ("t_test", "fixed", "g", "supported"),
             ("t_test", "same", "g", "inconclusive"), ("anova", "none", "g", "inconclusive"), ("spearman", "x", "y", "supported"),
             ("correlation", "x", "word", "inconclusive"), ("t_test", "x", "gone", "inconclusive"), ("odd", "x", "g", "inconclusive"),
             ("chi_square", "none", "g", "inconclusive"), ("anova", "x", "word", "inconclusive")]
    got = st.run_tests(df, [st.Hypothesis(t, [a, b], "") for t, a, b, _ in cases] + [st.Hypothesis("t_test", ["x"], "")])
    assert [r["conclusion"] for r in got.orderBy("nth").collect()] == [c for *_, c in cases] + ["inconclusive"]
    by = {r["nth"]: r for r in got.collect()}
    assert by[0]["p_value"] == 0.0 and by[4]["statistic"] == float("inf") and by[5]["statistic"] == -float("inf")
    assert by[2]["detail"] == "not a number: word" and by[3]["detail"] == "1500x2" and by[3]["n"] == 1500
    lines = {r["nth"]: r["line"] for r in st.detail_lines(got).collect()}
    assert len(lines) == len(cases) + 1 and lines[14].endswith("two variables needed") and "1500x2" in lines[3]
    assert st.run_tests(df, []).count() == 0
    total = st.summarize(got).first()
    assert total["total"] == total["supported"] + total["rejected"] + total["inconclusive"] == len(cases) + 1


def test_text_targets_of_any_number_of_labels(spark):
    from tessera.operators import explore as ex
    df = spark.createDataFrame([(float(i), f"t{i:05d}", float(i % 7)) for i in range(3000)], "x double, t string, z double")
    assert [r["feature"] for r in st.leakage(df, "t").collect()] == ["x"]
    assert ex.feature_ranking(df, "t").first()["feature"] == "x"
