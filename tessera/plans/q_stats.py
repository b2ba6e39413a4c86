"""Queries for hypothesis tests (H1-H8, A22).  Statistics and degrees of
freedom have DuckDB twins; p-values are checked against textbook values in
the unit tests (no incomplete beta/gamma in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import stable_round as sround
from tessera.operators import stats as st
from tessera.plans.registry import load, query


def _core(df):
    return df.select("test_type", sround("statistic", 6).alias("statistic"),
                     sround("dof", 6).alias("dof"), "n")


@query("ttest", """
WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
           FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 2),
t AS (SELECT max(CASE WHEN rn = 1 THEN n END) n1, max(CASE WHEN rn = 1 THEN m END) m1, max(CASE WHEN rn = 1 THEN v END) v1,
             max(CASE WHEN rn = 2 THEN n END) n2, max(CASE WHEN rn = 2 THEN m END) m2, max(CASE WHEN rn = 2 THEN v END) v2
      FROM (SELECT *, row_number() OVER (ORDER BY g) AS rn FROM g))
SELECT 't_test' AS test_type, round(((m1 - m2) / sqrt(v1 / n1 + v2 / n2)) + sign(((m1 - m2) / sqrt(v1 / n1 + v2 / n2))) * 1e-9, 6) AS statistic,
  round(((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))) + sign(((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)))) * 1e-9, 6) AS dof,
  n1 + n2 AS n FROM t""")
def ttest(spark, d):
    """H2: Welch t-test of price between line statuses."""
    return _core(st.welch_stats(load(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"))


_CHI_SQL = """
WITH o AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {t}
           WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM o GROUP BY b),
tot AS (SELECT sum(o) AS N, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM o),
c AS (SELECT ra.a, cb.b, ra, cb, coalesce(o.o, 0) AS o FROM ra CROSS JOIN cb LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
e AS (SELECT c.*, ra * cb / N AS e, (ka - 1) * (kb - 1) AS dof, N FROM c, tot),
dv AS (SELECT *, CASE WHEN dof = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END AS dv FROM e)
SELECT 'chi_square' AS test_type, round((sum(dv * dv / e)) + sign((sum(dv * dv / e))) * 1e-9, 6) AS statistic, CAST(max(dof) AS DOUBLE) AS dof,
       CAST(max(N) AS BIGINT) AS n FROM dv"""


@query("chi2", _CHI_SQL.format(a="l_returnflag", b="l_linestatus", t="lineitem"))
def chi2(spark, d):
    """H3: chi-square of return flag × line status (3×2)."""
    return _core(st.chi_square_stats(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("chi2_yates", _CHI_SQL.format(a="quality", b="toxic", t="labels"))
def chi2_yates(spark, d):
    """H3: 2×2 table of the quality and toxic labels, Yates-corrected."""
    return _core(st.chi_square_stats(load(spark, d, "labels"), "quality", "toxic"))


@query("pearson", """
SELECT 'correlation' AS test_type,
  round((corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ^ 2))) + sign((corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ^ 2)))) * 1e-9, 6) AS statistic,
  CAST(count(*) - 2 AS DOUBLE) AS dof, count(*) AS n
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def pearson(spark, d):
    """H4: Pearson correlation test."""
    return _core(st.correlation_stats(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("spearman", """
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
SELECT 'spearman' AS test_type, round((corr(rx, ry) * sqrt((count(*) - 2) / (1 - corr(rx, ry) ^ 2))) + sign((corr(rx, ry) * sqrt((count(*) - 2) / (1 - corr(rx, ry) ^ 2)))) * 1e-9, 6) AS statistic,
       CAST(count(*) - 2 AS DOUBLE) AS dof, count(*) AS n FROM r""")
def spearman(spark, d):
    """H4: Spearman correlation via average ranks (distinct-value prefix sums)."""
    return _core(st.correlation_stats(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "spearman"))


@query("anova", """
WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
           FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS n_total, sum(n * m) / sum(n) AS gm, count(*) AS k FROM g),
s AS (SELECT n_total, k, sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * v) AS ssw FROM g, t GROUP BY n_total, k)
SELECT 'anova' AS test_type, round(((ssb / (k - 1)) / (ssw / (n_total - k))) + sign(((ssb / (k - 1)) / (ssw / (n_total - k)))) * 1e-9, 6) AS statistic,
       CAST(k - 1 AS DOUBLE) AS dof, CAST(n_total AS BIGINT) AS n FROM s""")
def anova(spark, d):
    """H5: one-way ANOVA of price across the three return flags."""
    return _core(st.anova_stats(load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("leakage", """
WITH l AS (SELECT l_extendedprice * (1 - l_discount) AS net_price, l_quantity, l_discount, l_tax, l_extendedprice
           FROM lineitem),
c AS (SELECT 'net_price' AS feature, round((abs(corr(net_price, l_extendedprice))) + sign((abs(corr(net_price, l_extendedprice)))) * 1e-9, 6) AS abs_corr FROM l
      UNION ALL SELECT 'l_quantity', round((abs(corr(l_quantity, l_extendedprice))) + sign((abs(corr(l_quantity, l_extendedprice)))) * 1e-9, 6) FROM l
      UNION ALL SELECT 'l_discount', round((abs(corr(l_discount, l_extendedprice))) + sign((abs(corr(l_discount, l_extendedprice)))) * 1e-9, 6) FROM l
      UNION ALL SELECT 'l_tax', round((abs(corr(l_tax, l_extendedprice))) + sign((abs(corr(l_tax, l_extendedprice)))) * 1e-9, 6) FROM l)
SELECT * FROM c WHERE abs_corr > 0.95""")
def leakage(spark, d):
    """H8: features almost collinear with the target (net price here)."""
    li = load(spark, d, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return st.leakage(li, "l_extendedprice")


def _batch(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                                           "l_linestatus")
    hyps = st.generate_hypotheses(li, "l_linestatus")
    return st.run_tests(li, hyps)


@query("hypothesis_batch")
def hypothesis_batch(spark, d):
    """H1/H6: hypotheses generated from types against the line status,
    all tests batched, p-values and conclusions."""
    return _batch(spark, d)


@query("test_summary")
def test_summary(spark, d):
    """Conclusion counts of the batch."""
    return st.summarize(_batch(spark, d))


def _edge(spark, d):
    li = load(spark, d, "lineitem")
    data = li.select("l_quantity", (F.col("l_quantity") * 2).alias("twice"), "l_returnflag", "l_linestatus", "l_partkey",
                     F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("empty"),
                     F.when(F.col("l_linestatus") == "F", 1.0).otherwise(2.0).alias("fixed"))
    tests = [("t_test", "l_returnflag", "l_linestatus"), ("chi_square", "l_partkey", "l_linestatus"),
             ("correlation", "l_quantity", "twice"), ("correlation", "l_quantity", "constant"), ("t_test", "fixed", "l_linestatus"),
             ("anova", "fixed", "l_linestatus"), ("t_test", "empty", "l_linestatus"), ("anova", "constant", "l_returnflag"),
             ("chi_square", "no_such_column", "l_linestatus"), ("no_such_test", "l_quantity", "l_linestatus")]
    return st.run_tests(data, [st.Hypothesis(t, [a, b], f"{a} by {b}", f"h{i}") for i, (t, a, b) in enumerate(tests)])


@query("hypothesis_edge", """
WITH o AS (SELECT l_partkey AS a, l_linestatus AS b, count(*) AS o FROM lineitem WHERE l_partkey IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL),
s AS (SELECT sum(o) AS n, sum(o) * (sum(o * o / (ra * cb)) - 1) AS chi
      FROM (SELECT o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM o)),
r AS (SELECT count(*) AS n FROM lineitem),
e(nth, test_type, conclusion, rows) AS (VALUES
  (0, 't_test', 'inconclusive', 0), (1, 'chi_square', NULL, 1), (2, 'correlation', 'supported', 1),
  (3, 'correlation', 'inconclusive', 1), (4, 't_test', 'supported', 1), (5, 'anova', 'supported', 1),
  (6, 't_test', 'inconclusive', 0), (7, 'anova', 'inconclusive', 1), (8, 'chi_square', 'inconclusive', 0),
  (9, 'no_such_test', 'inconclusive', 0))
SELECT nth, test_type, conclusion, CAST(rows * r.n AS BIGINT) AS n, CASE WHEN nth = 1 THEN round(s.chi + 1e-9, 6) END AS chi_square
FROM e, r, s""")
def hypothesis_edge(spark, d):
    """H2-H6: a text value, thousands of levels, perfect and constant variables, groups without spread, an empty
    column, an unknown column and an unknown test: one row each. (The p-value of the large table has no SQL form.)"""
    large = F.col("nth") == 1
    return _edge(spark, d).select("nth", "test_type", F.when(~large, F.col("conclusion")).alias("conclusion"), "n",
                                  F.when(large, F.col("statistic")).alias("chi_square"))


@query("hypothesis_lines", """
WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT 6 AS nth, 'INCONCLUSIVE h6: t_test of empty and l_linestatus; statistic none; p none; rows 0; no details' AS line
UNION ALL SELECT 8, 'INCONCLUSIVE h8: chi_square of no_such_column and l_linestatus; statistic none; p none; rows 0; column not found'
UNION ALL SELECT 0, 'INCONCLUSIVE h0: t_test of l_returnflag and l_linestatus; statistic none; p none; rows 0; not a number: l_returnflag'
UNION ALL SELECT 5, 'SUPPORTED h5: anova of fixed and l_linestatus; statistic beyond all bounds; p 0.000000; rows ' || sum(n) || '; 2 groups' FROM g""")
def hypothesis_lines(spark, d):
    """H7: the detail lines of four of those tests."""
    return st.detail_lines(_edge(spark, d).where(F.col("nth").isin(0, 5, 6, 8)))
