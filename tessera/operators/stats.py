"""Hypothesis tests from single-pass sufficient statistics.

Spark computes the counts, means, variances, contingency tables and
correlations (each test is one or two aggregations, batched where
possible); the p-value is a function of a few numbers, evaluated by a
vectorised pandas UDF over the small result table.  α = 0.05; conclusions
are supported / rejected / inconclusive; statistic and p rounded to 6 dp.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import safe_corr
from tessera.functions.scalar import stable_round as sround
from tessera.functions.special import p_value
from tessera.functions.types import NUMERIC, kind_of

ALPHA = 0.05

RESULT_SCHEMA = ("test_type string, variables array<string>, statistic double, dof double, "
                 "dof2 double, n bigint, detail string")


def _q(name: str):
    return F.col(f"`{name}`")


def _moments(value: str) -> list:
    """Rows, mean and variance of a group; exact where all its values are equal."""
    x = _q(value).cast("double")
    flat = F.min(x) == F.max(x)
    return [F.count(F.lit(1)).alias("n"), F.when(flat, F.min(x)).otherwise(F.avg(x)).alias("m"),
            F.when(flat & (F.count(F.lit(1)) > 1), F.lit(0.0)).otherwise(F.var_samp(x)).alias("v")]


def welch_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """H2: Welch t statistic and degrees of freedom between the two smallest
    group values (text order; the reference took the first two seen)."""
    g = (df.where(_q(value).isNotNull() & _q(group).isNotNull())
         .groupBy(_q(group).cast("string").alias("g"))
         .agg(*_moments(value)))
    two = g.orderBy("g").limit(2)
    w = Window.orderBy("g")  # two rows
    t = two.withColumn("i", F.row_number().over(w)).agg(
        *[F.max(F.when(F.col("i") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("g", "n", "m", "v")])
    se2 = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    return t.select(
        F.lit("t_test").alias("test_type"), F.array(F.lit(value), F.lit(group)).alias("variables"),
        # groups that do not vary: no finite statistic if their means differ
        F.when((se2 == 0) & (F.col("m1") != F.col("m2")), F.signum(F.col("m1") - F.col("m2")) * F.lit(float("inf")))
        .otherwise(F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se2))).alias("statistic"),
        F.when(se2 == 0, F.lit(1.0)).otherwise(F.try_divide(se2 * se2, F.try_divide((F.col("v1") / F.col("n1")) ** 2, (F.col("n1") - 1).cast("double"))
                     + F.try_divide((F.col("v2") / F.col("n2")) ** 2, (F.col("n2") - 1).cast("double")))).alias("dof"),
        F.lit(None).cast("double").alias("dof2"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"),
        F.concat_ws(" vs ", F.concat(F.col("g1"), F.lit(" (mean "), sround("m1", 4).cast("string"), F.lit(")")),
                    F.concat(F.col("g2"), F.lit(" (mean "), sround("m2", 4).cast("string"), F.lit(")"))).alias("detail"))


def chi_square_stats(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """H3: chi-square independence over the full contingency table
    (zero cells included), Yates-corrected when dof = 1.

    Only observed cells are ever built, at most one per row, so any number
    of levels is tested."""
    data = df.where(_q(a).isNotNull() & _q(b).isNotNull()).select(
        _q(a).cast("string").alias("a"), _q(b).cast("string").alias("b"))
    obs = data.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    ra = obs.groupBy("a").agg(F.sum("o").alias("ra"))
    cb = obs.groupBy("b").agg(F.sum("o").alias("cb"))
    tot = obs.agg(F.sum("o").alias("n"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb")).first()
    n, ka, kb = tot["n"] or 0, tot["ka"], tot["kb"]
    if n == 0:
        return df.sparkSession.createDataFrame([("chi_square", [a, b], None, None, None, 0, "no rows")], RESULT_SCHEMA)
    dof = (ka - 1) * (kb - 1)
    detail = F.lit(f"{ka}x{kb}")
    if yates and dof == 1:
        # 2×2 table: at most four observed cells; the zero cells' Yates terms
        # need every cell, so the ≤ 4 counts are finished on the driver
        cells = {(r["a"], r["b"]): r["o"] for r in obs.collect()}
        rows_ = {k[0] for k in cells}
        cols_ = {k[1] for k in cells}
        r_tot = {x: sum(v for (p, _), v in cells.items() if p == x) for x in rows_}
        c_tot = {y: sum(v for (_, q), v in cells.items() if q == y) for y in cols_}
        chi2 = 0.0
        for x in rows_:
            for y in cols_:
                e = r_tot[x] * c_tot[y] / n
                d = abs(cells.get((x, y), 0) - e)
                d -= min(0.5, d)
                chi2 += d * d / e
        stat = F.lit(chi2)
        base = obs.limit(1)
    else:
        # Σ over all cells (O−E)²/E = Σ over observed cells (O−E)²/E + (N − Σ observed E):
        # zero cells contribute their E, so the level grid is never built
        e = F.col("ra") * F.col("cb") / F.lit(n)
        j = obs.join(ra, "a").join(cb, "b")
        base = j.agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("s"), F.sum(e).alias("se"))
        stat = F.col("s") + (F.lit(float(n)) - F.col("se"))
    return base.select(
        F.lit("chi_square").alias("test_type"), F.array(F.lit(a), F.lit(b)).alias("variables"),
        stat.cast("double").alias("statistic"), F.lit(float(dof)).alias("dof"),
        F.lit(None).cast("double").alias("dof2"), F.lit(n).cast("bigint").alias("n"), detail.alias("detail"))


def correlation_stats(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """H4: r, n and t = r·√((n−2)/(1−r²)) with n−2 degrees of freedom.
    Spearman correlates average ranks (no single-partition window)."""
    data = df.where(_q(x).isNotNull() & _q(y).isNotNull()).select(_q(x).cast("double").alias("x"),
                                                                 _q(y).cast("double").alias("y"))
    if method == "spearman":
        from tessera.operators.ordered import average_ranks
        data = average_ranks(average_ranks(data, "x", "rx"), "y", "ry").select(
            F.col("rx").alias("x"), F.col("ry").alias("y"))
    s = data.agg(safe_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    r = F.col("r")
    return s.select(
        F.lit("correlation" if method == "pearson" else "spearman").alias("test_type"),
        F.array(F.lit(x), F.lit(y)).alias("variables"),
        # a perfect correlation has no finite statistic
        F.when(F.abs(r) >= 1, r * F.lit(float("inf")))
        .otherwise(r * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - r * r))).alias("statistic"),
        (F.col("n") - 2).cast("double").alias("dof"), F.lit(None).cast("double").alias("dof2"),
        F.col("n"), F.concat(F.lit("r="), F.coalesce(sround(r, 6).cast("string"), F.lit("undefined"))).alias("detail"))


def anova_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """H5: one-way ANOVA from per-group n, mean, variance."""
    g = (df.where(_q(value).isNotNull() & _q(group).isNotNull()).groupBy(_q(group))
         .agg(*_moments(value)))
    # grand totals: three numbers, fitted first and applied as literals
    tot = g.agg(F.sum("n").alias("n_total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
                F.count(F.lit(1)).alias("k_groups"), F.min("m").alias("low"), F.max("m").alias("high")).first()
    nt, gm, k = tot["n_total"] or 0, tot["gm"], tot["k_groups"]
    s = g.agg(
        (F.lit(0.0) if tot["low"] == tot["high"] else F.sum(F.col("n") * (F.col("m") - F.lit(gm)) ** 2)).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"))
    d1, d2 = float(k - 1), float(nt - k)
    # groups that do not vary within: no finite statistic if their means differ, none at all if they agree
    stat = (F.when((F.col("ssw") == 0) & (F.col("ssb") > 0), F.lit(float("inf")))
            .otherwise(F.try_divide(F.col("ssb") / F.lit(d1), F.col("ssw") / F.lit(d2)))
            if d1 > 0 and d2 > 0 else F.lit(None))
    return s.select(
        F.lit("anova").alias("test_type"), F.array(F.lit(value), F.lit(group)).alias("variables"),
        stat.cast("double").alias("statistic"), F.lit(d1).alias("dof"),
        F.lit(d2).alias("dof2"), F.lit(nt).cast("bigint").alias("n"),
        F.lit(f"{k} groups").alias("detail"))


@F.pandas_udf(T.DoubleType())
def _p_udf(kind: pd.Series, stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([p_value(k, None if pd.isna(s) else float(s), None if pd.isna(a) else float(a),
                              None if pd.isna(b) else float(b))
                      for k, s, a, b in zip(kind, stat, d1, d2)], dtype="float64")


def with_conclusions(stats: DataFrame, alpha: float = ALPHA, min_n: int = 3, extra: list[str] = ()) -> DataFrame:
    """H6: p-value and conclusion for each statistics row."""
    p = _p_udf(F.col("test_type"), F.col("statistic"), F.col("dof"), F.col("dof2"))
    out = stats.withColumn("p_value", p)
    bad = (F.col("statistic").isNull() | F.isnan("statistic") | F.col("p_value").isNull()
           | F.isnan("p_value") | (F.col("n") < min_n))
    return out.select(
        *extra, "test_type", "variables", sround("statistic", 6).alias("statistic"), "dof", "dof2", "n",
        sround("p_value", 6).alias("p_value"),
        F.when(bad, "inconclusive").when(F.col("p_value") < alpha, "supported").otherwise("rejected")
        .alias("conclusion"), "detail")


@dataclass
class Hypothesis:
    test_type: str
    variables: list[str]
    statement: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])


def generate_hypotheses(df: DataFrame, target: str, n_classes: int | None = None,
                        context: str = "") -> list[Hypothesis]:
    return _typed_hypotheses(df, target, n_classes) + context_hypotheses(df.columns, target, context)


def _typed_hypotheses(df: DataFrame, target: str, n_classes: int | None = None) -> list[Hypothesis]:
    """H1: hypotheses from real column types and the target's kind:
    numeric × binary target → t-test; categorical × binary or categorical
    target → chi-square; numeric × numeric target → correlation; numeric ×
    multiclass → ANOVA."""
    if n_classes is None:
        n_classes = df.select(_q(target)).where(_q(target).isNotNull()).distinct().limit(21).count()
    names = {NUMERIC: "number", "string": "text"}
    kinds = {f.name: names.get(kind_of(f.dataType), "") for f in df.schema.fields}
    measured = kinds[target] == "number" and n_classes > 20
    return _by_rule(kinds, target, "two" if n_classes == 2 else "number" if measured else "many")


# Name keywords of the name-only hypothesis mode and of the
# churn-context extras.
NUMERIC_NAME_KEYWORDS = ("amount", "revenue", "count", "total", "price", "cost", "value", "score", "rate",
                         "ratio", "age", "salary", "income", "quantity", "balance", "payment", "duration",
                         "size", "weight", "height", "usage", "spend", "volume", "margin", "profit", "loss",
                         "fee")
BINARY_NAME_KEYWORDS = ("churn", "churned", "active", "is_", "has_", "flag", "status", "converted",
                        "cancelled", "default", "fraud")
USAGE_NAME_KEYWORDS = ("usage", "activity", "engagement", "login", "session")


# Test and statement by (feature kind, target kind); shared by both modes.
_RULES = {
    ("number", "two"): ("t_test", "{c} differs between the two {t} groups"),
    ("number", "number"): ("correlation", "{c} correlates with {t}"),
    ("number", "many"): ("anova", "mean {c} differs across {t} classes"),
    ("text", "two"): ("chi_square", "{c} is associated with {t}"),
    ("text", "many"): ("chi_square", "{c} is associated with {t}"),
}


def _by_rule(kinds: dict[str, str], target: str, target_kind: str) -> list[Hypothesis]:
    found = ((c, _RULES.get((k, target_kind))) for c, k in kinds.items() if c != target)
    return [Hypothesis(rule[0], [c, target], rule[1].format(c=c, t=target)) for c, rule in found if rule]


def _named(column: str, keywords: tuple[str, ...]) -> bool:
    return any(k in column.lower() for k in keywords)


def generate_hypotheses_by_name(columns: list[str], target: str, context: str = "") -> list[Hypothesis]:
    """H1, name-only mode: kinds guessed from name keywords, for tables known only by their column list."""
    kinds = {c: "number" if _named(c, NUMERIC_NAME_KEYWORDS) else "text" for c in columns}
    target_kind = "two" if _named(target, BINARY_NAME_KEYWORDS) else kinds.get(target, "text").replace("text", "many")
    return _by_rule(kinds, target, target_kind) + context_hypotheses(columns, target, context)


def context_hypotheses(columns: list[str], target: str, context: str) -> list[Hypothesis]:
    """Extra t-tests of usage-like columns for analyses of churn."""
    usage = [c for c in columns if c != target and _named(c, USAGE_NAME_KEYWORDS)]
    return [Hypothesis("t_test", [c, target], f"{c} tells churned from staying") for c in usage
            if "churn" in (context or "").lower()]


#: The variables of each test that have to be numbers (the others are groups).
_NUMBERS = {"t_test": 1, "anova": 1, "correlation": 2, "spearman": 2, "chi_square": 0}


def _problem(df: DataFrame, h: Hypothesis) -> str | None:
    """Why a hypothesis cannot be tested on the table."""
    if h.test_type not in _NUMBERS:
        return "unknown test"
    if len(h.variables) < 2:
        return "two variables needed"
    if any(v not in df.columns for v in h.variables[:2]):
        return "column not found"
    text = [v for v in h.variables[:_NUMBERS[h.test_type]] if kind_of(df.schema[v].dataType) != NUMERIC]
    return f"not a number: {', '.join(text)}" if text else None


def _statistics(df: DataFrame, h: Hypothesis) -> DataFrame:
    a, b = h.variables[:2]
    if h.test_type == "t_test":
        return welch_stats(df, a, b)
    if h.test_type == "chi_square":
        return chi_square_stats(df, a, b)
    if h.test_type == "anova":
        return anova_stats(df, a, b)
    return correlation_stats(df, a, b, "pearson" if h.test_type == "correlation" else "spearman")


def run_tests(df: DataFrame, hypotheses: list[Hypothesis]) -> DataFrame:
    """H6 batch: exactly one row per hypothesis, numbered as given (``nth``).  Statistics are unioned, then p-values and
    conclusions follow in one pass over the small result table.  What cannot be tested is an inconclusive row that
    says why, and leaves the others alone."""
    spark = df.sparkSession
    out = spark.createDataFrame([], "nth int, hypothesis_id string, " + RESULT_SCHEMA)
    for i, h in enumerate(hypotheses):
        problem, part = _problem(df, h), None
        if problem is None:
            try:
                part = _statistics(df, h)
            except Exception as e:  # noqa: BLE001 - one test that fails must not end the batch
                problem = f"{type(e).__name__}: {e}"[:300]
        if part is None:
            part = spark.createDataFrame([(h.test_type, h.variables, None, None, None, 0, problem)], RESULT_SCHEMA)
        out = out.unionByName(part.select(F.lit(i).alias("nth"), F.lit(h.id).alias("hypothesis_id"), "*"))
    return with_conclusions(out, extra=["nth", "hypothesis_id"])


def detail_lines(results: DataFrame) -> DataFrame:
    """H7: one line of text per hypothesis (``nth``, ``line``): its verdict, test, variables, numbers and details."""
    number = lambda c, places: F.coalesce(F.format_number(c, places), F.lit("none"))
    statistic = F.when(F.col("statistic") == float("inf"), "beyond all bounds").when(
        F.col("statistic") == -float("inf"), "below all bounds").otherwise(number("statistic", 4))
    return results.select("nth", F.concat(
        F.upper("conclusion"), F.lit(" "), F.col("hypothesis_id"), F.lit(": "), F.col("test_type"), F.lit(" of "),
        F.array_join("variables", " and "), F.lit("; statistic "), statistic, F.lit("; p "), number("p_value", 6),
        F.lit("; rows "), F.col("n").cast("string"), F.lit("; "), F.coalesce(F.nullif(F.col("detail"), F.lit("")), F.lit("no details"))).alias("line"))


def summarize(results: DataFrame) -> DataFrame:
    """Totals by conclusion (all three always present)."""
    counts = results.groupBy("conclusion").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("conclusion") == "supported", F.col("n"))), F.lit(0)).alias("supported"),
        F.coalesce(F.sum(F.when(F.col("conclusion") == "rejected", F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("conclusion") == "inconclusive", F.col("n"))), F.lit(0)).alias("inconclusive"))


def leakage(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """H8: numeric features with |corr(feature, target)| above ``threshold``
    (text target label-encoded); a missing target gives an empty result."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "feature string, abs_corr double")
    num = [f.name for f in df.schema.fields if kind_of(f.dataType) == NUMERIC and f.name != target]
    if not num:
        return df.sparkSession.createDataFrame([], "feature string, abs_corr double")
    y = _q(target)
    if kind_of(df.schema[target].dataType) != NUMERIC:
        from tessera.operators.explore import label_codes
        codes = label_codes(df, target)
        df = df.join(codes, y == F.col("__v"), "left")
        y = F.col("__code").cast("double")
    one = df.agg(*[F.abs(safe_corr(_q(c), y)).alias(f"r{i}") for i, c in enumerate(num)])
    cells = [F.struct(F.lit(c).alias("feature"), sround(F.col(f"r{i}"), 6).alias("abs_corr"))
             for i, c in enumerate(num)]
    return (one.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
            .where(F.col("abs_corr") > threshold))
