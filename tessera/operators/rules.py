"""Rule operators over the column profile.

The profile itself is one Spark aggregation (``profile.profile``); the rules
are column expressions over that one-row-per-column table, plus bounded
probes (at most 3 distinct values of a two-valued column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import safe_corr
from tessera.functions.types import ID_LIKE_NAMES, NUMERIC, kind_of
from tessera.operators.profile import profile

# Target column names, in priority order, and the value set
# that marks a two-valued column as a likely target.
TARGET_NAMES = ("churn", "target", "label", "class", "outcome", "churned", "is_churn",
                "attrition", "default", "fraud", "spam")
BINARY_VALUES = ("yes", "no", "true", "false", "0", "1", "y", "n")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def identify_target(df: DataFrame) -> DataFrame:
    """First column whose trimmed lower-case name is a known target name;
    else the first two-valued column whose values meet the binary value set;
    else none.  One aggregation of distinct counts, then a ≤ 3-row probe per
    two-valued column."""
    spark = df.sparkSession
    for c in df.columns:
        if c.strip().lower() in TARGET_NAMES:
            return spark.createDataFrame([(c, "name")], "target string, reason string")
    cand = [f.name for f in df.schema.fields if kind_of(f.dataType) in (NUMERIC, "string", "boolean")]
    if cand:
        # exactly two distinct values ⇔ min ≠ max and nothing outside {min, max}:
        # two single-pass aggregations, no shuffle of values
        mm = df.agg(*[e for i, c in enumerate(cand) for e in (F.min(_q(c)).alias(f"a{i}"),
                                                              F.max(_q(c)).alias(f"b{i}"))]).first()
        two = [i for i in range(len(cand)) if mm[f"a{i}"] is not None and mm[f"a{i}"] != mm[f"b{i}"]]
        if two:
            other = df.agg(*[F.count(F.when((_q(cand[i]) != F.lit(mm[f"a{i}"])) &
                                            (_q(cand[i]) != F.lit(mm[f"b{i}"])), 1)).alias(f"o{i}")
                             for i in two]).first()
            texts = df.select(*[F.array(F.lower(F.lit(mm[f"a{i}"]).cast(df.schema[cand[i]].dataType).cast("string")),
                                        F.lower(F.lit(mm[f"b{i}"]).cast(df.schema[cand[i]].dataType).cast("string")))
                                .alias(f"t{i}") for i in two]).limit(1).first()
            for i in two:
                if other[f"o{i}"] == 0 and set(texts[f"t{i}"]) & set(BINARY_VALUES):
                    return spark.createDataFrame([(cand[i], "two_valued")], "target string, reason string")
    return spark.createDataFrame([(None, "none")], "target string, reason string")


def fallback_features(df: DataFrame, target: str | None) -> list[str]:
    """Every numeric column except the target."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == NUMERIC and f.name != target]


def feature_listing(prof: DataFrame, importance: DataFrame | None = None,
                    descriptions: DataFrame | None = None, selected: list[str] | None = None,
                    default_importance: float = 0.5) -> DataFrame:
    """Profile rows with approved importance (default 0.5), a user
    description and the selected flag."""
    out = prof
    if importance is not None:
        out = out.join(importance.select(F.col("feature").alias("column_name"),
                                         F.col("score").alias("importance")), "column_name", "left")
    else:
        out = out.withColumn("importance", F.lit(None).cast("double"))
    if descriptions is not None:
        out = out.join(descriptions, "column_name", "left")
    else:
        out = out.withColumn("description", F.lit(None).cast("string"))
    sel = F.col("column_name").isin(*(selected or [])) if selected else F.lit(True)
    return out.withColumn("importance", F.coalesce("importance", F.lit(default_importance))) \
        .withColumn("selected", sel)


def keyword_columns(prof: DataFrame, keywords: list[str]) -> DataFrame:
    """P10: profile rows whose column name contains any keyword."""
    pattern = "|".join(k.lower() for k in keywords)
    return prof.where(F.lower("column_name").rlike(pattern))


def derive_column(df: DataFrame, name: str, sql_expr: str) -> DataFrame:
    """A derived (target) column from a SQL expression."""
    return df.withColumn(name, F.expr(sql_expr))


def screen_features(df: DataFrame, target: str, max_null_pct: float = 60.0,
                    high_card_ratio: float = 0.9, leak: float = 0.95, dup: float = 0.98) -> DataFrame:
    """Keep / drop with a reason per feature — target, id-like name,
    > ``max_null_pct`` nulls, single-valued, very high-cardinality text,
    leakage (|corr| with target > ``leak``); of two near-duplicate numeric
    columns (|corr| > ``dup``) the one with more nulls is dropped.

    Uses one profile aggregation and one correlation aggregation."""
    prof = profile(df).select("column_name", "dtype", "null_pct", "null_count", "unique_count", "row_count")
    num = [f.name for f in df.schema.fields if kind_of(f.dataType) == NUMERIC]
    corr_rows = []
    if target in num:
        feats = [c for c in num if c != target]
        pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
        r = df.agg(*[safe_corr(_q(c), _q(target)).alias(f"t{i}") for i, c in enumerate(feats)],
                   *[safe_corr(_q(a), _q(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
                   ).first() if feats else None
        leaky = {c for i, c in enumerate(feats) if r is not None and r[f"t{i}"] is not None and abs(r[f"t{i}"]) > leak}
        nulls = {row["column_name"]: row["null_count"] for row in prof.select("column_name", "null_count").collect()}
        dupes = set()
        for i, (a, b) in enumerate(pairs):
            v = r[f"p{i}"] if r is not None else None
            if v is not None and abs(v) > dup:
                dupes.add(b if nulls.get(b, 0) >= nulls.get(a, 0) else a)
        corr_rows = [(c, c in leaky, c in dupes) for c in feats]
    spark = df.sparkSession
    flags = spark.createDataFrame(corr_rows or [("", False, False)], "column_name string, leaky boolean, duplicate boolean")
    j = prof.join(flags, "column_name", "left")
    name = F.lower("column_name")
    reason = (F.when(F.col("column_name") == target, "target")
              .when(name.isin(*ID_LIKE_NAMES), "identifier")
              .when(F.col("null_pct") > max_null_pct, "too many nulls")
              .when(F.col("unique_count") <= 1, "single value")
              .when((F.col("dtype") == "string") & (F.col("unique_count") > high_card_ratio * F.col("row_count")),
                    "high-cardinality text")
              .when(F.coalesce("leaky", F.lit(False)), "leakage")
              .when(F.coalesce("duplicate", F.lit(False)), "near-duplicate"))
    return j.select("column_name", reason.isNull().alias("keep"), F.coalesce(reason, F.lit("")).alias("reason"))
