"""Column profiles and table-level characteristics.

A profile over k columns is ONE aggregation (partial on each partition,
merged after one small shuffle) followed by an explode of the single result
row into one row per column — never k jobs.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import stable_round as sround
from tessera.functions.types import DATETIME, NUMERIC, STRING, dtype_name, kind_of
from tessera.session import ship

ship(__name__)


def _q(name: str):
    return F.col(f"`{name}`")


def profile(df: DataFrame, string_minmax: bool = False, approx_distinct: bool = False,
            rsd: float = 0.01, known_distinct: dict[int, int] | None = None) -> DataFrame:
    """A1/A3: one row per column.

    Columns: position, column_name, dtype, null_count, null_pct (2 dp),
    unique_count (distinct non-null), min_value / max_value as text (numeric
    and datetime; text too when ``string_minmax``), mean_value (numeric).

    ``approx_distinct`` swaps the exact distinct count (one Expand of the
    input per column) for HyperLogLog++, a single pass — the choice for very
    wide or very large tables.
    """
    fields = df.schema.fields
    # exact distinct counts: one narrow branch per column, k numbers back
    exact_nd = ({} if approx_distinct else known_distinct if known_distinct is not None else
                {r["__pos"]: r["__nd"] for r in distinct_counts(df).collect()})
    aggs = [F.count(F.lit(1)).alias("__rows")]
    cells = []
    for i, f in enumerate(fields):
        c = _q(f.name)
        kind = kind_of(f.dataType)
        aggs.append(F.count(c).alias(f"__nn{i}"))
        if approx_distinct:
            aggs.append(F.approx_count_distinct(c, rsd).alias(f"__nd{i}"))
        has_minmax = kind in (NUMERIC, DATETIME) or (string_minmax and kind == STRING)
        if has_minmax:
            aggs += [F.min(c).cast("string").alias(f"__mn{i}"),
                     F.max(c).cast("string").alias(f"__mx{i}")]
        if kind == NUMERIC:
            aggs.append(F.avg(c).alias(f"__av{i}"))
        cells.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(dtype_name(f.dataType)).alias("dtype"),
            F.col(f"__nn{i}").alias("non_null"),
            (F.col(f"__nd{i}") if approx_distinct else F.lit(exact_nd.get(i, 0))).cast("bigint")
            .alias("unique_count"),
            (F.col(f"__mn{i}") if has_minmax else F.lit(None).cast("string")).alias("min_value"),
            (F.col(f"__mx{i}") if has_minmax else F.lit(None).cast("string")).alias("max_value"),
            (F.col(f"__av{i}") if kind == NUMERIC else F.lit(None).cast("double")).alias("mean_value"),
        ))
    one = df.agg(*aggs)
    rows = one.select(F.col("__rows"), F.explode(F.array(*cells)).alias("p"))
    return rows.select(
        F.col("p.position").alias("position"),
        F.col("p.column_name").alias("column_name"),
        F.col("p.dtype").alias("dtype"),
        (F.col("__rows") - F.col("p.non_null")).alias("null_count"),
        sround(F.when(F.col("__rows") > 0,
                       (F.col("__rows") - F.col("p.non_null")) * 100.0 / F.col("__rows"))
                .otherwise(F.lit(0.0)), 2).alias("null_pct"),
        F.col("p.unique_count").alias("unique_count"),
        F.col("p.min_value").alias("min_value"),
        F.col("p.max_value").alias("max_value"),
        F.col("p.mean_value").alias("mean_value"),
        F.col("__rows").alias("row_count"),
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct non-null count per column as (__pos, __nd) rows.

    One narrow branch per column — it reads only that column, de-duplicates
    per partition and shuffles just the distinct values — unioned into one
    job.  (``count(DISTINCT a), count(DISTINCT b), …`` in one aggregation
    makes Spark Expand every row once per column, shuffling k full-width
    copies of the table.)  The result has one row per column, so the join
    back is a broadcast of a table bounded by the column count.
    """
    cols = columns or df.columns
    parts = [df.select(_q(c).alias("v")).where(F.col("v").isNotNull()).distinct()
             .agg(F.count(F.lit(1)).alias("__nd")).select(F.lit(i).alias("__pos"), "__nd")
             for i, c in enumerate(cols)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _long_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, v) with every value as text — the input of per-column ranking."""
    cols = columns or df.columns
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("v"))
        for c in cols])).alias("e")).select("e.column_name", "e.v")


def sample_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """A2: the first ``k`` distinct non-null values of each column, in text order.

    Spark has no file order, so "first" is the smallest text.  One scan: each
    task keeps the ``k`` smallest distinct values of every column (merged
    batch by batch), and the ``k`` smallest of those of all tasks remain.
    """
    cols = columns or df.columns
    text = df.select(*[_q(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])

    def smallest(batches):
        kept = [pa.array([], pa.string()) for _ in cols]
        for batch in batches:
            for i, c in enumerate(batch.columns):
                seen = pc.unique(pa.chunked_array([kept[i], c.drop_null().cast(pa.string())]))
                kept[i] = seen.take(pc.sort_indices(seen)[:k])
        for i, c in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(c), pa.int32()), c], ["c", "v"])

    found = text.mapInArrow(smallest, "c int, v string").distinct()
    nth = F.row_number().over(Window.partitionBy("c").orderBy("v"))          # at most k rows of each task
    first = found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("c").agg(F.array_sort(F.collect_list("v")).alias("sample_values"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "c int, column_name string")
    return names.join(first, "c", "left").select("column_name", F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"))


def first_values(df: DataFrame, order_by: list[str], k: int = 5) -> DataFrame:
    """A3: the values of the first ``k`` rows by ``order_by`` (duplicates kept)."""
    head = df.orderBy(*order_by).limit(k).withColumn(
        "__pos", F.row_number().over(Window.orderBy(*order_by)))
    long = head.select("__pos", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("v"))
        for c in df.columns])).alias("e")).select("__pos", "e.column_name", "e.v")
    return long.groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__pos", "v"))),
                    lambda s: s["v"]).alias("sample_values"))


def profile_with_samples(df: DataFrame, k: int = 5, **kw) -> DataFrame:
    """A1 + A2 joined: the full column profile of the reference."""
    return profile(df, **kw).join(sample_values(df, k), "column_name", "left")


def profile_tables(tables: dict[str, DataFrame], **kw) -> DataFrame:
    """A4: profiles of several tables, one plan, with a table column."""
    known = {name: None for name in tables}
    if not kw.get("approx_distinct"):
        # every table's distinct counts in ONE job (a union of narrow branches)
        parts = [distinct_counts(df).select(F.lit(name).alias("__t"), "__pos", "__nd")
                 for name, df in tables.items()]
        allnd = parts[0]
        for p in parts[1:]:
            allnd = allnd.unionByName(p)
        known = {name: {} for name in tables}
        for r in allnd.collect():
            known[r["__t"]][r["__pos"]] = r["__nd"]
    out = None
    for name, df in tables.items():
        p = profile(df, known_distinct=known[name], **kw).select(F.lit(name).alias("table_name"), "*")
        out = p if out is None else out.unionByName(p)
    return out


def null_ranking(prof: DataFrame, flag_pct: float = 30.0) -> DataFrame:
    """Columns by null share, highest first, flagged above ``flag_pct``."""
    return prof.select("column_name", "null_count", "null_pct",
                       (F.col("null_pct") > flag_pct).alias("high_nulls")
                       ).orderBy(F.desc("null_pct"), "column_name")


def target_stats(df: DataFrame, target: str, max_classes: int = 10) -> DataFrame:
    """Distinct count, null %, dtype and — when there are at most
    ``max_classes`` classes — the class counts as a map."""
    t = _q(target)
    dt = dtype_name(df.schema[target].dataType)
    counts = df.groupBy(t.alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    summary = counts.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("cls").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count("cls").alias("n_distinct"))
    # The class map is built from at most max_classes + 1 groups (TakeOrdered),
    # so a high-cardinality target never lands whole in one task.
    few = (counts.where(F.col("cls").isNotNull()).orderBy("cls").limit(max_classes + 1)
           .select(F.col("cls").cast("string").alias("k"), "n").collect())
    dist = (F.create_map(*[e for r in few for e in (F.lit(r["k"]), F.lit(r["n"]).cast("bigint"))])
            if few else F.create_map()).cast("map<string,bigint>")
    return summary.withColumn("_dist", dist).select(
        F.lit(target).alias("target"), F.lit(dt).alias("dtype"),
        F.col("n_distinct"),
        sround(F.col("n_null") * 100.0 / F.greatest(F.col("n_rows"), F.lit(1)), 2).alias("null_pct"),
        F.when(F.col("n_distinct") <= max_classes, F.col("_dist")).alias("class_counts"))


def data_characteristics(df: DataFrame, target: str | None, high_card: int = 20) -> DataFrame:
    """Rows, features, numeric vs categorical counts, high-cardinality
    columns (> ``high_card`` distinct), class balance of the target."""
    prof = profile(df)
    feats = prof.where(F.col("column_name") != F.lit(target or ""))
    num_types = ("tinyint", "smallint", "int", "bigint", "float", "double")
    base = feats.agg(
        F.max("row_count").alias("n_rows"),
        F.count(F.lit(1)).alias("n_features"),
        F.sum(F.when(F.col("dtype").isin(*num_types) | F.col("dtype").startswith("decimal"), 1)
              .otherwise(0)).cast("bigint").alias("n_numeric"),
        F.sum(F.when(F.col("dtype") == "string", 1).otherwise(0)).cast("bigint").alias("n_categorical"),
        F.sort_array(F.collect_list(F.when((F.col("dtype") == "string") &
                                           (F.col("unique_count") > high_card),
                                           F.col("column_name")))).alias("high_cardinality"))
    if target is None:
        return base.withColumn("class_balance", F.lit(None).cast("double"))
    cb = class_balance(df, target).first()["class_balance"]   # one number
    return base.withColumn("class_balance", F.lit(cb).cast("double"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Minority / majority class ratio (grouped counts, then min / max)."""
    counts = df.where(_q(target).isNotNull()).groupBy(_q(target)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("n").alias("minority"), F.max("n").alias("majority"),
        sround(F.min("n") / F.max("n"), 6).alias("class_balance"))


def quality_flags(df: DataFrame, high_null_pct: float = 30.0) -> DataFrame:
    """Per column — share of values outside 1.5·IQR (numeric), constant,
    high nulls, and whether the column alone is a grain (unique, never null).

    Two passes: one aggregation for quartiles/counts, one for outlier counts
    against the quartiles (cross-joined from a one-row table).
    """
    fields = df.schema.fields
    num = [f.name for f in fields if kind_of(f.dataType) == NUMERIC]
    prof = profile(df)
    if num:
        # Fit: quartiles of every numeric column in one aggregation; only
        # 2·k numbers reach the driver.
        from tessera.operators.quantiles import column_quantiles
        q = column_quantiles(df, num, [0.25, 0.75])
        bounds = []
        for c in num:
            q1, q3 = q[c]
            bounds.append((None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
        outs = df.agg(*[F.sum(F.when((_q(c) < F.lit(lo)) | (_q(c) > F.lit(hi)), 1).otherwise(0))
                        .cast("bigint").alias(f"__o{i}")
                        for i, (c, (lo, hi)) in enumerate(zip(num, bounds))])
        ol = outs.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"__o{i}").alias("n_outliers"))
            for i, c in enumerate(num)])).alias("e")).select("e.*")
        prof = prof.join(ol, "column_name", "left")
    else:
        prof = prof.withColumn("n_outliers", F.lit(None).cast("bigint"))
    return prof.select(
        "column_name",
        sround(F.col("n_outliers") * 100.0 / F.greatest(F.col("row_count"), F.lit(1)), 4).alias("outlier_pct"),
        (F.col("unique_count") <= 1).alias("is_constant"),
        (F.col("null_pct") > high_null_pct).alias("high_nulls"),
        ((F.col("unique_count") == F.col("row_count")) & (F.col("null_count") == 0)).alias("is_grain"))
