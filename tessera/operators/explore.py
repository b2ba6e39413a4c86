"""The data behind exploratory plots.

The reference draws pictures; we return the numbers.  Every operator is a
grouped aggregation whose output is bounded by its parameters (bins, grid
points, top-k), never by the data size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import safe_corr
from tessera.functions.scalar import stable_round as sround
from tessera.functions.types import NUMERIC, kind_of
from tessera.operators.ordered import null_safe_join, row_numbers
from tessera.session import ship, written

ship(__name__)


def _q(name: str):
    return F.col(f"`{name}`")


def _range(df: DataFrame, column: str) -> tuple[float | None, float | None, int]:
    r = df.agg(F.min(_q(column)).cast("double").alias("mn"), F.max(_q(column)).cast("double").alias("mx"),
               F.count(_q(column)).alias("n")).first()
    return r["mn"], r["mx"], r["n"]


def _bin_index(x, mn: float, mx: float, bins: int):
    """0-based equal-width bin, last edge closed."""
    if mx == mn:
        return F.lit(0)
    return F.least(F.floor((x - F.lit(mn)) * F.lit(bins) / F.lit(mx - mn)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """A5: ``bins`` equal-width bins over [min, max] with counts and density
    n / (N · width); empty bins included (the bin list has ``bins`` rows)."""
    spark = df.sparkSession
    mn, mx, n = _range(df, column)
    x = _q(column).cast("double")
    if mn is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint, density double")
    width = (mx - mn) / bins if mx > mn else 1.0
    counts = (df.where(x.isNotNull()).groupBy(_bin_index(x, mn, mx, bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(counts, "bin", "left").fillna(0, ["count"])
    return out.select(
        "bin",
        (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.col("count").cast("bigint").alias("count"),
        (F.col("count") / F.lit(n * width)).alias("density"))


def kde(df: DataFrame, column: str, grid: int = 300, error: float = 1e-7) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from min to max, Scott
    bandwidth (sample deviation · n^(-1/5)).

    Linear binning: each value shares its weight between the two nearest of
    many fine bins, in proportion to how near they are.  For bins of width w
    that changes the density at no point by more than w² / 8 times the largest
    curvature of the kernel, so w follows from ``error``, the largest change
    as a share of the kernel's peak.  After the scan, tasks sum the kernel
    over their bins for the whole grid at once; ``grid`` numbers per task move.
    """
    x = _q(column).cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n"),
                F.stddev_samp(x).alias("sd")).first()
    mn, mx, n, sd = st["mn"], st["mx"], st["n"], st["sd"]
    if not n or n < 2 or not sd or mn == mx:
        return df.sparkSession.createDataFrame([], "grid_index int, x double, density double")
    bw = sd * n ** (-1.0 / 5)
    bins = math.ceil((mx - mn) / (bw * math.sqrt(8 * error)))
    w = (mx - mn) / bins
    at = (F.col("v") - F.lit(mn)) / F.lit(w)
    low = F.least(F.floor(at), F.lit(bins - 1))
    # Equal values first: what is left is at most one row per bin and task.
    shared = df.select(x.alias("v")).where("v is not null").select(low.alias("b"), (at - low).alias("part"))
    held = shared.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.sum("part").alias("up"))
    weights = held.select((F.lit(mn) + F.col("b") * F.lit(w)).alias("x0"), (F.col("c") - F.col("up")).alias("w0"), F.col("up").alias("w1"))
    points = np.linspace(mn, mx, grid) if grid > 1 else np.array([mn])

    def work(batches):
        total = np.zeros(grid)
        for batch in batches:
            x0, w0, w1 = (batch.column(c).to_numpy() for c in ("x0", "w0", "w1"))
            for k in range(0, len(x0), 4096):
                part = x0[k:k + 4096, None]
                total += w0[k:k + 4096] @ np.exp(-0.5 * ((points - part) / bw) ** 2)
                total += w1[k:k + 4096] @ np.exp(-0.5 * ((points - part - w) / bw) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid, dtype=np.int32)), pa.array(total)], ["g", "s"])

    sums = weights.mapInArrow(work, "g int, s double").groupBy("g").agg(F.sum("s").alias("s"))
    step = (mx - mn) / (grid - 1) if grid > 1 else 0.0
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    return sums.select(F.col("g").alias("grid_index"), (F.lit(mn) + F.col("g") * F.lit(step)).alias("x"),
                       (F.col("s") * F.lit(norm)).alias("density"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """N, mean, sample standard deviation of the non-null values."""
    x = _q(column)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def top_categories(df: DataFrame, column: str, k: int = 30) -> DataFrame:
    """The ``k`` most frequent values (ties by value) plus the number of categories.  The counts are written once,
    so the rows are read and grouped once for both."""
    counts = written(df.where(_q(column).isNotNull()).groupBy(_q(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")), "categories")
    n_cat = counts.count()                                   # one number
    top = counts.orderBy(F.desc("count"), "value").limit(k)
    w = Window.orderBy(F.desc("count"), "value")  # over k rows only
    return top.withColumn("rank", F.row_number().over(w)).withColumn("n_categories", F.lit(n_cat).cast("bigint"))


#: Parts of the moments of a pair of columns (x, y) over the rows that have both: count, means, squared deviations of x and y, their product.
_MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def _batch_moments(x: np.ndarray, present: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of all column pairs of one batch, as matrices. Pairs with a value that is no finite number get NaN."""
    m = present.astype(float)
    odd = present & ~np.isfinite(x)
    x = np.where(present & ~odd, x, 0.0)
    mean = x.sum(0) / np.maximum(m.sum(0), 1)
    x = np.where(present, x - mean, 0.0)
    n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
    some = np.maximum(n, 1)
    cxx = sxx - sx * sx / some
    cxx[cxx < 1e-12 * sxx] = 0.0          # all equal: nothing but rounding error is left
    out = {"n": n, "mx": mean[:, None] + sx / some, "my": (mean[:, None] + sx / some).T, "cxx": cxx, "cyy": cxx.T.copy(), "cxy": sxy - sx * sx.T / some}
    if odd.any():
        touched = (odd.astype(float).T @ m) > 0
        out["cxy"][touched | touched.T] = np.nan
    return out


def _merged(a: dict, b: dict) -> dict:
    """Moments of two sets of rows together."""
    n = a["n"] + b["n"]
    some = np.maximum(n, 1)
    share = a["n"] * b["n"] / some
    dx, dy = (np.where(share > 0, b[k] - a[k], 0.0) for k in ("mx", "my"))
    out = {"n": n, "cxx": a["cxx"] + b["cxx"] + dx * dx * share, "cyy": a["cyy"] + b["cyy"] + dy * dy * share,
           "cxy": a["cxy"] + b["cxy"] + dx * dy * share}
    for k in ("mx", "my"):
        out[k] = (a[k] * a["n"] + b[k] * b["n"]) / some
        same = a[k] == b[k]
        out[k] = np.where(same, a[k], out[k])
    return out


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair (nulls dropped per pair) as the full matrix in long form
    (row, col, r); r is null where a column does not vary.

    One scan for any number of columns: a batch of rows gives the moments of all pairs by products of the values and
    their null masks, moments of batches and tasks are merged, and one row per column and task moves."""
    cols = columns or [f.name for f in df.schema.fields if kind_of(f.dataType) == NUMERIC]
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    x = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    schema = pa.schema([("a", pa.int32()), *[(k, pa.list_(pa.float64())) for k in _MOMENTS]])

    def moments(batches):
        total = None
        for batch in batches:
            arrays = batch.columns
            present = np.stack([~c.is_null().to_numpy(zero_copy_only=False) for c in arrays], 1)
            values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in arrays], 1)
            for k in range(0, len(values), 4096):
                part = _batch_moments(values[k:k + 4096], present[k:k + 4096])
                total = part if total is None else _merged(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"a": np.arange(len(cols), dtype=np.int32), **{k: list(total[k]) for k in _MOMENTS}}, schema)

    def correlations(batches):
        at, total = None, None

        def done():
            with np.errstate(divide="ignore", invalid="ignore"):
                r = total["cxy"] / np.sqrt(total["cxx"] * total["cyy"])
            flat = np.zeros(len(r), bool)
            for c, m in (("cxx", "mx"), ("cyy", "my")):
                flat |= total[c] <= total["n"] * (4e-15 * np.abs(total[m])) ** 2
            bad = flat | ~np.isfinite(r) | (total["n"] < 2)
            r = np.where(np.arange(len(r)) == at, 1.0, np.clip(r, -1.0, 1.0))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), at, np.int32)), pa.array(np.arange(len(r), dtype=np.int32)),
                                               pa.array(r, mask=bad)], ["a", "b", "r"])
        for batch in batches:
            for i in range(batch.num_rows):
                a = batch.column("a")[i].as_py()
                row = {k: batch.column(k)[i].values.to_numpy() for k in _MOMENTS}
                if a != at and at is not None:
                    yield done()
                total = row if a != at else _merged(total, row)
                at = a
        if at is not None:
            yield done()

    parts = x.mapInArrow(moments, "a int, " + ", ".join(f"{k} array<double>" for k in _MOMENTS))
    made = parts.repartition("a").sortWithinPartitions("a").mapInArrow(correlations, "a int, b int, r double")
    grid = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("a"), F.explode(
        F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("b"))                     # an empty table has undefined entries
    names = F.array(*[F.lit(c) for c in cols])
    return grid.join(made, ["a", "b"], "left").select(F.get(names, F.col("a")).alias("row"), F.get(names, F.col("b")).alias("col"), "r")


def scatter_density(df: DataFrame, x: str, y: str, hue: str | None = None, bins: int = 20,
                    max_groups: int | None = None) -> DataFrame:
    """A10: 2-D binned counts of (x, y), optionally per hue group: all groups,
    or the ``max_groups`` most frequent ones (a semi-join on a bounded list)."""
    r = df.agg(F.min(_q(x)).cast("double").alias("x0"), F.max(_q(x)).cast("double").alias("x1"),
               F.min(_q(y)).cast("double").alias("y0"), F.max(_q(y)).cast("double").alias("y1")).first()
    data = df.where(_q(x).isNotNull() & _q(y).isNotNull())
    keys = []
    if hue:
        data = data.where(_q(hue).isNotNull())
        if max_groups is not None:
            top = (data.groupBy(_q(hue).alias("__h"))
                   .agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__h").limit(max_groups))
            data = data.join(F.broadcast(top.select("__h")), _q(hue) == F.col("__h"), "left_semi")
        keys.append(_q(hue).cast("string").alias("hue"))
    xb = _bin_index(_q(x).cast("double"), r["x0"], r["x1"], bins).alias("x_bin")
    yb = _bin_index(_q(y).cast("double"), r["y0"], r["y1"], bins).alias("y_bin")
    return data.groupBy(*keys, xb, yb).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, column: str, group_by: str | None = None) -> DataFrame:
    """Quartiles, median, whiskers (furthest data within 1.5·IQR) and
    outlier counts, optionally per group; a null group is a group of its own.

    Exact quartiles of all groups come from two scans; then the per-group
    table is joined back for the conditional min/max/count.  With few groups
    it is broadcast: shuffled by group, the rows would meet in a few tasks.
    """
    x = _q(column).cast("double")
    g = [_q(group_by).cast("string").alias("group")] if group_by else [F.lit("all").alias("group")]
    data = df.select(*g, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    from tessera.operators.quantiles import FEW_GROUPS, quantiles_long
    qs = quantiles_long(data, ["group"], "x", [0.25, 0.5, 0.75])
    n = data.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    q = written(null_safe_join(qs, n, ["group"]).select("group", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                                                        F.col("q2").alias("q3")), "boxes")
    j = null_safe_join(data, q, ["group"], small=q.count() <= FEW_GROUPS)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy("group", "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_high"),
        F.sum(F.when((F.col("x") < lo) | (F.col("x") > hi), 1).otherwise(0)).cast("bigint").alias("n_outliers"))


def crosstab(df: DataFrame, row: str, col: str, max_rows: int | None = None) -> DataFrame:
    """Row-normalised cross-tabulation in long form, for all row values
    or the first ``max_rows`` (text order)."""
    data = df.where(_q(row).isNotNull() & _q(col).isNotNull())
    counts = data.groupBy(_q(row).cast("string").alias("row_value"),
                          _q(col).cast("string").alias("col_value")).agg(F.count(F.lit(1)).alias("count"))
    if max_rows is not None:
        first = counts.select("row_value").distinct().orderBy("row_value").limit(max_rows)
        counts = counts.join(F.broadcast(first), "row_value", "left_semi")
    w = Window.partitionBy("row_value")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(w))


def target_analysis(df: DataFrame, target: str, features: list[str]) -> dict[str, DataFrame]:
    """Per feature choose scatter (num × num), box (num × cat either way)
    or cross-tab (cat × cat); unknown columns give an error entry."""
    out: dict[str, DataFrame] = {}
    tk = kind_of(df.schema[target].dataType) if target in df.columns else None
    for f in features:
        if f not in df.columns or tk is None:
            out[f] = df.sparkSession.createDataFrame([(f"column not found: {f if tk else target}",)],
                                                     "error string")
            continue
        fk = kind_of(df.schema[f].dataType)
        t_num = tk == NUMERIC and _n_distinct_over(df, target, 10)
        if fk == NUMERIC and t_num:
            out[f] = scatter_density(df, f, target)
        elif fk == NUMERIC:
            out[f] = box_stats(df, f, target)
        elif t_num:
            out[f] = box_stats(df, target, f)
        else:
            out[f] = crosstab(df, f, target)
    return out


def analysis_table(parts: dict[str, DataFrame]) -> DataFrame:
    """The analyses of several features as one table: ``feature`` and the typed columns of all kinds of analysis that occur."""
    made = [df.select(F.lit(f).alias("feature"), "*") for f, df in parts.items()]
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _n_distinct_over(df: DataFrame, column: str, k: int) -> bool:
    """True when the column has more than ``k`` distinct values (bounded probe)."""
    return df.select(_q(column)).distinct().limit(k + 1).count() > k


def auto_features(df: DataFrame, target: str, k: int | None = None) -> list[str]:
    """All numeric non-target columns, or the first ``k`` (schema order)."""
    return [f.name for f in df.schema.fields
            if kind_of(f.dataType) == NUMERIC and f.name != target][:k]


def feature_ranking(df: DataFrame, target: str, features: list[str] | None = None,
                    text_score: float = 0.3, include_above: float = 0.01) -> DataFrame:
    """|corr(feature, target)| in one aggregation, rounded to 3 places,
    capped at 1; text features get ``text_score``; included above
    ``include_above``; sorted by score.

    A text target is label-encoded first (code = rank of the value among the
    distinct values, via a join on the distinct-value table).
    """
    feats = [c for c in (features or df.columns) if c != target]
    y = _q(target)
    if kind_of(df.schema[target].dataType) != NUMERIC:
        codes = label_codes(df, target)
        df = df.join(codes, y == F.col("__v"), "left")
        y = F.col("__code").cast("double")
    num = [c for c in feats if kind_of(df.schema[c].dataType) == NUMERIC]
    txt = [c for c in feats if c not in num]
    cells = []
    if num:
        one = df.agg(*[safe_corr(_q(c), y).alias(f"r{i}") for i, c in enumerate(num)])
        cells = [F.struct(F.lit(c).alias("feature"),
                          F.least(sround(F.abs(F.col(f"r{i}")), 3), F.lit(1.0)).alias("score"))
                 for i, c in enumerate(num)]
        scored = one.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
    else:
        scored = None
    if txt:
        t = df.sparkSession.createDataFrame([(c, float(text_score)) for c in txt], "feature string, score double")
        scored = t if scored is None else scored.unionByName(t)
    scored = scored.fillna(0.0, ["score"])
    return scored.withColumn("included", F.col("score") > include_above).orderBy(F.desc("score"), "feature")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Code = rank of the value among the distinct values (text order), for any number of values."""
    values = df.select(_q(column).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    return row_numbers(values, [F.col("__v")], [], "__n").select("__v", (F.col("__n") - 1).alias("__code"))


def base_rate(df: DataFrame, target: str, default: float = 0.25) -> DataFrame:
    """Share of the smaller class of a two-class column, else ``default``."""
    counts = df.where(_q(target).isNotNull()).groupBy(_q(target)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("mn"), F.sum("n").alias("tot")).select(
        F.when(F.col("n_classes") == 2, sround(F.col("mn") / F.col("tot"), 6))
        .otherwise(F.lit(default)).alias("base_rate"))


def group_means(df: DataFrame, category: str, value: str) -> DataFrame:
    """Mean of ``value`` per category."""
    return df.groupBy(_q(category).alias(category)).agg(F.avg(_q(value)).alias(f"mean_{value}"),
                                                        F.count(F.lit(1)).alias("n"))
