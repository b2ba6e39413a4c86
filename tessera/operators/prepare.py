"""Imputation, encoding, scaling and feature construction.

Every transform is fit-then-apply: the fit is ONE aggregation over all
requested columns whose few numbers come to the driver (like a fitted MLlib
model); the apply is a projection that stays in whole-stage codegen and can
be replayed on validation, test or scoring data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.types import NUMERIC, kind_of
from tessera.operators.ordered import null_safe_join, row_numbers
from tessera.operators.quantiles import column_quantiles
from tessera.session import cut_lineage, written


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# ---------------------------------------------------------------- P4 / E1 --

def null_shares(df: DataFrame, columns: list[str] | None = None) -> dict[str, float]:
    """Share of nulls per column from one aggregation (all rows)."""
    cols = columns or df.columns
    row = df.agg(*[F.avg(_q(c).isNull().cast("double")).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: (row[f"c{i}"] or 0.0) for i, c in enumerate(cols)}


def drop_high_null_columns(df: DataFrame, threshold: float = 0.5,
                           protect: list[str] = ()) -> DataFrame:
    """Drop columns whose null share exceeds ``threshold`` (never ``protect``)."""
    shares = null_shares(df)
    drop = [c for c, s in shares.items() if s > threshold and c not in protect]
    return df.drop(*drop)


# ------------------------------------------------------------ W1 / W2 fill --

def fill_along(df: DataFrame, columns: list[str], order_by: list[str],
               keys: list[str] = (), backward: bool = False,
               partitions: int | None = None) -> DataFrame:
    """Forward (or backward) fill along ``order_by`` within ``keys``.

    Skew-safe and without a single-partition window even when ``keys`` is
    empty or one key holds a third of the rows:

    1. range-partition on (keys, order) so a hot key is split over several
       contiguous partitions, and tag rows with their partition id;
    2. per (partition, key) take the last non-null value of every column
       (one aggregation, one row per partition-key pair);
    3. carry values into the next partitions with a window over that small
       table; only the first key of a partition can continue from an
       earlier partition, so at most one carry row per partition survives
       and is broadcast (bounded by the partition count);
    4. fill inside each (partition, key) group with an ordinary window and
       fall back to the carried value.
    """
    keys = list(keys)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(f"`{o}`").desc_nulls_last() if backward else F.col(f"`{o}`").asc_nulls_first()
                  for o in order_by]
    key_cols = [_q(k) for k in keys]
    # Range bounds are sampled per exchange, so the partition ids must be
    # pinned before two branches read them: a reliable checkpoint into the
    # shared folder (also cuts lineage, so a lost executor does not replay
    # the sort).
    ranged = cut_lineage(df.repartitionByRange(n, *key_cols, *order_cols)
                         .withColumn("__pid", F.spark_partition_id()))
    seq = F.struct(*[_q(o) for o in order_by])
    pick = F.max if not backward else F.min
    stats = ranged.groupBy("__pid", *key_cols).agg(
        *[pick(F.when(_q(c).isNotNull(), F.struct(seq.alias("s"), _q(c).alias("v")))).alias(f"__l{i}")
          for i, c in enumerate(columns)])
    # partitions are numbered in processing order (the range sort already
    # runs backwards for a backward fill)
    wk = Window.partitionBy(*key_cols).orderBy("__pid")
    prior = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = stats.select("__pid", *key_cols, *[
        F.last(F.col(f"__l{i}.v"), ignorenulls=True).over(prior).alias(f"__c{i}")
        for i in range(len(columns))])
    has_carry = F.lit(False)
    for i in range(len(columns)):
        has_carry = has_carry | F.col(f"__c{i}").isNotNull()
    carry = carry.where(has_carry)
    joined = null_safe_join(ranged, carry, ["__pid", *keys], "left", small=True)
    wf = (Window.partitionBy("__pid", *key_cols).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined
    for i, c in enumerate(columns):
        out = out.withColumn(c, F.coalesce(F.last(_q(c), ignorenulls=True).over(wf), F.col(f"__c{i}")))
    return out.select(*[_q(c) for c in df.columns])


# -------------------------------------------------------- E1-E8 imputation --

STRATEGIES = ("drop", "mean", "median", "mode", "forward_fill", "backward_fill", "constant")


@dataclass
class MissingReport:
    changes: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def mode_value(df: DataFrame, column: str):
    """Most frequent non-null value, ties to the smallest.

    Grouped counts first (partial aggregation), then a TakeOrdered of one
    row — no per-group value map is held in a single task.
    """
    r = (df.where(_q(column).isNotNull()).groupBy(_q(column).alias("v"))
         .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("v")).limit(1).first())
    return None if r is None else r["v"]


def mode_values(df: DataFrame, columns: list[str], at_once: int = 32) -> dict:
    """E4 for several columns: one scan counts the values of up to ``at_once`` columns as grouping sets, and one row per
    column, its most frequent non-null value (ties to the smallest), reaches the driver."""
    found = {c: None for c in columns}
    for k in range(0, len(columns), at_once):
        names = {f"v{i}": c for i, c in enumerate(columns[k:k + at_once])}
        counts = (df.select(*[_q(c).alias(v) for v, c in names.items()])
                  .groupingSets([[F.col(v)] for v in names], *[F.col(v) for v in names])
                  .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")).where(" or ".join(f"{v} is not null" for v in names)))
        for r in counts.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("less"), *names)).alias("best")).collect():
            found.update({c: r["best"][v] for v, c in names.items() if r["best"][v] is not None})
    return found


def handle_missing(df: DataFrame, strategy: dict[str, str], order_by: list[str] | None = None,
                   keys: list[str] = ()) -> tuple[DataFrame, MissingReport]:
    """Apply a per-column strategy map in order.

    ``drop`` removes rows (later means see fewer rows); ``mean`` / ``median``
    (numeric only) and ``mode`` come from aggregations over the table as it
    is at that step; ``constant:VALUE`` (also ``unknown``) fills a typed
    literal; fills along ``order_by`` (within ``keys``) use W1/W2.
    """
    from tessera.operators.dtypes import typed_constant
    rep = MissingReport()
    out = df
    pending: dict[str, Column] = {}
    items = list(strategy.items())

    def flush():
        nonlocal out, pending
        if pending:
            out = out.select(*[pending.get(c, _q(c)).alias(c) for c in out.columns])
            pending = {}

    # batch all mean/median statistics of a run without drops into one agg
    i = 0
    while i < len(items):
        run, ffill, bfill = [], [], []
        while i < len(items) and items[i][1] != "drop":
            run.append(items[i])
            i += 1
        stat_cols = [(c, s) for c, s in run if s in ("mean", "median") and c in out.columns
                     and kind_of(out.schema[c].dataType) == NUMERIC]
        stats = {}
        means = [c for c, s in stat_cols if s == "mean"]
        medians = [c for c, s in stat_cols if s == "median"]
        present = list(dict.fromkeys(c for c, _s in run if c in out.columns))
        nulls = {}
        if means or present:
            # one aggregation: the means and how many values each step fills
            row = out.agg(*[F.avg(_q(c)).alias(f"s{j}") for j, c in enumerate(means)],
                          *[F.sum(_q(c).isNull().cast("long")).alias(f"z{j}") for j, c in enumerate(present)]
                          ).first()
            stats.update({c: row[f"s{j}"] for j, c in enumerate(means)})
            nulls = {c: row[f"z{j}"] or 0 for j, c in enumerate(present)}
        if medians:
            stats.update({c: v[0] for c, v in column_quantiles(out, medians, [0.5]).items()})
        modes = mode_values(out, [c for c, s in run if s == "mode" and c in out.columns])
        for c, s in run:
            if c not in out.columns:
                rep.errors.append(f"column not found: {c}")
                continue
            if s in ("mean", "median"):
                if kind_of(out.schema[c].dataType) != NUMERIC:
                    rep.errors.append(f"{s} needs a numeric column: {c}")
                    continue
                pending[c] = F.coalesce(_q(c), F.lit(stats[c]).cast(out.schema[c].dataType))
            elif s == "mode":
                pending[c] = F.coalesce(_q(c), F.lit(modes[c]).cast(out.schema[c].dataType))
            elif s.startswith("constant:") or s == "unknown":
                lit = typed_constant(out, c, s if s != "unknown" else "constant:unknown")
                pending[c] = F.coalesce(_q(c), lit)
            elif s in ("forward_fill", "backward_fill"):
                if not order_by:
                    rep.errors.append(f"{s} needs an explicit order: {c}")
                    continue
                # fills only read their own column: batch them per direction
                (bfill if s == "backward_fill" else ffill).append(c)
            else:
                rep.errors.append(f"unknown strategy {s!r} for {c}")
                continue
            rep.changes.append({"column": c, "strategy": s, "n_filled": nulls.get(c, 0)})
        flush()
        if ffill:
            out = fill_along(out, ffill, order_by, keys)
        if bfill:
            out = fill_along(out, bfill, order_by, keys, backward=True)
        if i < len(items):
            c, s = items[i]
            if c in out.columns:
                removed = out.agg(F.sum(_q(c).isNull().cast("long"))).first()[0] or 0
                out = out.dropna(subset=[c])
                rep.changes.append({"column": c, "strategy": s, "n_removed": removed})
            else:
                rep.errors.append(f"column not found: {c}")
            i += 1
    return out, rep


def default_strategies(df: DataFrame, overrides: dict[str, str] | None = None,
                       target: str | None = None) -> dict[str, str]:
    """Numeric → median, other → mode, only for columns holding nulls;
    ``overrides`` win."""
    shares = null_shares(df)
    plan = {}
    for f in df.schema.fields:
        if f.name == target or shares[f.name] == 0:
            continue
        plan[f.name] = "median" if kind_of(f.dataType) == NUMERIC else "mode"
    plan.update(overrides or {})
    return plan


# --------------------------------------------------------- E9-E13 encoders --

@dataclass
class Encoder:
    method: str
    column: str
    categories: list = field(default_factory=list)
    means: dict | None = None
    drop_first: bool = False
    #: Many categories: a written dictionary (value, code or mean) that is joined by value instead of literals.
    table: DataFrame | None = None
    size: int = 0

    @property
    def vector(self) -> str | None:
        """Name of the sparse vector column that a wide one-hot encoding gives."""
        return f"{self.column}_onehot" if self.table is not None and self.method == "one_hot" else None

    def names(self) -> list[str]:
        """Names of the one-hot features, in order."""
        if self.table is None:
            return [f"{self.column}_{v}" for v in self.categories[int(self.drop_first):]]
        return [f"{self.column}_{r['value']}" for r in self.table.where(F.col("code") >= int(self.drop_first)).orderBy("code").collect()]

    def _by_table(self, df: DataFrame) -> DataFrame:
        value = _q(self.column).cast("string")
        if self.method == "ordinal":
            value = F.coalesce(value, F.lit("nan"))
        known = self.table.select(F.col("value").alias("__value"), F.col(self.table.columns[1]).alias("__code"))
        out = df.withColumn("__v", value).join(known, F.col("__v") == F.col("__value"), "left").drop("__v", "__value")
        if self.method == "one_hot":
            from pyspark.ml.feature import OneHotEncoder
            width = self.size - int(self.drop_first)
            place = F.when(F.col("__code") >= int(self.drop_first), F.col("__code") - int(self.drop_first)).otherwise(width)
            one = OneHotEncoder(inputCols=["__at"], outputCols=[self.vector], handleInvalid="keep").fit(
                df.sparkSession.range(1).select(F.lit(float(width - 1)).alias("__at")))      # other values: no entry
            return one.transform(out.withColumn("__at", place.cast("double"))).drop("__at", "__code", self.column)
        if self.method == "ordinal":
            return out.withColumn(self.column, F.coalesce("__code", F.lit(-1)).cast("bigint")).drop("__code")
        return out.withColumn(self.column, F.col("__code").cast("double" if self.method == "target" else "bigint")).drop("__code")

    def transform(self, df: DataFrame) -> DataFrame:
        if self.table is not None:
            return self._by_table(df)
        c = _q(self.column)
        if self.method == "one_hot":
            cats = self.categories[1:] if self.drop_first else self.categories
            new = [F.when(c == F.lit(v), 1).otherwise(0).alias(f"{self.column}_{v}") for v in cats]
            return df.select(*[_q(x) for x in df.columns if x != self.column], *new)
        if self.method in ("label", "ordinal"):
            m = F.create_map(*[e for i, v in enumerate(self.categories) for e in (F.lit(v), F.lit(i))])
            if self.method == "label":
                code = F.element_at(m, c.cast("string"))
            else:
                code = F.coalesce(F.element_at(m, F.coalesce(c.cast("string"), F.lit("nan"))), F.lit(-1))
            return df.withColumn(self.column, code.cast("bigint"))
        if self.method == "target":
            m = F.create_map(*[e for k, v in self.means.items() for e in (F.lit(k), F.lit(v))])
            return df.withColumn(self.column, F.element_at(m, c.cast("string")).cast("double"))
        raise ValueError(self.method)


def fit_encoder(df: DataFrame, column: str, method: str, target: str | None = None,
                max_categories: int = 1000, drop_first: bool = False) -> Encoder:
    """Learn the category list (text order) or the target means.

    Up to ``max_categories`` of them are read to the driver and become literals of the plan.  More stay in a written
    dictionary: codes and means are joined by value, and a one-hot encoding becomes one sparse vector column.  The
    numbers are the same either way.
    """
    c = _q(column)
    if method in ("one_hot", "label", "ordinal"):
        src = c.cast("string")
        if method == "ordinal":
            src = F.coalesce(src, F.lit("nan"))
        values = df.select(src.alias("value")).where(F.col("value").isNotNull()).distinct()
        vals = values.orderBy("value").limit(max_categories + 1).collect()
        if len(vals) <= max_categories:
            return Encoder(method, column, [r["value"] for r in vals], drop_first=drop_first)
        codes = row_numbers(values, [F.col("value")], [], "code").select("value", (F.col("code") - 1).alias("code"))
        table = written(codes, "dictionary")
        return Encoder(method, column, drop_first=drop_first, table=table, size=table.count())
    if method == "target":
        if target is None or kind_of(df.schema[target].dataType) != NUMERIC:
            raise ValueError("target encoding needs a numeric target")
        means = df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.avg(_q(target)).alias("mean"))
        rows = means.limit(max_categories + 1).collect()
        if len(rows) <= max_categories:
            return Encoder(method, column, means={r["value"]: r["mean"] for r in rows})
        return Encoder(method, column, table=written(means, "dictionary"))
    raise ValueError(f"unknown encoding {method!r}")


def target_encode_join(df: DataFrame, column: str, target: str) -> DataFrame:
    """E12 for high-cardinality columns: per-category means joined back
    (no driver round trip; AQE broadcasts the means when they are small)."""
    means = df.groupBy(_q(column).alias("__k")).agg(F.avg(_q(target)).alias("__m"))
    return (df.join(means, _q(column).eqNullSafe(F.col("__k")), "left")
            .withColumn(column, F.when(_q(column).isNotNull(), F.col("__m")))
            .drop("__k", "__m"))


def auto_encoding(df: DataFrame, columns: list[str], overrides: dict[str, str] | None = None,
                  target: str | None = None, one_hot_below: int = 10) -> dict[str, str]:
    """One-hot under ``one_hot_below`` distinct values, else label;
    overrides win; the target is never encoded.  One aggregation."""
    cols = [c for c in columns if c != target]
    if not cols:
        return {}
    from tessera.operators.profile import distinct_counts
    # HyperLogLog first (one pass, no shuffle); exact narrow counts only for
    # the columns whose estimate is anywhere near the cut-off
    est = df.agg(*[F.approx_count_distinct(_q(c), 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    near = [c for i, c in enumerate(cols) if est[f"d{i}"] < 2 * one_hot_below + 10]
    exact = {}
    if near:
        exact = {near[r["__pos"]]: r["__nd"] for r in distinct_counts(df, near).collect()}
    plan = {c: ("one_hot" if exact.get(c, one_hot_below) < one_hot_below else "label") for c in cols}
    plan.update({k: v for k, v in (overrides or {}).items() if k != target})
    return plan


# ---------------------------------------------------------- E14-E17 scalers --

@dataclass
class Scaler:
    method: str
    params: dict

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, p in self.params.items():
            x = _q(c).cast("double")
            if self.method == "standard":
                exprs[c] = (x - F.lit(p[0])) / F.lit(p[1] if p[1] else 1.0)
            elif self.method == "minmax":
                rng = p[1] - p[0]
                exprs[c] = (x - F.lit(p[0])) / F.lit(rng) if rng else F.when(x.isNotNull(), F.lit(0.0))
            elif self.method == "robust":
                iqr = p[2] - p[0]
                exprs[c] = (x - F.lit(p[1])) / F.lit(iqr if iqr else 1.0)
            elif self.method == "log":
                shift = abs(p[0]) + 1 if p[0] is not None and p[0] <= 0 else 0.0
                exprs[c] = F.log1p(x + F.lit(shift))
        return df.select(*[exprs[c].alias(c) if c in exprs else _q(c) for c in df.columns])


def fit_scaler(df: DataFrame, columns: list[str], method: str) -> Scaler:
    """E14 standard (population deviation, 0 → 1), E15 min-max (constant → 0),
    E16 robust (exact interpolated quartiles), E17 log (shift by |min|+1
    when min ≤ 0).  One aggregation for all columns; non-numeric skipped."""
    cols = [c for c in columns if c in df.columns and kind_of(df.schema[c].dataType) == NUMERIC]
    if not cols:
        return Scaler(method, {})
    if method == "robust":
        q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
        return Scaler(method, {c: tuple(v if v[0] is not None else (0.0, 0.0, 0.0)) for c, v in q.items()})
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        elif method == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        elif method == "log":
            aggs += [F.min(x).alias(f"a{i}")]
        else:
            raise ValueError(f"unknown scaling {method!r}")
    r = df.agg(*aggs).first()
    params = {}
    for i, c in enumerate(cols):
        if method in ("standard", "minmax"):
            params[c] = (r[f"a{i}"], r[f"b{i}"])
        else:
            params[c] = (r[f"a{i}"],)
    return Scaler(method, params)


# ------------------------------------------------------- E19-E21 features --

def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2,
                        interaction_only: bool = False) -> DataFrame:
    """Append every new term of degree 2..d (nulls as 0), named
    ``a^2``, ``a b``, ``a^2 b``; ``interaction_only`` keeps products of
    distinct columns.  Unknown or non-numeric columns raise."""
    bad = [c for c in columns if c not in df.columns or kind_of(df.schema[c].dataType) != NUMERIC]
    if bad:
        raise ValueError(f"not numeric or missing: {', '.join(bad)}")
    new = []
    for d in range(2, degree + 1):
        combos = combinations(columns, d) if interaction_only else combinations_with_replacement(columns, d)
        for combo in combos:
            expr = None
            for c in combo:
                v = F.coalesce(_q(c).cast("double"), F.lit(0.0))
                expr = v if expr is None else expr * v
            parts = []
            for c in dict.fromkeys(combo):
                k = combo.count(c)
                parts.append(c if k == 1 else f"{c}^{k}")
            new.append(expr.alias(" ".join(parts)))
    return df.select("*", *new)


def create_polynomial_features(df: DataFrame, columns: list[str], degree: int = 2,
                               interaction_only: bool = False) -> tuple[DataFrame | None, list[str]]:
    """E19 with the tool's error handling: unknown or non-numeric columns are
    reported and skipped; with no usable column the result is a failure
    (``None``) plus the errors."""
    errors = []
    ok = []
    for c in columns:
        if c not in df.columns:
            errors.append(f"column not found: {c}")
        elif kind_of(df.schema[c].dataType) != NUMERIC:
            errors.append(f"not numeric: {c}")
        else:
            ok.append(c)
    if not ok:
        return None, errors + ["no numeric columns to expand"]
    return polynomial_features(df, ok, degree, interaction_only), errors


def interaction_features(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a_x_b`` = a · b with nulls as 0."""
    bad = [c for p in pairs for c in p
           if c not in df.columns or kind_of(df.schema[c].dataType) != NUMERIC]
    if bad:
        raise ValueError(f"not numeric or missing: {', '.join(sorted(set(bad)))}")
    return df.select("*", *[(F.coalesce(_q(a).cast("double"), F.lit(0.0)) *
                             F.coalesce(_q(b).cast("double"), F.lit(0.0))).alias(f"{a}_x_{b}")
                            for a, b in pairs])


def feature_chain(df: DataFrame, target: str | None = None, poly_columns: list[str] | None = None,
                  degree: int = 2, pairs: list[tuple[str, str]] | None = None,
                  scale: str = "standard") -> DataFrame:
    """Polynomial terms (given columns or all numeric ones),
    then interactions, then scaling of the ORIGINAL numeric columns."""
    num = [f.name for f in df.schema.fields if kind_of(f.dataType) == NUMERIC and f.name != target]
    poly = poly_columns or num
    out = polynomial_features(df, poly, degree) if poly else df
    if pairs:
        out = interaction_features(out, pairs)
    return fit_scaler(out, num, scale).transform(out) if scale else out


# ----------------------------------------------------- E22 declared steps --

@dataclass
class Step:
    kind: str            # impute | encode | scale
    columns: list[str]
    method: str


class StepChain:
    """A declared list of impute / encode / scale steps fitted in order
    and replayable on other data (validation, test, scoring)."""

    def __init__(self, steps: list[Step], order_by: list[str] | None = None):
        self.steps = steps
        self.order_by = order_by
        self.fitted: list = []

    def fit(self, df: DataFrame) -> "StepChain":
        self.fitted = []
        cur = df
        for s in self.steps:
            if s.kind == "impute":
                if s.method == "mean":
                    means = cur.agg(*[F.avg(_q(c)) for c in s.columns]).first()
                    fills = dict(zip(s.columns, means))
                elif s.method == "median":
                    fills = {c: q[0] for c, q in column_quantiles(cur, s.columns, [0.5]).items()}
                elif s.method == "mode":
                    fills = mode_values(cur, s.columns)
                elif s.method.startswith("constant:"):
                    fills = dict.fromkeys(s.columns, s.method.split(":", 1)[1])
                else:
                    raise ValueError(f"step chain cannot replay {s.method!r}")
                self.fitted.append(("impute", fills))
                cur = self._impute(cur, fills)
            elif s.kind == "encode":
                encs = [fit_encoder(cur, c, s.method) for c in s.columns]
                self.fitted.append(("encode", encs))
                for e in encs:
                    cur = e.transform(cur)
            elif s.kind == "scale":
                sc = fit_scaler(cur, s.columns, s.method)
                self.fitted.append(("scale", sc))
                cur = sc.transform(cur)
            else:
                raise ValueError(f"unknown step kind {s.kind!r}")
        return self

    @staticmethod
    def _impute(df: DataFrame, fills: dict) -> DataFrame:
        return df.select(*[F.coalesce(_q(c), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
                           if c in fills else _q(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        cur = df
        for kind, obj in self.fitted:
            if kind == "impute":
                cur = self._impute(cur, obj)
            elif kind == "encode":
                for e in obj:
                    cur = e.transform(cur)
            else:
                cur = obj.transform(cur)
        return cur


# ---------------------------------------------------- E23 model matrix --

@dataclass
class ModelMatrix:
    """One shared fitted transformer for training and scoring —
    text features one-hot with the first level dropped, numeric features
    median-filled, a text target label-encoded."""
    target: str
    numeric: list[str]
    medians: dict
    encoders: list[Encoder]
    target_encoder: Encoder | None

    @property
    def feature_names(self) -> list[str]:
        """One name per entry of the assembled feature vector."""
        return self.dense_names + [n for e in self.encoders if e.vector for n in e.names()]

    @property
    def dense_names(self) -> list[str]:
        return list(self.numeric) + [n for e in self.encoders if not e.vector for n in e.names()]

    @property
    def inputs(self) -> list[str]:
        """The columns that are assembled: numbers, then the sparse vectors of wide text features."""
        return self.dense_names + [e.vector for e in self.encoders if e.vector]

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Aligned model matrix (P7: absent features → 0, extras dropped,
        order fixed) plus the target and any ``keep`` columns."""
        cur = df
        for c in self.numeric:
            if c not in cur.columns:          # P7: absent feature → 0
                cur = cur.withColumn(c, F.lit(0.0))
        cur = cur.select(*[F.coalesce(_q(c).cast("double"), F.lit(self.medians.get(c) or 0.0)).alias(c)
                           if c in self.numeric else _q(c) for c in cur.columns])
        for e in self.encoders:
            if e.column not in cur.columns:
                cur = cur.withColumn(e.column, F.lit(None).cast("string"))
            cur = e.transform(cur)
        if self.target_encoder is not None and self.target in cur.columns:
            cur = self.target_encoder.transform(cur)
        dense = self.dense_names
        cols = self.inputs + ([self.target] if self.target in cur.columns else [])
        cols += [k for k in keep if k in cur.columns and k not in cols]
        return cur.select(*[_q(c).cast("double").alias(c) if c in dense else _q(c) for c in cols])


def fit_model_matrix(df: DataFrame, target: str, features: list[str] | None = None,
                     max_categories: int = 100) -> ModelMatrix:
    from tessera.functions.types import ID_LIKE_NAMES
    # Without an explicit list, identifier-like columns are never features
    feats = [c for c in (features or [c for c in df.columns if c.lower() not in ID_LIKE_NAMES])
             if c != target and c in df.columns]
    num = [c for c in feats if kind_of(df.schema[c].dataType) == NUMERIC]
    txt = [c for c in feats if kind_of(df.schema[c].dataType) == "string"]
    medians = {c: v[0] for c, v in column_quantiles(df, num, [0.5]).items()}
    encs = [fit_encoder(df, c, "one_hot", max_categories=max_categories, drop_first=True) for c in txt]
    tenc = None
    if kind_of(df.schema[target].dataType) != NUMERIC:
        tenc = fit_encoder(df, target, "label", max_categories=max_categories)
    return ModelMatrix(target, num, medians, encs, tenc)
