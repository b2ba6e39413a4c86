"""Exact quantiles without holding a group's values in one task or on the driver.

``percentile()`` buffers every value of a group inside one aggregation
buffer — a hot group (or a global quantile at 100 TB) does not fit.  Here two
scans find any number of quantiles of any number of columns or groups:

1. A mergeable KLL sketch per column or group bounds each quantile's rank: a
   band of values from a little below to a little above it.  The sketch has a
   fixed size, so each task sends a few kilobytes per column or group.
2. One aggregation counts, for every band, the values below it and the
   different values inside it (partial aggregation first).  The two values at
   ranks ⌊h⌋ and ⌈h⌉ with h = (n−1)·p are where the running count inside the
   band reaches them (``ordered.running_sum``: range-partitioned, so a band is
   shared out between tasks), and are interpolated linearly — the definition
   of Spark's ``percentile`` and DuckDB's ``quantile_cont``.

A band is several times as wide as the sketch's error.  Should a rank lie
outside all the same, the counts show it, and that column or group is counted
over its whole range.  Infinities are values like others; nulls and NaN are
left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import null_safe_join, running_sum
from tessera.session import written

#: Size of a sketch, and half the width of a band as a share of the values; the sketch's own error is a quarter of it.
SKETCH, MARGIN = 4096, 0.004
#: With fewer values the band is the whole range: the margin would be less than two ranks.
FEW = math.ceil(2 / MARGIN)
#: So many groups' bands are broadcast: a join by a few keys would gather the rows in as few tasks.
FEW_GROUPS = 10_000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(name: str) -> Column:
    x = _q(name).cast("double")
    return F.when(~F.isnan(x), x)


def _bounds(value: Column, i: int, probs: list[float], margin: float) -> list[Column]:
    """Count of a value, and the low and high end of the band of each quantile, from one sketch."""
    sketch, n = F.kll_sketch_agg_double(value, F.lit(SKETCH)), F.count(value)
    out = [n.alias(f"n{i}")]
    for j, p in enumerate(probs):
        for side, rank, open_end in (("lo", p - margin, -math.inf), ("hi", p + margin, math.inf)):
            end = F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, float(rank)))))
            # A sketch without values has no quantiles; when() keeps it from being asked.
            out.append(F.when((n >= FEW) & F.lit(0 < rank < 1), end).otherwise(F.lit(open_end)).alias(f"{side}{i}_{j}"))
    return out


def _picked(counts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``q``: the interpolated value at each band's ranks; null where the band does not hold them.

    ``counts``: keys, v (null: values below the band), c.  ``ranks``: keys and h, the 0-based fractional rank."""
    below = counts.where("v is null").select(*map(_q, keys), F.col("c").alias("below"))
    inside = running_sum(counts.where("v is not null"), [F.col("v")], ["c"], keys)
    known = null_safe_join(null_safe_join(inside, ranks, keys), below, keys, "left")
    start = F.coalesce("below", F.lit(0))
    first, last = start + F.col("cum_c") - F.col("c"), start + F.col("cum_c")
    at = lambda r: F.max(F.when((first <= r) & (r < last), F.col("v")))
    low, high = F.floor("h"), F.ceil("h")
    found = known.groupBy(*map(_q, keys)).agg(at(low).alias("__a"), at(high).alias("__b"), F.max(F.col("h") - low).alias("__f"))
    a, b = F.col("__a"), F.col("__b")
    value = F.when(a == b, a).otherwise(a + (b - a) * F.col("__f"))
    return found.select(*map(_q, keys), value.alias("q"))


def quantiles_long(long: DataFrame, group: list[str], value: str, probs: list[float], margin: float = MARGIN) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``group`` (a null group is a group).
    Returns group columns + ``q0 .. q{k-1}`` (doubles)."""
    names = [f"__g{i}" for i in range(len(group))]
    data = long.select(*[_q(g).alias(n) for g, n in zip(group, names)], _number(value).alias("v")).where("v is not null")
    # Sketches are random: all that follows has to see the same bands.
    sketched = written(data.groupBy(*names).agg(*_bounds(F.col("v"), 0, probs, margin)), "bands")
    few = sketched.count() <= FEW_GROUPS

    def pick(sketched: DataFrame) -> DataFrame:
        bands = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"lo0_{j}").alias("lo"), F.col(f"hi0_{j}").alias("hi")) for j in range(len(probs))])
        known = sketched.select(*names, F.col("n0").alias("n"), bands.alias("bands"))
        hits = null_safe_join(data, known, names, small=few).select(*names, "v", F.explode("bands").alias("b")).where("v <= b.hi").select(
            *names, F.col("b.j").alias("j"), F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("v"))
        counts = written(hits.groupBy(*names, "j", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
        share = F.array(*[F.lit(float(p)) for p in probs])
        ranks = known.select(*names, "n", F.posexplode(share).alias("j", "p")).select(*names, "j", ((F.col("n") - 1) * F.col("p")).alias("h"))
        one = _picked(counts, ranks, [*names, "j"])
        wide = one.groupBy(*names).agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(f"q{j}") for j in range(len(probs))])
        return null_safe_join(known.select(*names), wide, names, "left") if names else wide

    def whole(sketched: DataFrame) -> DataFrame:
        return sketched.select(*names, "n0", *[F.lit(e).alias(f"{s}0_{j}") for j in range(len(probs)) for s, e in (("lo", -math.inf), ("hi", math.inf))])

    out = written(pick(sketched), "quantiles")
    missed = out.where(" or ".join(f"q{j} is null" for j in range(len(probs)))).select(*names)
    if not missed.isEmpty():
        again = pick(whole(null_safe_join(sketched, missed, names, "left_semi") if names else sketched))
        out = (null_safe_join(out, missed, names, "left_anti").unionByName(again)) if names else again
    return out.select(*[_q(n).alias(g) for g, n in zip(group, names)], *[f"q{j}" for j in range(len(probs))])


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], method: str = "exact",
                     accuracy: int = 10000, margin: float = MARGIN) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns; returns the
    few fitted numbers to the driver: {column: [q per prob]}.

    All columns share both scans; the driver sees the bands' ends and the quantiles."""
    if not columns or not probs:
        return {c: [] for c in columns}
    if method == "approx":
        r = df.agg(*[F.percentile_approx(_q(c).cast("double"), list(probs), accuracy).alias(f"c{i}")
                     for i, c in enumerate(columns)]).first()
        return {c: list(r[f"c{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}
    x = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = x.agg(*[e for i in range(len(columns)) for e in _bounds(F.col(f"c{i}"), i, probs, margin)]).first()
    bands = {(i, j): (ends[f"lo{i}_{j}"], ends[f"hi{i}_{j}"]) for i in range(len(columns)) for j in range(len(probs)) if ends[f"n{i}"]}
    found: dict[tuple[int, int], float] = {}
    while todo := {k: (-math.inf, math.inf) if k in found else b for k, b in bands.items() if found.get(k) is None}:
        number = {k: b for b, k in enumerate(todo)}
        cells = []
        for (i, j), (lo, hi) in todo.items():
            v = F.col(f"c{i}")
            cells.append(F.when(v <= F.lit(hi), F.struct(F.lit(number[i, j]).alias("b"), F.when(v >= F.lit(lo), v).alias("v"))))
        # explode + where stay in whole-stage codegen (a lambda filter would not)
        hits = x.select(F.explode(F.array(*cells)).alias("h")).where("h is not null")
        counts = written(hits.groupBy("h.b", "h.v").agg(F.count(F.lit(1)).alias("c")), "counts")
        ranks = df.sparkSession.createDataFrame([(number[i, j], (ends[f"n{i}"] - 1) * float(probs[j])) for i, j in todo], "b int, h double")
        got = {r["b"]: r["q"] for r in _picked(counts, ranks, ["b"]).collect()}
        found |= {k: got.get(number[k]) for k in todo}
    return {c: [found.get((i, j)) for j in range(len(probs))] for i, c in enumerate(columns)}


def group_quantiles(df: DataFrame, value: str, group: str, probs: list[float]) -> DataFrame:
    """Per-group exact quantiles as a DataFrame (group, q0..)."""
    return quantiles_long(df, [group], value, probs)
