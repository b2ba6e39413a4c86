"""Running totals without a single-partition or single-key window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task, and a window partitioned by a key that holds a third of the rows
moves that third into one task.  Instead:

1. range-partition on (keys, order) — a hot key spreads over several
   contiguous partitions — and pin the partitioning with a reliable
   checkpoint into the shared folder (range bounds are sampled per
   exchange, so two branches must read the same materialised ids);
2. total each (partition, key) — one row per pair;
3. turn the totals into offsets with a window over that small table; only
   the first key of a partition can continue from an earlier partition, so
   at most one non-zero offset row per partition remains and is broadcast
   (bounded by the partition count);
4. finish with ordinary per-(partition, key) running windows plus offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join on equal names where null equals null; ``small`` broadcasts the right side, whose size the caller bounds."""
    r = right.select(*[_q(k).alias(f"__j{i}") for i, k in enumerate(on)], *[_q(c) for c in right.columns if c not in on])
    cond = reduce(lambda a, b: a & b, [_q(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(on)])
    return left.join(F.broadcast(r) if small else r, cond, how).drop(*[f"__j{i}" for i in range(len(on))])


def running_sum(df: DataFrame, order_by: list[Column], values: list[str], keys: list[str] = (),
                prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Adds ``cum_<v>`` = sum of ``v`` over the rows of the same key up to
    and including the current one in ``order_by`` order (a total order)."""
    keys = list(keys)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kc = [_q(k) for k in keys]
    ranged = cut_lineage(df.repartitionByRange(n, *kc, *order_by).withColumn("__pid", F.spark_partition_id()))
    totals = ranged.groupBy("__pid", *kc).agg(*[F.sum(_q(v)).alias(f"__t{i}") for i, v in enumerate(values)])
    prior = Window.partitionBy(*kc).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *kc, *[F.coalesce(F.sum(f"__t{i}").over(prior), F.lit(0)).alias(f"__o{i}")
                                            for i in range(len(values))])
    nonzero = F.lit(False)
    for i in range(len(values)):
        nonzero = nonzero | (F.col(f"__o{i}") != 0)
    offsets = offsets.where(nonzero)
    w = (Window.partitionBy("__pid", *kc).orderBy(*order_by)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = null_safe_join(ranged, offsets, ["__pid", *keys], "left", small=True)
    for i, v in enumerate(values):
        out = out.withColumn(f"{prefix}{v}", F.coalesce(F.col(f"__o{i}"), F.lit(0)) + F.sum(_q(v)).over(w))
    return out.drop("__pid", *[f"__o{i}" for i in range(len(values))])


def row_numbers(df: DataFrame, order_by: list[Column], keys: list[str] = (), name: str = "row_number") -> DataFrame:
    """1-based position within each key by a total order, skew-safe."""
    out = running_sum(df.withColumn("__one", F.lit(1)), order_by, ["__one"], keys)
    return out.withColumnRenamed("cum___one", name).drop("__one")


def average_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Average rank (ties share the mean of their positions), 1-based.

    Ranks come from cumulative counts over the DISTINCT values, then join
    back on the value (null values get a null rank).
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"))
    cum = running_sum(counts, [F.col("__v")], ["__n"])
    ranks = cum.select("__v", (F.col("cum___n") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")
