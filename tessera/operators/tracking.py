"""Tracking tables, versions, lineage and paging.

Registries are append-only Parquet tables; "update" is a latest-wins
append.  Latest/best rows use ``max_by`` in a grouped aggregation (partial
per partition, so a hot group is reduced before the shuffle).  Graph walks
are iterative equi-joins with a visited set, lineage cut by checkpoints in
the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import null_safe_join, row_numbers, running_sum
from tessera.session import cut_lineage, scratch_path


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def append(df: DataFrame, path: str) -> str:
    """L1: register rows by appending them to the registry table."""
    df.write.mode("append").parquet(path)
    return path


def latest_per_group(df: DataFrame, group: list[str], order_col: str) -> DataFrame:
    """The latest row of each group (``max_by`` of the whole row)."""
    others = [c for c in df.columns if c not in group]
    agg = df.groupBy(*[_q(g) for g in group]).agg(
        F.max_by(F.struct(*[_q(c) for c in others]), _q(order_col)).alias("__r"))
    return agg.select(*[_q(g) for g in group], *[F.col("__r")[c].alias(c) for c in others])


def register_if_changed(registry: DataFrame, candidates: DataFrame, group: list[str],
                        order_col: str, value_col: str) -> DataFrame:
    """L2: candidates whose ``value_col`` (a path) differs from the latest
    registered row of their group (left-anti join; null equals null)."""
    latest = latest_per_group(registry, group, order_col).select(*group, value_col)
    return null_safe_join(candidates, latest, [*group, value_col], "left_anti")


def with_versions(df: DataFrame, group: list[str], order_by: list[str], name: str = "version") -> DataFrame:
    """version = 1 + number of earlier rows of the same group
    (skew-safe running count, see ``ordered``)."""
    return row_numbers(df, [_q(o) for o in order_by], group, name)


def rank_by_metric(df: DataFrame, group: list[str], metric: str, name: str = "rank") -> DataFrame:
    """Rank runs by a metric (missing metric counts as 0), best first,
    ties share a rank.  Rank = 1 + rows of the group with a strictly better
    metric: counts per (group, metric), a skew-safe running sum over them,
    joined back on (group, metric).  Rows with a null group are a group too."""
    m = F.coalesce(_q(metric).cast("double"), F.lit(0.0))
    data = df.withColumn("__m", m)
    counts = data.groupBy(*[_q(g) for g in group], "__m").agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sum(counts, [F.col("__m").desc()], ["__n"], group)
    ranks = cum.select(*group, "__m", (F.col("cum___n") - F.col("__n") + 1).cast("int").alias(name))
    return null_safe_join(data, ranks, [*group, "__m"]).select(*[_q(c) for c in df.columns], _q(name))


def best_by(df: DataFrame, group: list[str], metric: str, tie_break: list[str] = ()) -> DataFrame:
    """T4/L3/L4: arg-max row per group (missing metric counts as 0; ties go
    to the highest ``tie_break`` values, so the answer is deterministic)."""
    tmp = df.withColumn("__m", F.struct(F.coalesce(_q(metric).cast("double"), F.lit(0.0)),
                                        *[_q(t) for t in tie_break]))
    return latest_per_group(tmp, group, "__m").drop("__m")


def best_with_override(df: DataFrame, group: list[str], metric: str, key: str,
                       override: DataFrame | None = None, tie_break: list[str] = ()) -> DataFrame:
    """L3: the registered model of each group with the best metric, unless
    the user selected one (``override`` rows of group columns + ``key``).
    A selection that names no registered model leaves its group's best."""
    best = best_by(df, group, metric, tie_break)
    if override is None:
        return best
    chosen = null_safe_join(df, override.select(*group, key), [*group, key], "left_semi")
    return chosen.unionByName(null_safe_join(best, chosen.select(*group).distinct(), group, "left_anti"))


def paginate(df: DataFrame, order_by: list[Column], offset: int = 0, limit: int = 50,
             group: list[str] = ()) -> DataFrame:
    """Newest-first pages.  With ``group`` every group gets its own
    page in one pass (the row_number filter becomes a per-partition group
    limit before the shuffle)."""
    if not group:
        return df.orderBy(*order_by).offset(offset).limit(limit)
    w = Window.partitionBy(*[_q(g) for g in group]).orderBy(*order_by)
    return (df.withColumn("__rn", F.row_number().over(w))
            .where((F.col("__rn") > offset) & (F.col("__rn") <= offset + limit))
            .withColumnRenamed("__rn", "position"))


def search_text(df: DataFrame, fields: list[str], needle: str, order_by: list[Column]) -> DataFrame:
    """Case-insensitive substring over the concatenated fields, ordered."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(_q(f).cast("string"), F.lit("")) for f in fields]))
    return df.where(hay.contains(needle.lower())).orderBy(*order_by)


def filter_eq(df: DataFrame, **preds) -> DataFrame:
    """Optional equality predicates (None = no filter)."""
    for k, v in preds.items():
        if v is not None:
            df = df.where(_q(k) == F.lit(v))
    return df


def provenance_chain(nodes: DataFrame, id_col: str, parent_col: str, start: DataFrame) -> DataFrame:
    """Follow parent ids from the ``start`` ids to the root, to the end.

    Jumps double each round (parent, grandparent, four up, …), so a chain of
    n nodes takes log n rounds; both tables are checkpointed each round, so
    plans stay flat.  Cycles end because a node keeps its smallest depth.
    Returns (start_id, id, depth) with depth 0 = the start.
    """
    jumps = (nodes.select(_q(id_col).alias("id"), _q(parent_col).alias("up"))
             .where(F.col("id").isNotNull() & F.col("up").isNotNull()).distinct())
    seen = cut_lineage(start.select(F.col("id").alias("start_id"), F.col("id"), F.lit(0).cast("int").alias("depth")).distinct())
    known, step = seen.count(), 1
    while True:
        further = seen.join(jumps, "id").select("start_id", F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        seen = cut_lineage(seen.unionByName(further).groupBy("start_id", "id").agg(F.min("depth").alias("depth")))
        if (now := seen.count()) == known:
            return seen
        known, step = now, step * 2
        twice = jumps.select("id", F.col("up").alias("mid")).join(jumps.select(F.col("id").alias("mid"), "up"), "mid")
        jumps = cut_lineage(twice.select("id", "up").distinct())


def lineage_closure(edges: DataFrame, changed: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node reachable downstream of the changed nodes, as (node, depth): fewest steps, the changed nodes at 0.

    Hops double while that is cheap: the table of hops of twice the length is made only if its join, sized exactly from
    the in- and out-degrees, has at most ``4 * edges`` rows.  So a chain of n levels takes log n rounds, a hub is never
    squared, and from then on each round goes on by the longest hops from the levels found last.  A round writes what it
    found once, beside the earlier rounds in one folder, so plans stay flat.  Cycles end because nodes found before are
    anti-joined away.  Edges with a null end lead nowhere.
    """
    spark = edges.sparkSession
    ends = edges.select(_q(src).alias("node")).union(edges.select(_q(dst))).union(changed.select("node"))
    kind = ends.schema["node"].dataType.simpleString()
    root, schema = scratch_path(spark, "closure"), f"node {kind}, depth int"

    def add(rows: DataFrame, part: int) -> DataFrame:
        rows.select(F.col("node").cast(kind).alias("node"), F.col("depth").cast("int").alias("depth")).write.parquet(f"{root}/part={part}")
        return spark.read.schema(schema).parquet(f"{root}/part={part}")

    def reached() -> DataFrame:
        return spark.read.schema(schema).parquet(root).select("node", "depth")

    frontier = add(changed.select("node", F.lit(0).alias("depth")).distinct(), 0)
    hops = cut_lineage(edges.select(_q(src).cast(kind).alias("node"), _q(dst).cast(kind).alias("next")).dropna().distinct())
    room, length, doubling = 4 * hops.count(), 1, True
    for part in count(1):
        found = (frontier.join(hops, "node").groupBy(F.col("next").alias("node"))
                 .agg((F.min("depth") + F.lit(length)).alias("depth")))
        found = add(found.join(reached().select("node"), "node", "left_anti"), part)
        if found.isEmpty():
            return reached()
        # Levels below 2 * length are known while doubling; later, below the end of what this round found.
        if doubling:
            ins = hops.groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
            outs = hops.groupBy("node").agg(F.count(F.lit(1)).alias("n_out"))
            size = ins.join(outs, "node").agg(F.sum(F.col("n_in").cast("double") * F.col("n_out"))).first()[0] or 0
            doubling = size <= room
        if doubling:
            first = hops.select("node", F.col("next").alias("mid"))
            hops = cut_lineage(first.join(hops.withColumnRenamed("node", "mid"), "mid").select("node", "next").distinct())
            length *= 2
            frontier = reached()
        else:
            frontier = found


def mark_stale(states: DataFrame, closure: DataFrame, node: str = "node", state: str = "state") -> DataFrame:
    """Finished nodes in the closure become stale, the changed ones ready."""
    c = closure.select(F.col("node").alias("__n"), F.col("depth").alias("__d"))
    j = states.join(c, _q(node) == F.col("__n"), "left")
    new = (F.when(F.col("__d") == 0, F.lit("ready"))
           .when(F.col("__d").isNotNull() & (_q(state) == "completed"), F.lit("stale"))
           .otherwise(_q(state)))
    return j.withColumn(state, new).drop("__n", "__d")


def retention(files: DataFrame, sessions: DataFrame, session_col: str, created_col: str,
              completed_col: str, now: Column, max_age_days: int) -> DataFrame:
    """Per completed session, the files older than ``max_age_days``
    (what to delete, and how many)."""
    done = sessions.where(_q(completed_col)).select(_q(session_col).alias("__s"))
    old = files.where(_q(created_col) < now - F.make_interval(days=F.lit(max_age_days)))
    return (old.join(done, _q(session_col) == F.col("__s"), "left_semi")
            .groupBy(_q(session_col)).agg(F.count(F.lit(1)).alias("n_files")))
