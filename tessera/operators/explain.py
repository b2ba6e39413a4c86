"""Shapley-style explanations.

* Linear models: exact Shapley values ``coef_j · (x_j − mean_j)`` as column
  expressions over all rows.
* Tree models: exact path-dependent Shapley values from the table of the
  ensemble's leaf paths, a batch of rows at a time (``tree_shap``).
* Tree ensembles: permutation Shapley from the same table.
* Any other model: permutation Shapley.  Rows (all, or ``sample_rows``) ×
  ``permutations`` orderings × (features + 1) coalitions are exploded, scored
  by one batch ``transform`` and differenced inside (row, permutation) windows.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import stable_round as sround
from tessera.operators.model import ROWS, SEED, TrainedModel, _array
from tessera.session import scratch_path, ship

ship(__name__)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def linear_shap(tm: TrainedModel, df: DataFrame, id_col: str, rows: DataFrame | None = None) -> DataFrame:
    """Exact Shapley values of a linear model in (id, feature, shap) form, for ``rows`` (else all of ``df``) against
    the means of ``df``."""
    m = tm.pipeline.stages[-1]
    coef = m.coefficients.toArray().tolist()
    names = tm.matrix.feature_names
    x = tm.matrix.transform(df, [id_col])
    means = x.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    cells = [F.struct(F.lit(c).alias("feature"),
                      (F.lit(coef[i]) * (_q(c) - F.lit(means[f"m{i}"] or 0.0))).alias("shap"))
             for i, c in enumerate(names)]
    shown = x if rows is None else tm.matrix.transform(rows, [id_col])
    return shown.select(_q(id_col), F.explode(F.array(*cells)).alias("e")).select(id_col, "e.feature", "e.shap")


def _adds_leaves(tm: TrainedModel) -> bool:
    """Whether the explained score is the sum of the reached leaves' values: forests and regression trees, not the
    probability of boosted classifiers, without sparse features."""
    kinds = (RandomForestClassificationModel, RandomForestRegressionModel, GBTRegressionModel)
    return isinstance(tm.pipeline.stages[-1], kinds) and tm.matrix.inputs == tm.matrix.feature_names


def permutation_shap(tm: TrainedModel, df: DataFrame, id_col: str, sample_rows: int | None = None,
                     permutations: int = 10, seed: int = SEED) -> DataFrame:
    """Permutation Shapley for any fitted model, (id, feature, shap), of all
    rows, or of ``sample_rows`` of them (the smallest by a hash of the id).

    Where the score is a sum over leaves, a step changes only the leaves that test the added feature: the same
    differences come from the table of leaf paths, a batch of rows at a time."""
    names = tm.matrix.feature_names
    x = tm.matrix.transform(df, [id_col])
    bg = x.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    rows = x if sample_rows is None else x.orderBy(F.xxhash64(_q(id_col), F.lit(seed))).limit(sample_rows)
    rng = random.Random(seed)
    perms = []
    for _ in range(permutations):
        p = list(range(len(names)))
        rng.shuffle(p)
        perms.append(p)
    if _adds_leaves(tm):
        start = np.array([bg[f"m{j}"] or 0.0 for j in range(len(names))])
        paths = leaf_paths(tm.pipeline.stages[-1])
        vectors = tm.pipeline.stages[0].transform(rows).select(_q(id_col).alias("id"), vector_to_array("features").alias("x"))
        made = _explained(vectors, paths, lambda p: _step_terms(p, start, perms), len(names))
        listed = F.array(*[F.lit(n) for n in names])
        cells = made.select(F.col("id").alias(id_col), F.posexplode("s").alias("at", "s"))
        # n rows of one id give n equal coalitions each, of which only the last changes: a share of 1 / n of their mean.
        return cells.groupBy(id_col, F.get(listed, F.col("at")).alias("feature")).agg(
            (F.sum("s") / F.count("s") / F.count("s")).alias("shap"))
    # position of feature j inside permutation p, and the feature added at step s
    pos = F.array(*[F.array(*[F.lit(perm.index(j)) for j in range(len(names))]) for perm in perms])
    added = F.array(*[F.array(*[F.lit(names[k]) for k in perm]) for perm in perms])
    grid = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("__p")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("__s"))
    coal = grid.select(
        _q(id_col), "__p", "__s", _q(tm.matrix.target) if tm.matrix.target in grid.columns else F.lit(0.0).alias(tm.matrix.target),
        *[F.when(F.element_at(F.element_at(pos, F.col("__p") + 1), j + 1) < F.col("__s"), _q(c))
          .otherwise(F.lit(bg[f"m{j}"] or 0.0)).alias(c) for j, c in enumerate(names)])
    scored = tm.pipeline.transform(coal)
    out_col = "probability" if "probability" in scored.columns else None
    val = F.get(_array(scored, out_col), F.lit(1)) if out_col else F.col("prediction")
    w = Window.partitionBy(id_col, "__p").orderBy("__s")
    diffs = scored.select(id_col, "__p", "__s", val.alias("__v")).withColumn(
        "__d", F.col("__v") - F.lag("__v").over(w)).where(F.col("__s") > 0)
    diffs = diffs.withColumn("feature", F.element_at(F.element_at(added, F.col("__p") + 1), F.col("__s")))
    return diffs.groupBy(id_col, "feature").agg(F.avg("__d").alias("shap"))


def mean_abs_shap(shap: DataFrame) -> DataFrame:
    """Mean |Shapley value| per feature, sorted."""
    return shap.groupBy("feature").agg(sround(F.avg(F.abs("shap")), 6).alias("mean_abs_shap")) \
        .orderBy(F.desc("mean_abs_shap"), "feature")


def waterfall(shap: DataFrame, id_col: str, rows: int = 3, top: int = 15) -> DataFrame:
    """For the first ``rows`` ids, the ``top`` largest |terms| and the
    rest summed as 'other'."""
    first = shap.select(id_col).distinct().orderBy(id_col).limit(rows)
    s = shap.join(F.broadcast(first), id_col, "left_semi")
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("shap")), "feature")
    r = s.withColumn("__r", F.row_number().over(w))
    keep = r.where(F.col("__r") <= top).select(id_col, "feature", "shap")
    rest = r.where(F.col("__r") > top).groupBy(id_col).agg(F.sum("shap").alias("shap")) \
        .withColumn("feature", F.lit("other")).select(id_col, "feature", "shap")
    return keep.unionByName(rest)


# ------------------------------------------------------- tree ensembles --

@dataclass
class LeafPaths:
    """All leaves of an ensemble that test ``d`` different features on their path: feature numbers, the interval
    (low, high] that leads there, the share of training rows that follow the path at those splits, and the value."""
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def _leaf_values(model, stats: list, prediction: float, weight: float, classifier: bool) -> float:
    """What a leaf adds to the explained score: the probability of the second class (forests) or the margin (boosting)."""
    if classifier and not isinstance(model, GBTClassificationModel):
        return stats[1] / sum(stats) * weight if sum(stats) else 0.0
    return prediction * weight


def leaf_paths(model) -> list[LeafPaths]:
    """The leaf-path table of a fitted tree ensemble or single tree, from its saved node table (one row per node)."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    table = spark.read.parquet(path + "/data")
    if "nodeData" in table.columns:
        rows = table.select("treeID", "nodeData.*").collect()          # as large as the model
        weights = list(model.treeWeights)
    else:
        rows = table.select(F.lit(0).alias("treeID"), "*").collect()
        weights = [1.0]
    if not isinstance(model, (GBTClassificationModel, GBTRegressionModel)):
        weights = [w / sum(weights) for w in weights]
    nodes = {(r["treeID"], r["id"]): r for r in rows}
    classifier = hasattr(model, "numClasses")
    # Trees of a boosted classifier are regressions on residuals: their statistics are (rows, sum, sum of squares).
    counts = classifier and not isinstance(model, GBTClassificationModel)
    cover = {k: sum(r["impurityStats"]) if counts else r["impurityStats"][0] for k, r in nodes.items()}
    found: dict[int, list] = {}
    for tree, weight in enumerate(weights):
        stack = [(0, {})]
        while stack:
            at, tests = stack.pop()
            node = nodes[tree, at]
            if node["leftChild"] < 0:
                value = _leaf_values(model, node["impurityStats"], node["prediction"], weight, classifier)
                found.setdefault(len(tests), []).append((tests, value))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("splits on unordered categories have no intervals")
            cut, f = split["leftCategoriesOrThreshold"][0], split["featureIndex"]
            low, high, share = tests.get(f, (-np.inf, np.inf, 1.0))
            for child, interval in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                part = cover[tree, child] / cover[tree, at]
                stack.append((child, {**tests, f: (*interval, share * part)}))
    out = []
    for d, leaves in sorted(found.items()):
        shape = (len(leaves), d)
        grid = np.array([[(f, *t) for f, t in sorted(tests.items())] for tests, _ in leaves], float).reshape(*shape, 4)
        out.append(LeafPaths(grid[..., 0].astype(np.int64), grid[..., 1], grid[..., 2], grid[..., 3], np.array([v for _, v in leaves])))
    return out


def base_value(paths: list[LeafPaths]) -> float:
    """The ensemble's mean over its training rows, by the shares of its paths."""
    return float(sum((p.value * p.share.prod(1)).sum() for p in paths))


def _passes(x: np.ndarray, p: LeafPaths) -> np.ndarray:
    """Whether a value goes the leaf's way at each place: NaN goes right at every split."""
    return (~(x <= p.low) | (p.low == -np.inf)) & ((x <= p.high) | (p.high == np.inf))


def _by_pattern(p: LeafPaths, terms) -> np.ndarray | None:
    """(leaf, pattern, place) -> ``terms`` of every pattern of passed tests; None where there are too many patterns."""
    leaves, d = p.feature.shape
    if leaves * d << d > 1 << 22:
        return None
    return terms((np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)[:, None, :].repeat(leaves, 1)).transpose(1, 0, 2)


def _path_sums(x: np.ndarray, paths: list[LeafPaths], terms: list, tables: list, n_features: int) -> np.ndarray:
    """Sums by feature of what each leaf gives each row.  That depends only on which of the leaf's tests the row passes
    (row, leaf, place), so it is looked up by that pattern; leaves with too many patterns compute it for the row."""
    out = np.zeros((len(x), n_features))
    for p, term, table in zip(paths, terms, tables):
        leaves, d = p.feature.shape
        if not d:
            continue
        order = np.argsort(p.feature.ravel(), kind="stable")
        kinds, begins = np.unique(p.feature.ravel()[order], return_index=True)
        step = max(1, (1 << 20) // (leaves * d))
        for a in range(0, len(x), step):
            passes = _passes(x[a:a + step][:, p.feature], p)
            parts = term(passes) if table is None else table[np.arange(leaves), passes @ (1 << np.arange(d))]
            out[a:a + step, kinds] += np.add.reduceat(parts.reshape(len(passes), -1)[:, order], begins, axis=1)
    return out


def _shapley_terms(p: LeafPaths):
    """What a leaf gives its features by Shapley's weights.

    A leaf is a product game: with the features S known it is worth value * (product over S of 'the row passes') *
    (product over the rest of the share). The Shapley weights of such a product are the integral over t of
    (product over the other features of share * (1 - t) + passes * t), a polynomial in t that a Gauss rule with half
    as many points sums exactly."""
    points, weights = np.polynomial.legendre.leggauss(max(1, (p.feature.shape[1] + 1) // 2))

    def terms(passes: np.ndarray) -> np.ndarray:
        passes = passes.astype(float)
        rest = np.zeros_like(passes)
        for t, w in zip((points + 1) / 2, weights / 2):
            factor = p.share * (1 - t) + passes * t
            rest += w * factor.prod(2, keepdims=True) / factor
        return p.value[:, None] * (passes - p.share) * rest
    return terms


def _step_terms(p: LeafPaths, start: np.ndarray, perms: list[list[int]]):
    """What a leaf gives its features, on average, as the row's values replace those of ``start`` in each order."""
    base = _passes(start[p.feature], p)
    orders = [np.argsort(np.argsort(perm)[p.feature], axis=1) for perm in perms]

    def terms(passes: np.ndarray) -> np.ndarray:
        out = np.zeros(passes.shape)
        for order in orders:
            known = np.take_along_axis(passes, order[None], 2)
            left = np.take_along_axis(base, order, 1)
            before, after = np.ones_like(known), np.ones_like(left)
            before[..., 1:] = np.logical_and.accumulate(known, 2)[..., :-1]
            after[:, :-1] = np.logical_and.accumulate(left[:, ::-1], 1)[:, ::-1][:, 1:]
            change = (before & after) * (known.astype(float) - left) * p.value[:, None]
            out += np.take_along_axis(change, np.argsort(order, axis=1)[None], 2)
        return out / len(orders)
    return terms


def path_shapley(x: np.ndarray, paths: list[LeafPaths], n_features: int) -> np.ndarray:
    """Exact Shapley values of each row of x (path-dependent: a missing feature follows both branches by their shares)."""
    return _path_sums(x, paths, [_shapley_terms(p) for p in paths], [None] * len(paths), n_features)


def _explained(rows: DataFrame, paths: list[LeafPaths], make, n_features: int) -> DataFrame:
    """(id, s): of each row (id, x) the sums by feature of what ``make(leaf paths)`` gives.  Rows are few bytes and much
    work, so they are dealt out by number: by size they would all be one task."""
    rows = rows.repartition(max(1, math.ceil(rows.count() / ROWS)))

    def work(batches):
        terms = [make(p) for p in paths]
        tables = [_by_pattern(p, t) for p, t in zip(paths, terms)]
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features)
            made = _path_sums(values, paths, terms, tables, n_features)
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * n_features)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], ["id", "s"])

    return rows.mapInArrow(work, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("s", T.ArrayType(T.DoubleType()))]))


def tree_shap(tm: TrainedModel, df: DataFrame, id_col: str) -> DataFrame:
    """Exact Shapley values of a tree model for every row, as (id, feature, shap). They sum to the row's score
    (forests: probability of the second class; boosting: margin; regression: prediction) less ``tree_base(tm)``."""
    names, paths = tm.matrix.feature_names, leaf_paths(tm.pipeline.stages[-1])
    x = tm.pipeline.stages[0].transform(tm.matrix.transform(df, [id_col]))
    rows = x.select(_q(id_col).alias("id"), vector_to_array("features").alias("x"))

    made = _explained(rows, paths, _shapley_terms, len(names))
    listed = F.array(*[F.lit(n) for n in names])
    return made.select(F.col("id").alias(id_col), F.posexplode("s").alias("at", "shap")).select(
        id_col, F.get(listed, F.col("at")).alias("feature"), "shap")


def tree_base(tm: TrainedModel) -> float:
    return base_value(leaf_paths(tm.pipeline.stages[-1]))
