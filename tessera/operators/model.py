"""Splits, training, search, scoring and persistence with MLlib
(M1-M11, M16-M22, M26, M27, W6).

Training data stay distributed; MLlib estimators fit on executors.  Splits
are reproducible functions of the row key (xxhash64), never ``randomSplit``
(whose result depends on partitioning), and exact per class.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import ID_LIKE_NAMES, NUMERIC, kind_of
from tessera.operators import evaluate as ev
from tessera.operators.neighbours import knn_join
from tessera.operators.ordered import row_numbers
from tessera.operators.prepare import ModelMatrix, fit_model_matrix
from tessera.session import cut_lineage, written

SEED = 42
MODEL_TYPES = ("logistic_regression", "random_forest", "gradient_boosting", "svm", "extra_trees", "knn")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def task_type(df: DataFrame, target: str, max_classes: int = 20) -> str:
    """M1: classification for text targets or at most ``max_classes`` values."""
    if kind_of(df.schema[target].dataType) != NUMERIC:
        return "classification"
    n = df.select(_q(target)).where(_q(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "classification" if n <= max_classes else "regression"


def split_random(df: DataFrame, target: str, keys: list[str], fractions=(0.7, 0.15, 0.15),
                 seed: int = SEED, stratify: bool | None = None) -> DataFrame:
    """M2: reproducible split, stratified by class unless the target is continuous (``task_type`` decides when
    ``stratify`` is not given).  Rows are ordered by a seeded hash of their key (inside each class; skew-safe
    running count) and cut at ⌊n_c·0.7⌋ and ⌊n_c·0.85⌋; adds ``split`` ∈ train / validation / test."""
    if stratify is None:
        stratify = task_type(df, target) == "classification"
    data = df.where(_q(target).isNotNull()).withColumn("__h", F.xxhash64(*[_q(k) for k in keys], F.lit(seed)))
    grp = [target] if stratify else []
    ranked = row_numbers(data, [F.col("__h"), *[_q(k) for k in keys]], grp, "__pos")
    counts = data.groupBy(*[_q(g) for g in grp]).agg(F.count(F.lit(1)).alias("__n"))
    if grp:
        j = ranked.join(counts, grp)                         # one row per class: broadcast only if it is small
    else:
        j = ranked.withColumn("__n", F.lit(counts.first()["__n"]))
    a, b = fractions[0], fractions[0] + fractions[1]
    split = (F.when(F.col("__pos") <= F.floor(F.col("__n") * a), "train")
             .when(F.col("__pos") <= F.floor(F.col("__n") * b), "validation").otherwise("test"))
    return j.withColumn("split", split).drop("__h", "__pos", "__n")


def split_temporal(df: DataFrame, date_col: str, keys: list[str], target: str | None = None,
                   fractions=(0.7, 0.15, 0.15)) -> DataFrame:
    """Chronological split by row position (ties on the key), rows
    with a null target removed first.  Positions come from a range-
    partitioned running count, not a single-partition window."""
    data = df.where(_q(target).isNotNull()) if target else df
    ranked = row_numbers(data, [_q(date_col), *[_q(k) for k in keys]], [], "__pos")
    n = data.count()
    a, b = int(n * fractions[0]), int(n * (fractions[0] + fractions[1]))
    split = F.when(F.col("__pos") <= a, "train").when(F.col("__pos") <= b, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("__pos")


def split_auto(df: DataFrame, target: str, keys: list[str], fractions=(0.7, 0.15, 0.15)) -> DataFrame:
    """M3 ``auto``: chronological when the table has a date column (D6), else random."""
    from tessera.functions.scalar import to_timestamp_any
    from tessera.operators.dtypes import detect_date_column
    date = detect_date_column(df.drop(target))
    if date is None:
        return split_random(df, target, keys, fractions)
    # Text dates are ordered by the time they stand for; rows without a date come first.
    return split_temporal(df.withColumn("__when", to_timestamp_any(_q(date))), "__when", keys, target, fractions).drop("__when")


def class_weights(df: DataFrame, target: str, below: float = 0.2, name: str = "weight") -> DataFrame:
    """M4: balanced weights n / (k · n_c) when minority/majority < ``below``,
    else 1.  Class counts are a tiny table joined by broadcast."""
    counts = df.groupBy(_q(target).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    s = counts.agg(F.sum("__n").alias("N"), F.count(F.lit(1)).alias("k"), F.min("__n").alias("mn"),
                   F.max("__n").alias("mx")).first()
    if s["mx"] and s["mn"] / s["mx"] < below:
        w = counts.select("__c", (F.lit(s["N"]) / (F.lit(s["k"]) * F.col("__n"))).alias(name))
        w = F.broadcast(w) if s["k"] <= 10_000 else w
        return df.join(w, _q(target).eqNullSafe(F.col("__c")), "left").drop("__c")
    return df.withColumn(name, F.lit(1.0))


def build_estimator(model_type: str, task: str, n_classes: int = 2, weight_col: str | None = None,
                    params: dict | None = None):
    """M5-M9: the MLlib estimator for a model name and task."""
    p = dict(params or {})
    common = {"featuresCol": "features", "labelCol": "label"}
    if task == "classification":
        if model_type == "logistic_regression":
            est = LogisticRegression(maxIter=p.pop("maxIter", 100), **common)
        elif model_type in ("random_forest", "extra_trees"):
            est = RandomForestClassifier(numTrees=p.pop("numTrees", 100), seed=SEED,
                                         bootstrap=(model_type == "random_forest"), **common)
        elif model_type == "gradient_boosting":
            est = GBTClassifier(maxIter=p.pop("maxIter", 100), seed=SEED, **common)
            if n_classes > 2:
                return OneVsRest(classifier=est, **common)
        elif model_type == "svm":
            est = LinearSVC(**common)
            if n_classes > 2:
                return OneVsRest(classifier=est, **common)
        else:
            raise ValueError(f"unknown model type {model_type!r}")
    else:
        if model_type == "logistic_regression":
            est = LinearRegression(**common)
        elif model_type in ("random_forest", "extra_trees"):
            est = RandomForestRegressor(numTrees=p.pop("numTrees", 100), seed=SEED,
                                        bootstrap=(model_type == "random_forest"), **common)
        elif model_type == "gradient_boosting":
            est = GBTRegressor(maxIter=p.pop("maxIter", 100), seed=SEED, **common)
        elif model_type == "svm":       # a robust linear fit stands in for the missing support-vector regression
            est = LinearRegression(loss="huber", **common)
        else:
            raise ValueError(f"no {model_type!r} model for {task}")
    if weight_col and est.hasParam("weightCol"):
        est.setWeightCol(weight_col)
    for k, v in p.items():
        est.set(est.getParam(k), v)
    return est


def param_grid(est, model_type: str, draws: int = 10, seed: int = SEED):
    """Up to ``draws`` parameter maps sampled from a grid."""
    g = ParamGridBuilder()
    if model_type == "logistic_regression" and est.hasParam("regParam"):
        g = g.addGrid(est.regParam, [0.0, 0.001, 0.01, 0.1, 1.0, 10.0]).addGrid(est.elasticNetParam, [0.0, 0.5, 1.0])
    elif model_type in ("random_forest", "extra_trees") and est.hasParam("maxDepth"):
        g = (g.addGrid(est.numTrees, [20, 50, 100]).addGrid(est.maxDepth, [3, 5, 8])
             .addGrid(est.minInstancesPerNode, [1, 2, 5]))
    elif model_type == "gradient_boosting" and est.hasParam("maxDepth"):
        g = (g.addGrid(est.maxIter, [20, 50, 100]).addGrid(est.maxDepth, [3, 5, 7]).addGrid(est.stepSize, [0.01, 0.05, 0.1, 0.2])
             .addGrid(est.subsamplingRate, [0.8, 1.0]))
    elif model_type == "svm" and est.hasParam("regParam"):
        g = g.addGrid(est.regParam, [0.0, 0.001, 0.01, 0.1, 1.0])
    maps = g.build()
    random.Random(seed).shuffle(maps)
    return maps[:draws]


#: Training rows that one task takes before there is a second one, and numbers that it takes before there are more than
#: two tasks per core.
ROWS = 16384
NUMBERS = 1 << 22


def compacted(rows: DataFrame, least: int = 1) -> DataFrame:
    """The rows in as few partitions as their number asks for, ``least`` or more.  A fit runs hundreds of short jobs
    over them, and each costs a task or two per partition: beyond two for each core (``least`` is 1), a partition takes more rows."""
    n = rows.count()
    parts = math.ceil(n / ROWS)
    if least == 1:
        full = math.ceil(n / max(ROWS, NUMBERS // len(rows.columns)))
        parts = min(parts, max(2 * rows.sparkSession.sparkContext.defaultParallelism, full))
    return rows.coalesce(max(least, parts))


def _draws_rows(est) -> bool:
    """Whether rows are drawn partition by partition: few partitions are then left as they are, and with them the draw."""
    return est.hasParam("bootstrap") and est.getOrDefault("bootstrap")


class NeighbourModel:
    """The vote (or mean) of the k nearest training rows; ``table`` holds their vectors and labels."""

    def __init__(self, table: DataFrame, inputs: list[str], k: int, n_classes: int):
        self.table, self.inputs, self.k, self.n_classes = table, inputs, k, n_classes

    @property
    def stages(self) -> list:
        return [self]

    @staticmethod
    def fit(prepared: DataFrame, inputs: list[str], n_classes: int, k: int = 5) -> "NeighbourModel":
        rows = prepared.select(F.monotonically_increasing_id().alias("__row"), F.array(*map(_q, inputs)).alias("v"),
                               F.col("label").cast("double").alias("label"))
        return NeighbourModel(written(rows, "neighbours"), inputs, k, n_classes)

    def transform(self, df: DataFrame) -> DataFrame:
        rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
        near = knn_join(rows.select("__row", F.array(*map(_q, self.inputs)).alias("v")), self.table, self.k, len(self.inputs), "v", "__row")
        voted = near.join(self.table.select(F.col("__row").alias("point"), F.col("label").alias("__y")), "point").groupBy(
            F.col("query").alias("__row"))
        if not self.n_classes:
            out = voted.agg(F.avg("__y").alias("prediction"))
        else:
            out = voted.agg(F.array(*[F.avg((F.col("__y") == i).cast("double")) for i in range(self.n_classes)]).alias("probability"))
            out = out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
        return rows.join(out, "__row", "left").drop("__row")


def _array(df: DataFrame, name: str) -> Column:
    return F.col(name) if df.schema[name].dataType.typeName() == "array" else vector_to_array(name)


@dataclass
class TrainedModel:
    model_type: str
    task: str
    pipeline: PipelineModel | NeighbourModel
    matrix: ModelMatrix
    threshold: float | None
    threshold_method: str | None = None
    #: Values of the (encoded) target, in order; the models see their positions.
    classes: list | None = None
    search_note: str | None = None

    @property
    def positive(self):
        return self.classes[1] if self.classes and len(self.classes) > 1 else 1.0

    def predict(self, df: DataFrame) -> DataFrame:
        """Same encoding, aligned columns (absent → 0), probabilities."""
        return self.predict_keep(df, [])

    def predict_keep(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The model matrix with ``prediction`` (a value of the target); two classes: ``score`` (probability or margin of
        the second one), more: ``scores`` (one per class)."""
        out = self.pipeline.transform(self.matrix.transform(df, keep))
        if self.task != "classification":
            return out
        classes = self.classes if self.classes is not None else [0.0, 1.0]
        given = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
        if given and len(classes) > 2:
            out = out.withColumn("scores", _array(out, given))
        elif given:
            out = out.withColumn("score", F.get(_array(out, given), F.lit(1)))
            if self.threshold is not None:   # M17: given, optimal or default cut, on margins too
                out = out.withColumn("prediction", F.when(F.col("score") >= self.threshold, 1.0).otherwise(0.0))
        if classes != list(range(len(classes))):
            values = F.array(*[F.lit(float(c)) for c in classes])
            out = out.withColumn("prediction", F.get(values, F.col("prediction").cast("int")))
        return out

    def save(self, path: str) -> str:
        """The fitted pipeline plus a small JSON metadata table; dictionaries and neighbours as Parquet."""
        meta = {"model_type": self.model_type, "task": self.task, "threshold": self.threshold, "classes": self.classes,
                "target": self.matrix.target, "numeric": self.matrix.numeric, "medians": self.matrix.medians,
                "encoders": [{"column": e.column, "categories": e.categories, "size": e.size} for e in self.matrix.encoders],
                "target_categories": self.matrix.target_encoder.categories if self.matrix.target_encoder else None}
        for i, e in enumerate(self.matrix.encoders):
            if e.table is not None:
                e.table.write.mode("overwrite").parquet(f"{path}/dictionary-{i}")
        if isinstance(self.pipeline, NeighbourModel):
            self.pipeline.table.write.mode("overwrite").parquet(path + "/neighbours")
            meta |= {"k": self.pipeline.k, "n_classes": self.pipeline.n_classes}
        else:
            self.pipeline.write().overwrite().save(path + "/pipeline")
        from pyspark.sql import SparkSession
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
            .write.mode("overwrite").json(path + "/meta")
        return path


def load_model(path: str) -> TrainedModel:
    from pyspark.sql import SparkSession

    from tessera.operators.prepare import Encoder
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(path + "/meta").first()["meta"])
    encs = [Encoder("one_hot", e["column"], e["categories"], drop_first=True, size=e["size"],
                    table=spark.read.parquet(f"{path}/dictionary-{i}") if e["size"] else None)
            for i, e in enumerate(meta["encoders"])]
    tenc = Encoder("label", meta["target"], meta["target_categories"]) if meta["target_categories"] else None
    mm = ModelMatrix(meta["target"], meta["numeric"], meta["medians"], encs, tenc)
    if "k" in meta:
        fitted = NeighbourModel(spark.read.parquet(path + "/neighbours"), mm.inputs, meta["k"], meta["n_classes"])
    else:
        fitted = PipelineModel.load(path + "/pipeline")
    return TrainedModel(meta["model_type"], meta["task"], fitted, mm, meta["threshold"], classes=meta["classes"])


def target_classes(matrix: ModelMatrix, data: DataFrame) -> list:
    """The values of the encoded target, in order."""
    encoded = data.select(_q(matrix.target))
    if matrix.target_encoder is not None:
        encoded = matrix.target_encoder.transform(encoded)
    values = encoded.select(_q(matrix.target).cast("double").alias("y")).where("y is not null").distinct().orderBy("y").collect()
    return [r["y"] for r in values]


def fit_rows(train: DataFrame, matrix: ModelMatrix, weight_col: str | None = None, classes: list | None = None) -> DataFrame:
    """The model matrix of the training rows with ``label`` (positions of ``classes``) and the weight."""
    keep = [weight_col] if weight_col and weight_col in train.columns else []
    prepared = matrix.transform(train, keep).withColumnRenamed(matrix.target, "label")
    if classes is not None and classes != list(range(len(classes))):
        place = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), F.col("label").cast("double")) - 1
        prepared = prepared.withColumn("label", place.cast("double"))
    return prepared


def fit_model(train: DataFrame, matrix: ModelMatrix, model_type: str, task: str, n_classes: int = 2,
              weight_col: str | None = None, search: bool = False, folds: int = 3, classes: list | None = None,
              notes: list | None = None, prepared: DataFrame | None = None) -> PipelineModel | NeighbourModel:
    """Fit VectorAssembler + estimator; with ``search`` a 3-fold
    CrossValidator over ≤ 10 sampled parameter maps (falls back to the
    defaults if the search fails, and says why in ``notes``).  ``prepared``:
    the ``fit_rows`` of ``train``, if the caller has them; their lineage goes out with every task, so it is cut."""
    if prepared is None:
        prepared = cut_lineage(fit_rows(train, matrix, weight_col, classes))
    if model_type == "knn":
        if matrix.inputs != matrix.feature_names:
            raise ValueError("nearest neighbours need few categories")
        return NeighbourModel.fit(prepared, matrix.inputs, n_classes if task == "classification" else 0)
    asm = VectorAssembler(inputCols=matrix.inputs, outputCol="features", handleInvalid="keep")
    est = build_estimator(model_type, task, n_classes, weight_col if weight_col in prepared.columns else None)
    least = 16 if _draws_rows(est) else 1
    if search:
        # The folds CrossValidator would draw, drawn before the partitions are merged.
        folded = prepared.withColumn("__draw", F.rand(SEED))
        cuts = [F.col("__draw") >= F.lit(i * (1.0 / folds)) for i in range(1, folds)]
        folded = cut_lineage(folded.withColumn("__fold", reduce(add, [c.cast("int") for c in cuts], F.lit(0))).drop("__draw"))
        try:
            ev_ = (MulticlassClassificationEvaluator(metricName="f1") if task == "classification"
                   else RegressionEvaluator(metricName="r2"))
            cv = CrossValidator(estimator=est, estimatorParamMaps=param_grid(est, model_type), evaluator=ev_,
                                numFolds=folds, seed=SEED, parallelism=4, foldCol="__fold")
            model = Pipeline(stages=[asm, cv]).fit(compacted(folded, least))
            best = model.stages[1].bestModel
            return PipelineModel(stages=[model.stages[0], best])
        except Exception as e:  # noqa: BLE001 - the reference falls back to defaults
            if notes is not None:
                notes.append(f"search failed, defaults used: {type(e).__name__}: {e}"[:500])
    return Pipeline(stages=[asm, est]).fit(compacted(prepared, least))


def _metrics_for(pred: DataFrame, task: str, classes: list | None = None) -> DataFrame:
    """M12-M14 of one frame with label and prediction: binary for two classes, else support-weighted and the mean
    one-vs-rest AUC; R² and RMSE for numbers."""
    if task == "classification":
        classes = classes or [0.0, 1.0]
        if len(classes) > 2:
            m = ev.classification_metrics(pred, "label", "prediction", average="weighted")
        else:
            m = ev.classification_metrics(pred, "label", "prediction", positive=classes[-1])
        auc = None
        if "score" in pred.columns:
            auc = ev.roc_auc(pred, "label", "score", classes[-1]).first()["auc"]     # one number
        elif "scores" in pred.columns:
            each = pred.select("label", *[F.get("scores", F.lit(i)).alias(f"s{i}") for i in range(len(classes))])
            auc = ev.multiclass_auc(each, "label", {c: f"s{i}" for i, c in enumerate(classes)}).first()["auc"]
        m = m.withColumn("auc", F.lit(auc).cast("double"))
        return m.withColumn("r2", F.lit(None).cast("double")).withColumn("rmse", F.lit(None).cast("double"))
    m = ev.regression_metrics(pred, "label", "prediction")
    for c in ("accuracy", "precision", "recall", "f1", "auc"):
        m = m.withColumn(c, F.lit(None).cast("double"))
    return m


def _split_metrics(tm: "TrainedModel", data: DataFrame, target: str, split_col: str) -> list:
    """Metrics of one model on the three splits: ONE prediction pass (cached),
    the three metric tables unioned into one collect."""
    pred = tm.predict_keep(data, [split_col]).withColumnRenamed(target, "label").cache()
    parts = [_metrics_for(pred.where(F.col(split_col) == sp), tm.task, tm.classes).withColumn("split", F.lit(sp))
             for sp in ("train", "validation", "test")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()
    pred.unpersist()
    return out


def _fit_one(mt, data, matrix, target, task, classes, split_col, threshold, search, train, prepared):
    notes = []
    n_classes = len(classes) if classes is not None else 0
    pm = fit_model(train, matrix, mt, task, n_classes, weight_col="__weight", search=search, classes=classes, notes=notes,
                   prepared=prepared)
    tm = TrainedModel(mt, task, pm, matrix, None, classes=classes, search_note=notes[0] if notes else None)
    if task == "classification" and n_classes == 2:
        if threshold is not None:
            tm.threshold, tm.threshold_method = float(threshold), "user_specified"
        else:
            val = tm.predict(data.where(F.col(split_col) == "validation")).withColumnRenamed(target, "label")
            best = ev.optimal_threshold(val, "label", "score", tm.positive).first() if "score" in val.columns else None
            tm.threshold = float(best["threshold"]) if best else 0.5
            tm.threshold_method = "optimal" if best else "default"
    return tm, _split_metrics(tm, data, target, split_col)


def train_compare(df: DataFrame, target: str, keys: list[str], model_types=MODEL_TYPES,
                  features: list[str] | None = None, threshold: float | None = None,
                  search: bool = False, split_col: str | None = None,
                  parallelism: int = 4, split: str = "random") -> tuple[DataFrame, dict]:
    """Train every model type on the train split, metrics on the three
    splits, best by validation F1 (or R²); unknown types / failures give a
    row with ``error = -1`` and the reason.  ``split`` is random or auto
    (``split_auto``) when no ``split_col`` is given.  Model types are fitted concurrently (Spark
    runs jobs from several driver threads at once, like CrossValidator's
    ``parallelism``).  Returns (metrics table, {type: TrainedModel})."""
    from concurrent.futures import ThreadPoolExecutor
    spark = df.sparkSession
    task = task_type(df, target)
    data = df if split_col else (split_auto if split == "auto" else split_random)(df, target, keys)
    split_col = split_col or "split"
    data = data.cache()
    features = features or [c for c in data.columns
                            if c not in (target, split_col, *keys) and c.lower() not in ID_LIKE_NAMES]
    matrix = fit_model_matrix(data.where(F.col(split_col) == "train"), target, features)
    classes = target_classes(matrix, data) if task == "classification" else None
    rows, models = [], {}
    schema = ("model_type string, split string, accuracy double, precision double, recall double, f1 double, "
              "auc double, r2 double, rmse double, threshold double, threshold_method string, error double, message string")
    train = data.where(F.col(split_col) == "train")
    if task == "classification":   # M4
        train = class_weights(train, target, name="__weight")
    prepared = cut_lineage(fit_rows(train, matrix, "__weight", classes))    # the same for every model type
    scored = compacted(data)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        futs = {mt: pool.submit(_fit_one, mt, scored, matrix, target, task, classes, split_col, threshold, search, train, prepared)
                for mt in model_types}
        for mt in model_types:
            try:
                tm, mets = futs[mt].result()
                models[mt] = tm
                for m in mets:
                    rows.append((mt, m["split"], m["accuracy"], m["precision"], m["recall"], m["f1"], m["auc"],
                                 m["r2"], m["rmse"], tm.threshold, tm.threshold_method, None, tm.search_note))
            except Exception as e:  # noqa: BLE001 - unknown type or failed fit → error row
                rows.append((mt, "error", None, None, None, None, None, None, None, None, None, -1.0, f"{type(e).__name__}: {e}"[:500]))
    res = spark.createDataFrame(rows, schema)
    key = "f1" if task == "classification" else "r2"
    best = (res.where(F.col("split") == "validation").orderBy(F.desc_nulls_last(key), "model_type")
            .select("model_type").limit(1).collect())
    best_type = best[0]["model_type"] if best else None
    data.unpersist()
    return res.withColumn("is_best", F.col("model_type") == F.lit(best_type)), models


def feature_importance(tm: TrainedModel) -> DataFrame:
    """Tree importances or mean |coefficient|, sorted, 6 places."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = tm.pipeline.stages[-1]
    names = tm.matrix.feature_names

    def of(m) -> list[float] | None:
        if hasattr(m, "featureImportances"):
            return m.featureImportances.toArray().tolist()
        if hasattr(m, "coefficientMatrix"):
            return abs(m.coefficientMatrix.toArray()).mean(0).tolist()
        if hasattr(m, "coefficients"):
            return abs(m.coefficients.toArray()).tolist()
        if hasattr(m, "models"):     # one model per class: their mean
            parts = [of(x) for x in m.models]
            return [sum(v) / len(v) for v in zip(*parts)] if None not in parts else None
        return None

    vals = of(m)
    if vals is None:
        vals = [0.0] * len(names)
    df = spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(names, vals)], "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def learning_curve(df: DataFrame, target: str, keys: list[str], model_type: str = "logistic_regression",
                   sizes=(0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 5) -> DataFrame:
    """Mean train / test score per train size over hash folds; nested
    hash fractions keep each smaller train set inside the larger one."""
    spark = df.sparkSession
    task = task_type(df, target)
    data = df.where(_q(target).isNotNull()).withColumn(
        "__fold", F.pmod(F.xxhash64(*[_q(k) for k in keys], F.lit(SEED)), F.lit(folds))).withColumn(
        "__u", (F.pmod(F.xxhash64(*[_q(k) for k in keys], F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30))).cache()
    from concurrent.futures import ThreadPoolExecutor
    known = None    # the classes of a numeric target are the same for every fit
    if task == "classification" and kind_of(df.schema[target].dataType) == NUMERIC:
        known = target_classes(ModelMatrix(target, [], {}, [], None), data)

    def one(s, f):
        train = data.where((F.col("__fold") != f) & (F.col("__u") < s))
        test = data.where(F.col("__fold") == f)
        mm = fit_model_matrix(train, target)
        classes = known or (target_classes(mm, data) if task == "classification" else None)
        pm = fit_model(train, mm, model_type, task, len(classes or ()), classes=classes)
        tm = TrainedModel(model_type, task, pm, mm, 0.5 if classes and len(classes) == 2 else None, classes=classes)
        scores = []
        for part in (train, test):
            m = _metrics_for(tm.predict(part).withColumnRenamed(target, "label"), task, classes).first()
            scores.append(m["f1"] if task == "classification" else m["r2"])
        return scores

    with ThreadPoolExecutor(max_workers=4) as pool:
        futs = {(s, f): pool.submit(one, s, f) for s in sizes for f in range(folds)}
        res = {k: v.result() for k, v in futs.items()}
    rows = [(float(s), sum(res[(s, f)][0] for f in range(folds)) / folds,
             sum(res[(s, f)][1] for f in range(folds)) / folds) for s in sizes]
    data.unpersist()
    out = spark.createDataFrame(rows, "train_size double, train_score double, test_score double")
    return out.withColumn("diagnosis", ev.fit_diagnosis_col(F.col("train_score"), F.col("test_score"),
                                                            "f1" if task == "classification" else "r2"))


def model_card(tm: TrainedModel, metrics: DataFrame, data: DataFrame, target: str) -> DataFrame:
    """One row — parameters, test metrics, top-10 features, data summary
    and limitations (rows < 1000, columns > 100, fit status, imbalance)."""
    from tessera.operators.profile import class_balance
    # the card's inputs are a handful of fitted numbers: gathered first
    top = [r["feature"] for r in feature_importance(tm).limit(10).collect()]
    mets = {r["split"]: r for r in metrics.where(F.col("model_type") == tm.model_type).collect()}
    cb = class_balance(data, target).first()["class_balance"]
    te, tr = mets.get("test"), mets.get("train")
    card = data.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(cb).cast("double").alias("class_balance"),
        F.array(*[F.lit(t) for t in top]).cast("array<string>").alias("top_features"),
        F.lit(te["f1"] if te else None).cast("double").alias("test_f1"),
        F.lit(te["auc"] if te else None).cast("double").alias("test_auc"),
        F.lit(te["r2"] if te else None).cast("double").alias("test_r2"),
        F.lit(tr["f1"] if tr else None).cast("double").alias("train_f1"))
    n_cols = len(data.columns)
    lim = F.filter(F.array(
        F.when(F.col("n_rows") < 1000, F.lit("fewer than 1000 rows")),
        F.when(F.lit(n_cols) > 100, F.lit("more than 100 columns")),
        F.when(ev.fit_diagnosis_col(F.col("train_f1"), F.col("test_f1")) != "good_fit",
               ev.fit_diagnosis_col(F.col("train_f1"), F.col("test_f1"))),
        F.when(F.col("class_balance") < 0.2, F.lit("imbalanced classes"))), lambda x: x.isNotNull())
    last = tm.pipeline.stages[-1]
    params = json.dumps({"k": str(last.k)} if isinstance(last, NeighbourModel) else {
        p.name: str(v) for p, v in last.extractParamMap().items()
        if p.name in ("maxIter", "regParam", "numTrees", "maxDepth", "stepSize")})
    return card.select(F.lit(tm.model_type).alias("model_type"), F.lit(params).alias("parameters"),
                       "n_rows", F.lit(n_cols).alias("n_columns"), "class_balance", "top_features",
                       "test_f1", "test_auc", "test_r2", lim.alias("limitations"))
