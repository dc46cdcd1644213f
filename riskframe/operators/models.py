"""Baseline models as MLlib jobs, their search, importances and tuning grid."""

from __future__ import annotations

import itertools
import json
import random
import re
import time
from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, IsotonicRegressionModel, LinearRegression,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars
from riskframe.operators import schema
from riskframe.operators.impute import apply_standardizer, column_medians, fill_median, fit_standardizer, impute_at_inference
from riskframe.operators.ordering import exact_quantiles
from riskframe.operators.policy import leaf_table, predict_with_policy, tree_quantiles
from riskframe.operators.splits import kfold, weighted_resample
from riskframe.session import shared_folder

# Search spaces and grids.
RIDGE_ALPHAS = [0.1, 1.0, 3.0, 10.0, 30.0, 100.0]
ELASTIC_ALPHAS = [0.001, 0.01, 0.1, 1.0, 10.0]
ELASTIC_L1_RATIOS = [0.1, 0.3, 0.5, 0.7, 0.9]
FOREST_SPACE = {
    "numTrees": [300, 500, 700, 900],
    "maxDepth": [30, 8, 12, 16, 24],
    "minInstancesPerNode": [1, 2, 4, 6],
    "featureSubsetStrategy": ["sqrt", "log2", "0.4", "0.6", "0.8"],
    "subsamplingRate": [1.0, 0.7, 0.85],
}
BOOSTED_SPACE = {
    "maxIter": [300, 500, 700, 900],
    "maxDepth": [3, 4, 6, 8],
    "stepSize": [0.03, 0.05, 0.08, 0.1],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.6", "0.8", "all"],
    "minInstancesPerNode": [1, 3, 5, 7],
}
OVERSAMPLE_GRID = [2.5 + 0.5 * i for i in range(6)]
LOSS_GRID = [2.0 + 0.5 * i for i in range(17)]
ROWS_PER_TASK = 50_000  # of a stored training part, so that small parts are not fitted in many tiny tasks
STOP_ROWS = "_stop"
MEAN_METRICS = ["auc", "accuracy", "precision", "recall", "specificity", "fpr", "f1", "log_loss", "brier"]


def fit_constant(train: DataFrame, y: str, kind: str = "mean") -> float:
    """Mean or exact median of the training target."""
    if kind == "mean":
        return train.agg(F.avg(y)).first()[0]
    return exact_quantiles(train, [], y, [0.5]).first()["quantiles"][0]


def predict_constant(df: DataFrame, value: float, out: str = "y_pred") -> DataFrame:
    return df.withColumn(out, F.lit(float(value)))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def fill_values(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Training medians; columns without any value become 0."""
    return {c: 0.0 if m is None else float(m) for c, m in column_medians(train, cols).items()}


def impute_and_assemble(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                        fills: dict[str, float] | None = None) -> list[DataFrame]:
    """Training medians, or given fill values, fill every part."""
    fills = fill_values(train, cols) if fills is None else fills
    return [assemble(fill_median(d, cols, fills), cols) for d in (train, *others)]


def standardize_and_assemble(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                             impute: str = "median") -> list[DataFrame]:
    stats = fit_standardizer(train, cols, impute)
    return [assemble(apply_standardizer(d, stats), cols) for d in (train, *others)]


def ridge(alpha: float, n: int, y_std: float, y: str, weight: str | None = None) -> LinearRegression:
    """Ridge with the penalty on the scale alpha * |w|^2 against the summed square error."""
    model = LinearRegression(labelCol=y, featuresCol="features", elasticNetParam=0.0, standardization=False,
                             solver="normal", regParam=alpha / n * y_std)
    return model.setWeightCol(weight) if weight else model


class LazyForestModel(RandomForestRegressionModel):
    """A fitted forest that wraps its trees in Python when asked for them.

    The parent keeps them as a cached attribute that is read whenever the model's parameters are listed, which takes
    minutes of calls into the JVM for hundreds of trees.
    """

    @property
    def trees(self) -> list:
        return RandomForestRegressionModel.trees.func(self)


class LazyForest(RandomForestRegressor):
    def _create_model(self, java_model) -> LazyForestModel:
        return LazyForestModel(java_model)


class LazyBoostedModel(GBTRegressionModel):
    @property
    def trees(self) -> list:
        return GBTRegressionModel.trees.func(self)


class LazyBoosted(GBTRegressor):
    def _create_model(self, java_model) -> LazyBoostedModel:
        return LazyBoostedModel(java_model)


def forest(y: str, seed: int = 42, weight: str | None = None, **params) -> RandomForestRegressor:
    model = LazyForest(labelCol=y, featuresCol="features", seed=seed, cacheNodeIds=True, **params)
    return model.setWeightCol(weight) if weight else model


def boosted(y: str, seed: int = 42, **params) -> GBTRegressor:
    return LazyBoosted(labelCol=y, featuresCol="features", seed=seed, **params)


def random_draws(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """Distinct settings drawn from a search space."""
    rng = random.Random(seed)
    size = 1
    for values in space.values():
        size *= len(values)
    drawn: list[dict] = []
    while len(drawn) < min(n, size):
        one = {k: rng.choice(v) for k, v in space.items()}
        if one not in drawn:
            drawn.append(one)
    return drawn


def mean_abs_errors(scored: DataFrame, y: str) -> float:
    return scored.agg(F.avg(F.abs(F.col(y) - F.col("prediction")))).first()[0]


def fit_cost(setting: dict) -> float:
    """Size of a fit relative to other settings of its search: trees times depth; 1 where a setting has neither."""
    trees = setting.get("numTrees", setting.get("maxIter", 1))
    return float(trees) * float(setting.get("maxDepth", 1))


def stored_folds(train: DataFrame, folds: int, seed: int, id_col: str) -> DataFrame:
    """The training part with its ``fold``, written once to the shared folder in tasks of at least ROWS_PER_TASK rows."""
    shared_folder(train.sparkSession)
    part = kfold(train, folds, seed, id_col).checkpoint()
    return part.coalesce(max(1, -(-part.count() // ROWS_PER_TASK)))


def cross_validate(make: Callable[..., object], settings: Sequence[dict], train: DataFrame, y: str, folds: int = 4,
                   seed: int = 42, id_col: str = "row_id", parallelism: int = 8) -> DataFrame:
    """One row per setting: mean and deviation of the test and train scores, rank.

    The score is the negative mean absolute error.  Every fit of a setting and a
    fold reads the stored part, and one job gives its two scores.  Fits run side
    by side, the largest first and each in a scheduler pool of its own, so that
    a long fit neither comes last nor holds the others up.
    """
    spark = train.sparkSession
    part = stored_folds(train, folds, seed, id_col).persist()
    jobs = sorted(itertools.product(range(len(settings)), range(folds)), key=lambda job: -fit_cost(settings[job[0]]))

    def one(job: tuple[int, int]) -> tuple[int, float, float]:
        i, fold = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i}-{fold}")
        model = make(**settings[i]).fit(part.where(F.col("fold") != fold))
        error = F.abs(F.col(y) - F.col("prediction"))
        scores = model.transform(part).agg(F.avg(F.when(F.col("fold") == fold, error)).alias("test"),
                                           F.avg(F.when(F.col("fold") != fold, error)).alias("train")).first()
        return (i, *(None if v is None else -v for v in scores))

    try:
        with ThreadPool(parallelism) as pool:
            # each job gets local properties of its own: wrapped once, all threads would write to the same ones
            done = pool.map(lambda run: run(), [inheritable_thread_target(spark)(partial(one, job)) for job in jobs], 1)
    finally:
        part.unpersist()
    scores = spark.createDataFrame(done, "setting int, test double, train double")
    names = spark.createDataFrame(
        [(i, json.dumps(s, sort_keys=True)) for i, s in enumerate(settings)], "setting int, params string")
    table = scores.groupBy("setting").agg(
        F.avg("test").alias("mean_test_score"), F.stddev_pop("test").alias("std_test_score"),
        F.avg("train").alias("mean_train_score"), F.stddev_pop("train").alias("std_train_score"))
    return search_results(table.join(names, "setting").checkpoint())


def search_results(table: DataFrame) -> DataFrame:
    """Rank of every setting by mean test score, best first (settings are few)."""
    better = table.select(F.col("mean_test_score").alias("_s")).agg(F.collect_list("_s")).first()[0]
    higher = F.size(F.filter(F.array(*[F.lit(float(s)) for s in better]), lambda s: s > F.col("mean_test_score")))
    return table.withColumn("rank_test_score", higher + 1).orderBy("rank_test_score", "setting")


def search_and_fit(make: Callable[..., object], settings: Sequence[dict], train: DataFrame, y: str, **cv) -> dict:
    """Cross-validate, then refit the best setting on the whole training part."""
    results = cross_validate(make, settings, train, y, **cv)
    best = results.first()
    params = json.loads(best["params"])
    return {"model": make(**params).fit(train), "params": params, "best_score": best["mean_test_score"], "results": results}


def fit_forest(train: DataFrame, y: str, space: dict[str, list] = FOREST_SPACE, draws: int = 16,
               weight: str | None = None, seed: int = 42, **cv) -> dict:
    return search_and_fit(lambda **p: forest(y, seed, weight, **p), random_draws(space, draws, seed), train, y,
                          seed=seed, **cv)


def with_stop_rows(train: DataFrame, seed: int = 42, id_col: str = "row_id", share: int = 10) -> DataFrame:
    """Mark about one of ``share`` rows, by a hash of the id, for watching when boosting stops to gain (STOP_ROWS)."""
    return train.withColumn(STOP_ROWS, F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(share)) == 0)


class EarlyStopping:
    """A booster whose rounds end with the first one that makes the error on the marked rows worse.

    Rows without both marked and unmarked ones among them are fitted over all rounds.
    """

    def __init__(self, model: GBTRegressor):
        self.model = model

    def fit(self, rows: DataFrame):
        marked = rows.agg(F.count_if(F.col(STOP_ROWS)).alias("m"), F.count_if(~F.col(STOP_ROWS)).alias("u")).first()
        if not marked["m"] or not marked["u"]:
            return self.model.fit(rows)
        return self.model.copy().setParams(validationIndicatorCol=STOP_ROWS, validationTol=0.0).fit(rows)


def fit_boosted(train: DataFrame, y: str, space: dict[str, list] = BOOSTED_SPACE, draws: int = 16, seed: int = 42,
                id_col: str = "row_id", **cv) -> dict:
    """Search over boosted trees; ``maxIter`` is the most rounds, early stopping on marked training rows decides how many are kept."""
    return search_and_fit(lambda **p: EarlyStopping(boosted(y, seed, **p)), random_draws(space, draws, seed),
                          with_stop_rows(train, seed, id_col), y, seed=seed, id_col=id_col, **cv)


def class_weight(neg: float, pos: float, mode: str = "balanced", cap: float = 10.0) -> float:
    """Weight of a positive row."""
    share = neg / (pos + 1e-8)
    return {"balanced": min(share, cap), "sqrt_balanced": min(share**0.5, cap)}.get(mode, 1.0)


def high_score_weights(score: Column, above: float = 3.0, loss_weight: float = 2.0,
                       oversample: float = 2.5) -> tuple[Column, Column]:
    """Loss weight and draw weight of rows with a high score."""
    pick = lambda w: F.when(score > above, max(1.0, float(w))).otherwise(1.0)
    return pick(loss_weight), pick(oversample)


def fit_logistic(train: DataFrame, y: str, l2: float = 1e-4, mode: str = "balanced", weight: str | None = None,
                 oversample: str | None = None, seed: int = 42, id_col: str = "row_id"):
    """Weighted logistic regression on assembled features.

    The class weight comes from the whole training part.  With ``oversample``
    the part is first redrawn with those weights.
    """
    counts = train.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).first()
    if not counts["p"] or not counts["n"]:
        raise ValueError("target has only one class")
    rows = weighted_resample(train, oversample, seed, id_col) if oversample else train
    own = F.col(weight) if weight else F.lit(1.0)
    rows = rows.withColumn("_w", own * F.when(F.col(y) == 1, class_weight(counts["n"], counts["p"], mode)).otherwise(1.0))
    return LogisticRegression(labelCol=y, featuresCol="features", weightCol="_w", regParam=l2, elasticNetParam=0.0,
                              standardization=False, maxIter=200).fit(rows)


def fit_mlp(train: DataFrame, y: str, n_features: int, hidden: Sequence[int] = (96, 48), oversample: str | None = None,
            seed: int = 42, id_col: str = "row_id", max_iter: int = 100):
    """Two hidden layers; imbalance is met by redrawing the training rows."""
    rows = weighted_resample(train, oversample, seed, id_col) if oversample else train
    return MultilayerPerceptronClassifier(labelCol=y, featuresCol="features", layers=[n_features, *hidden, 2],
                                          seed=seed, maxIter=max_iter).fit(rows)


def predict_table(model, df: DataFrame, out: str = "y_pred") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out)


def importance_table(spark, names: Sequence[str], values: Sequence[float], column: str = "importance") -> DataFrame:
    """Features by size of importance or coefficient."""
    rows = [(str(n), float(v)) for n, v in zip(names, values)]
    df = spark.createDataFrame(rows, f"feature string, {column} double")
    return df.orderBy(F.abs(F.col(column)).desc(), "feature")


def feature_importance(model, names: Sequence[str], spark) -> DataFrame:
    return importance_table(spark, names, model.featureImportances.toArray())


def coefficients(model, names: Sequence[str], spark) -> DataFrame:
    return importance_table(spark, names, model.coefficients.toArray(), "coefficient")


def save_model(model, path: str, policy: dict, features: Sequence[str], spark, fills: dict[str, float] | None = None,
               target: str | None = None) -> None:
    """One folder that scores raw rows: native model, policy, calibrator, features, their fill values, and a forest's leaf table."""
    bundle = model if isinstance(model, PipelineModel) else PipelineModel([model])
    bundle.write().overwrite().save(f"{path}/model")
    trees = [s.uid for s in bundle.stages if isinstance(s, RandomForestRegressionModel)]
    for uid in trees[-1:]:
        nodes = spark.read.parquet(f"{path}/model/stages/*_{uid}/data")
        leaf_table(nodes).write.mode("overwrite").parquet(f"{path}/leaves")
    calibrator = policy.get("calibrator")
    if calibrator is not None:
        calibrator.write().overwrite().save(f"{path}/calibrator")
    facts = {k: v for k, v in policy.items() if isinstance(v, (str, int, float, bool, list, type(None))) and k != "calibrator"}
    doc = json.dumps({"policy": facts, "features": list(features), "has_calibrator": calibrator is not None, "target": target,
                      "fills": fills, "has_leaves": bool(trees)}, ensure_ascii=False)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/policy")


def load_model(path: str, spark) -> dict:
    doc = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/policy").collect()))
    calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if doc["has_calibrator"] else None
    return {"model": PipelineModel.load(f"{path}/model"), "features": doc["features"], "fills": doc.get("fills"),
            "target": doc.get("target"), "leaves": spark.read.parquet(f"{path}/leaves") if doc.get("has_leaves") else None,
            "policy": {**doc["policy"], "calibrator": calibrator}}


def score_bundle(bundle: dict, df: DataFrame, out: str = "y_pred", fill: str = "training") -> DataFrame:
    """Rows of a raw table with the prediction of a loaded bundle.

    NULLs of the features become the training medians (``fill="training"``) or
    the medians of the table being scored (``"table"``).  The bundle's policy
    (mean or a quantile of the trees) and calibrator decide the prediction.  All
    columns of the table stay as they are; one named like ``out`` is an error.
    """
    features, policy = bundle["features"], bundle["policy"]
    schema.require_columns(df, features)
    quantile = re.fullmatch(r"q(\d\d)", policy["policy"])
    qs = [int(quantile[1]) / 100] if quantile else []
    if out in df.columns or {"features", "_raw"} & set(features):
        raise ValueError(f"a column is named like a result: {out}, features or _raw")
    if quantile and bundle["leaves"] is None:
        raise ValueError(f"policy {policy['policy']} needs a forest")
    quoted = lambda cols: [F.col(f"`{c}`") for c in cols]
    rows = df.select(F.struct(*quoted(df.columns)).alias("_raw"), *quoted(features))
    if fill == "table":
        rows = impute_at_inference(rows, features)
    elif bundle["fills"] is None:
        raise ValueError("the bundle has no training medians")
    else:
        rows = fill_median(rows, features, bundle["fills"])
    rows = assemble(rows, features).select("_raw", "features")
    model = bundle["model"]
    if quantile:
        *before, last = model.stages
        scored = tree_quantiles(last, PipelineModel(before).transform(rows), qs, bundle["leaves"])
    else:
        scored = model.transform(rows).withColumnRenamed("prediction", policy["policy"])
    done = predict_with_policy(scored, policy, out)
    return done.select("_raw.*", out)


def summarize_overview(overview: DataFrame, run: Sequence[str] = ("run_id",),
                       metrics: Sequence[str] = MEAN_METRICS) -> DataFrame:
    """Mean metrics per run, over all targets and over the pain targets."""
    pain = F.lower("target").rlike("restpain|movementpain")
    have = [m for m in metrics if m in overview.columns]
    return overview.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_if(pain).alias("n_pain_targets"),
        *[F.avg(m).alias(f"mean_{m}") for m in have],
        *[F.avg(F.when(pain, F.col(m))).alias(f"pain_mean_{m}") for m in have])


def rank_runs(summary: DataFrame, objective: str = "pain_f1") -> DataFrame:
    """Best run by (objective F1, pain AUC, AUC, accuracy), NULL as -1; first run on ties."""
    c = lambda name: F.coalesce(F.col(name), F.lit(-1.0)) if name in summary.columns else F.lit(-1.0)
    first = (F.coalesce("pain_mean_f1", "mean_f1", F.lit(-1.0)) if objective == "pain_f1" else c("mean_f1"))
    key = F.struct(first, c("pain_mean_auc"), c("mean_auc"), c("mean_accuracy"), -F.col("run_id"))
    ok = summary.where(F.col("status") == "ok") if "status" in summary.columns else summary
    return ok.agg(F.max_by(F.struct(*summary.columns), key).alias("b")).select("b.*")


def rank_table(summary: DataFrame) -> DataFrame:
    """Runs in report order, where mean F1 comes third."""
    ok = summary.where(F.col("status") == "ok") if "status" in summary.columns else summary
    order = ["pain_mean_f1", "pain_mean_auc", "mean_f1", "mean_auc", "mean_accuracy"]
    return ok.orderBy(*[F.col(c).desc_nulls_last() for c in order if c in ok.columns])


def tune_grid(spark, run_one: Callable[..., list[dict]], grid: Sequence[dict], parallelism: int = 4) -> DataFrame:
    """Fit every setting, keep failed runs with their status, one row per run.

    ``run_one`` returns the overview rows (one per target) of a setting.
    """

    def one(job: tuple[int, dict]) -> tuple[dict, list[dict]]:
        run_id, setting = job
        start = time.time()
        try:
            rows, status = run_one(**setting), "ok"
        except Exception as error:  # a failed run is a result
            rows, status = [], f"failed({type(error).__name__})"
        facts = {"run_id": run_id, "status": status, "elapsed_sec": time.time() - start,
                 **{k: float(v) for k, v in setting.items()}}
        return facts, [{"run_id": run_id, **r} for r in rows]

    with ThreadPool(parallelism) as pool:
        done = pool.map(one, list(enumerate(grid, 1)))
    runs = spark.createDataFrame([f for f, _ in done])
    rows = [r for _, rs in done for r in rs]
    if not rows:
        return runs
    return runs.join(summarize_overview(spark.createDataFrame(rows)), "run_id", "left")


def tuning_settings(oversample: Sequence[float] = OVERSAMPLE_GRID, loss: Sequence[float] = LOSS_GRID) -> list[dict]:
    return [{"oversample": o, "loss_weight": w} for o in oversample for w in loss]


def scored_classes(model, df: DataFrame, p: str = "p") -> DataFrame:
    """Append the probability of class 1."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(p, F.get(vector_to_array("probability"), 1))


def to_feature_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a usable target only."""
    return df.withColumn(target, scalars.to_double(F.col(target))).where(F.col(target).isNotNull())
