"""Moment searches against plain fits per fold, and logistic grids against single MLlib fits."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import linear, models, splits
from riskframe.plans import runs


def gappy(spark, n=240, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(3, 2, (n, 3))
    y = x @ [1.0, -2.0, 0.0] + r.normal(0, 1, n)
    x[r.random((n, 3)) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], 7.0, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, same double, y double")


def folds_of(df, k):
    rows = splits.kfold(df, k, 42).toPandas().sort_values("row_id")
    return rows[["a", "b", "c", "same"]].to_numpy(float), rows["y"].to_numpy(), rows["fold"].to_numpy()


def prepared(x, train):
    fills = np.nanmedian(x[train], axis=0)
    x = np.where(np.isnan(x), fills, x)
    std = x[train].std(axis=0)
    return (x - x[train].mean(axis=0)) / np.where(std > 0, std, 1.0)


def test_ridge_search_fills_and_scales_per_fold(spark):
    df = gappy(spark)
    found = linear.search_ridge(df, ["a", "b", "c", "same"], "y", [0.5, 50.0], folds=3)
    x, y, fold = folds_of(df, 3)
    for r in found["results"].collect():
        test, own = [], []
        for f in range(3):
            train = fold != f
            z = prepared(x, train)
            w = np.linalg.solve(z[train].T @ z[train] + [0.5, 50.0][r["setting"]] * np.eye(4), z[train].T @ (y[train] - y[train].mean()))
            errors = np.abs(y - y[train].mean() - z @ w)
            test.append(-errors[~train].mean())
            own.append(-errors[train].mean())
        assert r["mean_test_score"] == pytest.approx(np.mean(test)) and r["std_test_score"] == pytest.approx(np.std(test))
        assert r["mean_train_score"] == pytest.approx(np.mean(own))
    assert found["params"] == {"alpha": 0.5}
    z = prepared(x, np.ones(len(y), bool))
    w = np.linalg.solve(z.T @ z + 0.5 * np.eye(4), z.T @ (y - y.mean()))
    got = df.select("row_id", linear.predict_line(found["model"]).alias("p")).toPandas().sort_values("row_id")["p"]
    np.testing.assert_allclose(got, y.mean() + z @ w, atol=1e-9)


def test_elastic_net_is_at_its_optimum(spark):
    x = np.random.default_rng(2).normal(size=(200, 5))
    y = x @ [2.0, 0.0, 0.0, -1.0, 0.2]
    s = {"n": 200, "xx": x.T @ x, "xy": x.T @ y}
    for alpha, ratio in ((0.1, 0.5), (1.0, 0.9), (0.01, 0.1)):
        w = linear.elastic_solution(s, alpha, ratio)
        slope = (s["xy"] - s["xx"] @ w) / 200 - alpha * (1 - ratio) * w
        assert (np.abs(slope[w == 0]) <= alpha * ratio + 1e-8).all()
        np.testing.assert_allclose(slope[w != 0], alpha * ratio * np.sign(w[w != 0]), atol=1e-8)


def test_logistic_grid_equals_single_fits(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x = r.normal(size=3)
        score = float(np.clip(3 + 2 * x[0] - x[1] + r.normal(), 0, 9))
        rows.append((i, score, float(score >= 4), [float(v) for v in x]))
    df = models.to_feature_vector(spark.createDataFrame(rows, "row_id long, score double, y double, v array<double>"), "v").drop("v")
    settings, l2 = [(2.5, 2.0), (4.0, 6.5)], 1e-4
    counts = [df.where(F.col("y") == v).count() for v in (0, 1)]
    own = F.when(F.col("y") == 1, models.class_weight(*counts)).otherwise(1.0)
    times = df
    for i, (o, _) in enumerate(settings):
        draw = df.withColumn("_d", models.high_score_weights(F.col("score"), 5.0, 1.0, o)[1])
        n = splits.weighted_resample(draw, "_d", 42).groupBy("row_id").agg(F.count("*").cast("double").alias(f"n{i}"))
        times = times.join(n, "row_id", "left")
    grid = times.select(F.lit("t").alias("target"), "y", (F.col("score") > 5).cast("double").alias("high"),
                        F.array(*[F.coalesce(f"n{i}", F.lit(0.0)) * own for i in range(2)]).alias("times"),
                        F.concat(F.array(F.lit(1.0)), vector_to_array("features"), F.array(F.lit(0.0))).alias("x"))
    betas = linear.fit_logistic_grid(grid, [(i, w) for i, (_, w) in enumerate(settings)], 5, l2)["t"]
    for i, (o, w) in enumerate(settings):
        loss, draw = models.high_score_weights(F.col("score"), 5.0, w, o)
        one = models.fit_logistic(df.withColumns({"_loss": loss, "_draw": draw}), "y", l2, weight="_loss", oversample="_draw", seed=42)
        np.testing.assert_allclose(betas[i], [one.intercept, *one.coefficients, 0.0], atol=1e-3, rtol=1e-3)
        p = 1 / (1 + np.exp(-(np.array([[1, *x, 0] for *_, x in rows]) @ betas[i])))
        single = models.scored_classes(one, df).orderBy("row_id").toPandas()["p"]
        np.testing.assert_allclose(p, single, atol=1e-4)


def test_tuning_of_all_settings(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, *[float(v) for v in r.integers(0, 10, 3)], 0.0) for i in range(200)], "row_id long, w0_a double, w1_a double, w1_b double, w1_c double")
    targets = spark.createDataFrame([(f"w1_{m}", "w1", m, f"POD1_{'RestPain' if m == 'a' else m}", "main", 5.0) for m in "abc"],
                                    "target string, day string, metric string, target_en string, target_tier string, positive_min double")
    parts = runs.prepare_logistic(df, targets, ["w0_a", "w1_a", "w1_b", "w1_c"], ["w0", "w1"])
    settings = models.tuning_settings([2.5, 3.0], [2.0, 4.0])
    rows = runs.tune_logistic(parts, settings, pain_metrics=["a"], high_above=6.0).orderBy("run_id").collect()
    assert [r["run_id"] for r in rows] == [1, 2, 3, 4] and {(r["n_targets"], r["n_pain_targets"]) for r in rows} == {(3, 1)}
    single = runs.fit_prepared(parts, targets, strategy="fixed", pain_metrics=["a"], high_above=6.0, **settings[3]).withColumn("target", F.col("target_en"))
    want = models.summarize_overview(single.withColumn("run_id", F.lit(4).cast("long"))).first()
    for name in ("mean_auc", "mean_log_loss", "pain_mean_f1", "pain_mean_brier"):
        assert rows[3][name] == pytest.approx(want[name], abs=2e-4)


def test_targets_are_prepared_from_one_reading_of_the_table(spark):
    """Whatever the number of targets; parts, fill values and scales are those of a target prepared alone."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        seen.add(1)
        return v

    r = np.random.default_rng(5)
    rows = [(i, *[None if v == 0 else float(v) for v in r.integers(0, 10, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, w0_a double, w0_b double, w1_a double, w1_b double")
    targets = [(f"w{d}_{m}", f"w{d}", m, f"w{d}_{m}", "main", 5.0) for d in (0, 1) for m in "ab"]
    dims = spark.createDataFrame(targets, "target string, day string, metric string, target_en string, target_tier string, positive_min double")
    columns = ["w0_a", "w0_b", "w1_a", "w1_b"]
    parts = runs.prepare_logistic(df.withColumn("w0_a", noted("w0_a")), dims, columns, ["w0", "w1"])
    assert seen.value <= 2 * len(rows)
    from riskframe.operators import splits
    for part in parts[2:]:
        own = splits.random_split(models.numeric_target(df, part["target"]), 0.1, 0.1, 42)
        train, test = (own.where(F.col("split") == s) for s in ("train", "test"))
        want = models.standardize_and_assemble(train, [test], ["w0_a", "w0_b"])
        for got, whole in ((part["train"], want[0]), (part["test"], want[1])):
            got, whole = (d.orderBy("row_id").select("row_id", "features").collect() for d in (got, whole))
            assert [x["row_id"] for x in got] == [x["row_id"] for x in whole]
            np.testing.assert_allclose([x["features"] for x in got], [x["features"] for x in whole], atol=1e-12)
