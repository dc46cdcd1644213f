"""Operators against brute force and against published figures."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import (augment, correlation, evaluate, impute, labels, models, neighbours, ordering, policy, profile,
                                 schema, splits)
from riskframe.presets import clinical
from riskframe.session import shared_folder


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


# --- order-based blocks ---------------------------------------------------------------


def skewed(n=6000, seed=1):
    """A third of all rows share one value; the rest is spread unevenly."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.lognormal(0, 2, n), 3)
    v[: n // 3] = 1.5
    return v


def test_exact_quantiles_of_skewed_values(spark):
    v = skewed()
    g = np.where(np.arange(len(v)) % 10 < 9, "hot", "cold")
    out = ordering.exact_quantiles(frame(spark, g=g, v=v), ["g"], "v", [0.0, 0.1, 0.5, 0.75, 1.0]).collect()
    for r in out:
        np.testing.assert_allclose(r["quantiles"], np.quantile(v[g == r["g"]], [0, 0.1, 0.5, 0.75, 1]), atol=1e-9)


def test_running_totals_and_ranks(spark):
    v = skewed(3000)
    ranks = ordering.average_ranks(frame(spark, v=v), [], "v").toPandas().set_index("v")["rank"]
    expected = pd.Series(v).rank().groupby(v).first()
    np.testing.assert_allclose(ranks.sort_index().to_numpy(), expected.sort_index().to_numpy())


def test_cut_in_hash_order_is_exact(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    cut = ordering.cut_in_hash_order(df, ["g"], ["id"], 7, {"x": lambda n: F.lit(123), "y": lambda n: n, "z": lambda n: F.lit(0)}, "n")
    got = {r["g"]: r for r in cut.groupBy("g", "n").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in "xyz"]).collect()}
    for g, n in (("a", 1667), ("b", 3333)):
        assert (got[g]["n"], got[g]["x"], got[g]["y"], got[g]["z"]) == (n, 123, n, 0)


def test_forward_fill_across_ranges(spark):
    rng = np.random.default_rng(3)
    s = pd.Series(np.where(rng.random(2000) < 0.05, rng.integers(0, 9, 2000), np.nan))
    df = spark.createDataFrame([(i, None if np.isnan(x) else float(x)) for i, x in enumerate(s)], "row_id long, v double")
    got = impute.forward_fill(df, ["v"], "row_id", span=64).orderBy("row_id").toPandas()["v"]
    pd.testing.assert_series_equal(got, s.ffill(), check_names=False)


# --- profiles ------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [skewed(900), np.full(50, 3.0)])
def test_histogram_like_numpy(spark, values):
    got = profile.histogram(frame(spark, v=values), ["v"]).orderBy("bin").toPandas()
    bins = min(30, max(10, int(np.sqrt(len(values)))))
    counts, edges = np.histogram(values, bins=bins)
    assert got["count"].tolist() == counts.tolist()
    np.testing.assert_allclose(got["bin_left"], edges[:-1], atol=1e-9)


def test_duplicates_per_parent_published(spark):
    sizes = [2] * 39 + [14] * 100 + [10] * 435
    df = spark.createDataFrame([(p,) for p, n in enumerate(sizes) for _ in range(n)], "__meta_source_row_id long")
    row = profile.duplicates_per_parent(df).first()
    assert (row["parents"], row["min"], row["max"]) == (574, 2, 14) and row["mean"] == pytest.approx(sum(sizes) / 574)


def test_one_hot_other_overwrites(spark):
    df = spark.createDataFrame([("腰麻",)] * 12 + [("其他",)] * 12 + [("少见+腰麻",)], "m string")
    hot, names = labels.one_hot_multi(df, "m", 10)
    assert sorted(names) == ["m_oh_其他", "m_oh_腰麻"]
    sums = hot.agg(*[F.sum(f"`{n}`").alias(n) for n in names]).first()
    assert sums["m_oh_腰麻"] == 13 and sums["m_oh_其他"] == 1


def test_one_hot_case_twins(spark):
    df = spark.createDataFrame([("large",)] * 3 + [("LARGE",)] * 2, "m string")
    hot, names = labels.one_hot_multi(df, "m", 1)
    assert len(names) == 3 and hot.agg(F.sum(names[0]), F.sum(names[1])).first()[:] == (3, 2)


def test_infer_binary_and_prune(spark):
    df = spark.createDataFrame([("1", "0", None, "x"), ("0", "2", None, "y"), (None, "1", "1", "z")], "a string, b string, c string, d string")
    assert schema.infer_binary_columns(df, df.columns) == ["a", "c"]
    assert schema.prune_sparse_columns(df, 0.7, ["c"]).columns == ["b", "c", "d"]


def test_feature_modes():
    days, cols = clinical.DAYS, ["年龄", *clinical.OUTCOMES, "__meta_is_generated"]
    target = "术后第一天_静息痛"
    assert schema.select_features(cols, target, clinical.OUTCOMES, days, "strict") == ["年龄"]
    assert len(schema.select_features(cols, target, clinical.OUTCOMES, days, "all")) == 20
    assert schema.select_features(cols, target, clinical.OUTCOMES, days, "temporal") == ["年龄", *clinical.OUTCOMES[:5]]
    kept, dropped = schema.temporal_filter(cols, target, days, strict_past_only=False)
    assert len(kept) == 1 + 9 + 1 and len(dropped) == 10


# --- correlations -----------------------------------------------------------------------------


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=300)
    pdf = pd.DataFrame({f"w{i}": np.round(base * i + rng.normal(size=300), 1) for i in range(4)})
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    pdf["flat"] = 1.0
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in pdf.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))
    p = correlation.pearson_pairs(df, list(pdf.columns)).toPandas().set_index(["variable_1", "variable_2"])
    s = correlation.spearman_pairs(df, list(pdf.columns)).toPandas().set_index(["variable_1", "variable_2"])
    for a, b in itertools.combinations(pdf.columns, 2):
        both = pdf[[a, b]].dropna()
        assert p.loc[(a, b), "n_pairwise"] == len(both)
        if "flat" in (a, b):
            assert pd.isna(p.loc[(a, b), "pearson_r"]) and pd.isna(s.loc[(a, b), "spearman_r"])
        else:
            assert p.loc[(a, b), "pearson_r"] == pytest.approx(both[a].corr(both[b]))
            assert s.loc[(a, b), "spearman_r"] == pytest.approx(both[a].rank().corr(both[b].rank()))


def test_p_values_known():
    # t quantiles: n = 12, df = 10, t = 2.228139 gives 0.05; df = 1, t = 1 gives 0.5
    t = np.array([2.2281388519649385, 1.0, 0.0])
    df = np.array([10.0, 1.0, 7.0])
    r = t / np.sqrt(t * t + df)
    np.testing.assert_allclose(correlation.two_sided_p(df + 2, r), [0.05, 0.5, 1.0], rtol=1e-9)


# --- splits ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,pos,expected", [
    (2674, 172, (2140, 267, 267, 138, 17, 17)), (2673, 444, (2139, 267, 267, 356, 44, 44)), (2673, 38, (2137, 268, 268, 30, 4, 4)),
    (2671, 2601, (2137, 267, 267, 2081, 260, 260)), (2679, 71, (2143, 268, 268, 57, 7, 7)), (2679, 23, (2143, 268, 268, 19, 2, 2)),
    (2680, 81, (2144, 268, 268, 65, 8, 8)), (2666, 20, (2132, 267, 267, 16, 2, 2))])
def test_published_split_sizes(spark, n, pos, expected):
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("t").alias("target"), (F.col("id") < pos).cast("long").alias("y_binary"))
    row = profile.split_summary(splits.stratified_split(df, 42).withColumn("split_seed", F.lit(42))).first()
    got = tuple(row[f"{s}_size"] for s in ("train", "validation", "test")) + tuple(row[f"{s}_positive"] for s in ("train", "validation", "test"))
    assert got == expected


def test_small_classes(spark):
    df = spark.createDataFrame([(i, "t", y) for i, y in enumerate([1] * 2 + [0] * 3 + [2])], "row_id long, target string, y_binary int")
    got = {(r["y_binary"], r["split"]): r["count"] for r in splits.stratified_split(df, 1).groupBy("y_binary", "split").count().collect()}
    assert got == {(1, "train"): 1, (1, "test"): 1, (0, "train"): 1, (0, "validation"): 1, (0, "test"): 1, (2, "train"): 1}


def test_shared_split_gives_positives_everywhere(spark):
    rng = np.random.default_rng(2)
    rows = [(i, t, int(rng.random() < 0.05)) for i in range(200) for t in ("a", "b", "c")]
    long = spark.createDataFrame(rows, "row_id long, target string, y_binary int")
    out = splits.shared_split(long, 42)
    seen = long.where("y_binary = 1").drop("target").join(out, "row_id").select("split").distinct().count()
    by = long.where("y_binary = 1").withColumnRenamed("target", "t").join(out, "row_id").groupBy("t").agg(F.countDistinct("split").alias("n"))
    assert seen == 3 and {r["n"] for r in by.collect()} == {3} and out.count() == 200


def test_shared_split_impossible(spark):
    long = spark.createDataFrame([(i, "a", int(i < 3)) for i in range(1000)], "row_id long, target string, y_binary int")
    with pytest.raises(ValueError):
        splits.shared_split(long, 1, max_tries=2)


def test_apply_split_errors(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    table = spark.createDataFrame([(i, "t", 42, "train" if i else "test") for i in range(4)], "row_id long, target string, split_seed int, split string")
    with pytest.raises(ValueError, match="without a split"):
        splits.apply_split(df, table, "t", 42)
    assert splits.apply_split(df.where("row_id < 4"), table, "t", 42).where("split = 'train'").count() == 3


def test_weighted_resample_is_whole_and_weighted(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 0, 2000.0).when(F.col("id") < 2000, 0.0).otherwise(1.0).alias("w"))
    out = splits.weighted_resample(df, "w", 3)
    row = out.agg(F.count("*"), F.countDistinct("draw"), F.count_if(F.col("row_id") == 0), F.count_if(F.col("w") == 0)).first()
    assert row[0] == row[1] == 4000 and row[3] == 0 and 1800 < row[2] < 2200


def test_balanced_pool_keeps_all_when_one_side_is_empty(spark):
    df = spark.createDataFrame([(i, 0, i) for i in range(6)], "row_id long, __meta_is_generated int, __meta_source_row_id long")
    kept, counts = splits.balanced_training_pool(df, 1)
    assert kept.count() == 6 and counts.first()["selected_total"] == 6
    smote = df.unionByName(spark.createDataFrame([(10 + i, 1, -1) for i in range(9)], df.schema))
    kept, counts = splits.balanced_training_pool(smote, 1)
    assert counts.first().asDict() == {"untouched_available": 6, "augmented_pool_available": 9, "untouched_selected": 6,
                                       "augmented_original_selected": 0, "generated_selected": 6, "selected_total": 12}


# --- augmentation and neighbours -----------------------------------------------------------------------


def test_forty_nine_candidates():
    variants = augment.jitter_variants(clinical.AUGMENT)
    assert len(variants) == 49 and len({v[4] for v in variants}) == 49
    assert "upshift_age_+0_weight_+0" in {v[4] for v in variants}


def test_unknown_parent_is_an_error(spark):
    train = augment.original_rows(spark.createDataFrame([(1, 1.0)], "row_id long, v double"), "train")
    gen = spark.createDataFrame([(9,)], "__meta_source_row_id long")
    with pytest.raises(ValueError, match="9"):
        augment.copy_control(train, gen)


def clustered(spark, n=700, d=6, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 8 * rng.integers(0, 3, size=(n, 1))
    x[: n // 3] = x[0]  # a third of the rows are copies of one
    y = (rng.random(n) < 0.2).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "row_id long, features array<double>, y int")
    return x, y, df


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    x, y, df = clustered(spark)
    out = neighbours.nearest_neighbours(df.where("y = 1"), df, 7).toPandas()
    for q in np.flatnonzero(y):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:7]
        got = out[out.query_id == q].sort_values("rank")
        assert got.neighbour_id.tolist() == order and got.label.tolist() == y[order].tolist()


def test_smote_reaches_parity_on_segments(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] > 0.9).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "row_id long, features array<double>, y int")
    out = neighbours.borderline_smote(df, 5, 10, 1).toPandas()
    assert len(out) == (y == 0).sum() - (y == 1).sum() and y[out.from_id].all() and y[out.to_id].all()
    a, b, p = x[out.from_id], x[out.to_id], np.stack(out.features.to_numpy())
    np.testing.assert_allclose(p, a + (b - a) * out.step.to_numpy()[:, None], atol=1e-12)
    second = neighbours.borderline_smote(df, 5, 10, 1, "borderline-2").toPandas()
    assert len(second) == len(out) and (second.step[second.to_id.map(lambda i: y[i] == 0)] <= 0.5).all()


def test_smote_reads_its_rows_once(spark):
    """However many searches follow; the copies of one point don't meet as one large array."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        seen.add(1)
        return v

    x, y, df = clustered(spark)
    out = neighbours.borderline_smote(df.withColumn("features", F.array(noted(F.col("features")[0]), F.col("features")[1])), 5, 10, 1, "borderline-2")
    assert out.count() == (y == 0).sum() - (y == 1).sum() and seen.value <= 2 * len(x)


def test_block_neighbours_in_pieces(monkeypatch):
    x = np.zeros((300, 3))
    x[:, 0] = np.arange(300) // 100
    rows = pd.DataFrame({"id": np.arange(300)[::-1], "x": list(x), "label": np.arange(300, dtype="int32") % 2})
    whole = pd.concat(neighbours._block_neighbours(rows, rows, 4), ignore_index=True)
    monkeypatch.setattr(neighbours, "PAIRS", 150)
    pd.testing.assert_frame_equal(pd.concat(neighbours._block_neighbours(rows, rows, 4), ignore_index=True), whole)
    assert whole[whole.query_id == 250].neighbour_id.tolist() == [200, 201, 202, 203] and (whole.distance == 0).all()


# --- metrics and policies ----------------------------------------------------------------------------------


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(6)
    n = 500
    y, p = (rng.random(n) < 0.3).astype(int), np.round(rng.random(n), 1)
    df = frame(spark, target=["t"] * n, row_id=np.arange(n), y=y, p=p)
    rank = pd.Series(p).rank()
    pos = y.sum()
    auc = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    order = np.lexsort((np.arange(n), -p))
    hits = np.cumsum(y[order]) / np.arange(1, n + 1)
    assert evaluate.auc(df).first()["auc"] == pytest.approx(auc)
    assert evaluate.average_precision(df).first()["average_precision"] == pytest.approx(hits[y[order] == 1].mean())


def test_one_class_has_no_auc(spark):
    df = frame(spark, target=["t"] * 3, row_id=[1, 2, 3], y=[0, 0, 0], p=[0.1, 0.2, 0.3])
    assert evaluate.auc(df).first()["auc"] is None
    assert evaluate.average_precision(df).first()["average_precision"] is None


def test_undefined_ratios(spark):
    df = frame(spark, y_true=[0.0, 1.0, 0.5], y_pred=[0.0, 1.0, 0.5])
    row = evaluate.tail_metrics(df).first()
    assert row["threshold_4_recall"] is None and row["threshold_4_f1"] is None and row["mae_true_1_3"] == 0.0
    flags = frame(spark, target=["t"] * 2, y=[0, 0], p=[0.1, 0.2])
    assert evaluate.confusion(flags, 0.5).first()["f1"] == 0.0


def test_published_policy_choice(spark):
    rows = [("mean", 1.3500027247528366), ("q50", 1.317603916363464), ("q60", 1.3116959028966604), ("q70", 1.3236650349298469)]
    df = spark.createDataFrame([(p, None, None, None, s, i) for i, (p, s) in enumerate(rows)],
                               "policy string, mae double, high_pain_mae double, high_pain_bias double, selection_score double, position int")
    assert policy.best_policy(df).first()["policy"] == "q60"
    score = 0.6587818308342628 + 0.1 * 3.2645703603119878 + 0.1 * 3.2645703603119878
    assert score == pytest.approx(1.3116959028966604)


def test_policy_ties_take_the_first(spark):
    df = frame(spark, y=[1.0, 5.0], mean=[1.0, 4.0], q50=[1.0, 4.0])
    assert policy.best_policy(policy.policy_scores(df, "y", ["mean", "q50"])).first()["policy"] == "mean"


def test_quantile_grid():
    assert policy.parse_quantile_grid("0.9,50, ,0.5,1.0,0") == [0.5, 0.9]
    assert policy.quantile_name(0.5) == "q50"


def test_isotonic_layer_chosen(spark):
    y = np.repeat([0.0, 2.0, 4.0], 20)
    df = frame(spark, y=y, mean=y / 4 + 1)
    choice = policy.choose_policy(df, "y", ["mean"])
    assert choice["calibration"] == "isotonic" and choice["score"] == pytest.approx(0.0, abs=1e-9)
    out = policy.predict_with_policy(frame(spark, mean=[0.0, 1.25, 9.0]), choice).toPandas()["y_pred"]
    np.testing.assert_allclose(out, [0.0, 1.0, 4.0])


def test_residual_focus_without_errors(spark):
    df = frame(spark, y=[1.0, 2.0], p=[1.0, 2.0])
    assert policy.residual_focus(df, "y", "p").agg(F.max("final_weight")).first()[0] == 1.0


# --- models ------------------------------------------------------------------------------------------------------


def regression_data(n=200, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, x @ np.array([2.0, -1.0, 0.0]) + rng.normal(size=n)


def test_ridge_closed_form(spark):
    x, y = regression_data()
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y)
    train = models.standardize_and_assemble(df, [], ["a", "b", "c"])[0]
    n, sd = train.agg(F.count("y"), F.stddev_pop("y")).first()
    got = models.ridge(10.0, n, sd, "y").fit(train).coefficients.toArray()
    z = (x - x.mean(0)) / x.std(0)
    expected = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, expected, rtol=1e-6)


def test_elastic_net_coordinate_descent(spark):
    x, y = regression_data()
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y)
    train = models.standardize_and_assemble(df, [], ["a", "b", "c"])[0]
    sd = train.agg(F.stddev_pop("y")).first()[0]
    got = models.elastic_net(0.3, 0.5, sd, "y").fit(train).coefficients.toArray()
    z, r, w = (x - x.mean(0)) / x.std(0), y - y.mean(), np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rho = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.15, 0) / (1 + 0.15)
    np.testing.assert_allclose(got, w, atol=1e-4)


def test_tree_quantiles_average_is_the_forest(spark):
    x, y = regression_data()
    df = frame(spark, a=x[:, 0], b=x[:, 1], y=y)
    train = models.impute_and_assemble(df, [], ["a", "b"])[0]
    model = models.forest("y", numTrees=7, maxDepth=4).fit(train)
    out = policy.tree_quantiles(model, train, [0.5], f"{shared_folder(spark)}/unit-forest").toPandas()
    np.testing.assert_allclose(out["mean"], out["prediction"], rtol=1e-9)
    trees = np.column_stack([[t.predict(v) for v in out["features"]] for t in model.trees])
    np.testing.assert_allclose(out["q50"], np.quantile(trees, 0.5, axis=1))


def test_search_ranks_and_saved_model(spark):
    x, y = regression_data()
    df = frame(spark, row_id=np.arange(200), a=x[:, 0], b=x[:, 1], y=y)
    train = models.standardize_and_assemble(df, [], ["a", "b"])[0]
    found = models.search_and_fit(lambda alpha: models.ridge(alpha, 100, 1.0, "y"), [{"alpha": 1.0}, {"alpha": 1e6}], train, "y", folds=2)
    assert found["params"] == {"alpha": 1.0}
    assert [r["rank_test_score"] for r in found["results"].collect()] == [1, 2]
    path = f"{shared_folder(spark)}/unit-model"
    choice = {"policy": "mean", "calibrator": None, "calibration": "none", "score": 0.5}
    models.save_model(found["model"], path, choice, ["a", "b"], spark)
    back = models.load_model(path, spark)
    assert back["features"] == ["a", "b"] and back["policy"]["policy"] == "mean"
    assert back["model"].transform(train).count() == 200


def test_class_weight_is_capped():
    assert models.class_weight(100, 1) == 10.0
    assert models.class_weight(9, 1, "sqrt_balanced") == pytest.approx(3.0)
    assert models.class_weight(9, 1, "none") == 1.0


def test_tuning_grid_keeps_failed_runs(spark):
    def run_one(oversample, loss_weight):
        if loss_weight > 2:
            raise RuntimeError("no")
        return [{"target": "POD1_RestPain", "f1": oversample / 10, "auc": 0.5}, {"target": "POD1_SedationScore", "f1": 0.9, "auc": 0.9}]

    assert len(models.tuning_settings()) == 102
    table = models.tune_grid(spark, run_one, models.tuning_settings([2.5, 3.0], [2.0, 2.5]), 1)
    assert table.count() == 4 and table.where("status = 'failed(RuntimeError)'").count() == 2
    best = models.rank_runs(table).first()
    assert best["oversample"] == 3.0 and best["pain_mean_f1"] == pytest.approx(0.3) and best["mean_f1"] == pytest.approx(0.6)


def test_synthetic_fallback_takes_the_highest(spark):
    cand = frame(spark, row_id=np.arange(50), score=np.repeat(np.arange(5.0), 10), flag=np.full(50, 0.6))
    train = frame(spark, score=[9.0] * 24 + [0.0])
    out = augment.select_synthetic(cand, train, "score", 9.0, 0.5, ["flag"]).toPandas()
    assert sorted(out["score"]) == [3.0, 3.0] + [4.0] * 10 and set(out["flag"]) == {1}
