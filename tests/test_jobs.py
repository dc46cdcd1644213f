"""Whole jobs: raw table to features, files in and out, run registry."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import models, registry
from riskframe.plans.vectorize import vectorize_table
from riskframe.sources import tables


def test_gbk_and_bom(spark, tmp_path):
    text = "年份,性别\n2023,男\n2024,女\n"
    (tmp_path / "g.csv").write_bytes(text.encode("gbk"))
    (tmp_path / "u.csv").write_bytes(text.encode("utf-8-sig"))
    for name in ("g.csv", "u.csv"):
        df = tables.read_table(spark, str(tmp_path / name))
        assert df.columns == ["年份", "性别"] and [r["性别"] for r in df.collect()] == ["男", "女"]
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xfe\xfd,1\n")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "bad.csv"), ["utf-8"])


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x\ny",1\nz,2\n', encoding="utf-8")
    assert tables.read_table(spark, str(tmp_path / "q.csv")).count() == 2


def test_row_ids_follow_the_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("v\n" + "\n".join(str(i) for i in range(5000)), encoding="utf-8")
    df = tables.with_row_id(tables.read_table(spark, str(tmp_path / "r.csv"), multi_line=False))
    assert df.where(F.col("row_id") != F.col("v").cast("long")).count() == 0


def test_write_table_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, split string")
    tables.write_table(df, str(tmp_path / "t"), partition_by=["split"])
    assert spark.read.parquet(str(tmp_path / "t")).where("split = 'a'").count() == 1
    tables.write_metrics(spark.createDataFrame([(0.5, None)], "mae double, r2 double"), str(tmp_path / "m"))
    part = next((tmp_path / "m").glob("part-*.json"))
    assert json.loads(part.read_text()) == {"mae": 0.5, "r2": None}


def raw_rows():
    base = {"年份": "2023", "手术日期": "3.28", "性别": "男", "年龄": "65岁", "体重": "60kg", "ASA分级": "Ⅱ", "手术名称": "剖宫产",
            "麻醉方法": "腰麻", "镇痛方式": "PCIA", "镇痛泵配方": "舒芬100ug+帕洛诺司琼0.25mg,150ml 2ml/h", "总量": None, "背景量": None,
            "阻滞镇痛部位": "TAP", "阻滞镇痛配方": "0.375%罗哌卡因各20ml", "床号": "3", "补充_x": "y", "手术当天_静息痛": "3分", "稀疏": None}
    rows = [dict(base) for _ in range(12)]
    rows[1].update(年份=None, 手术日期=None, 体重=None)
    rows[2].update(年龄="77", 体重="8")
    rows[3].update({"ASA分级": None, "总量": "1500", "镇痛泵配方": "布托啡诺1.0g"})
    rows[4].update({"阻滞镇痛部位": None, "阻滞镇痛配方": None, "手术当天_静息痛": None, "麻醉方法": "少见法"})
    rows[5].update({"镇痛泵配方": None, "背景量": None})
    return [{"row_id": i, **r} for i, r in enumerate(rows)]


def test_vectorize_table(spark):
    rows = raw_rows()
    schema = ", ".join(["row_id long", *[f"`{c}` string" for c in rows[0] if c != "row_id"]])
    out = vectorize_table(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).orderBy("row_id").collect()
    first = out[0].asDict()
    for gone in ("床号", "补充_x", "稀疏", "镇痛方式_oh_其他", "阻滞镇痛部位_局部浸润", "阻滞镇痛用药_has_利多卡因"):
        assert gone not in first
    expected = {"性别_num": 1.0, "ASA分级_num": 2.0, "手术类型_产科": 1, "手术类型_妇科": 0, "麻醉方法_oh_腰麻": 1, "麻醉方法_oh_其他": 0,
                "镇痛方式_oh_PCIA": 1, "阻滞镇痛部位_腹壁平面阻滞": 1, "总量": 150.0, "背景量": 2.0, "镇痛泵配方_has_舒芬": 1, "镇痛泵配方_舒芬_mg": 0.1,
                "镇痛泵配方_帕洛诺司琼_mg": 0.25, "镇痛泵配方_has_地佐辛": 0, "镇痛泵配方_地佐辛_mg": 0.0, "阻滞镇痛用药_罗哌卡因_dose": 150.0,
                "阻滞镇痛用药_总量": 150.0, "阻滞镇痛用药_总体积_ml": 40.0, "年份": 2023.0, "年龄": 65.0, "体重": 60.0, "手术月份": 3, "手术星期": 1,
                "手术当天_静息痛": 3.0}
    assert {k: first[k] for k in expected} == expected
    assert (out[1]["年份"], out[1]["手术月份"], out[1]["体重"]) == (2023.0, 3, 60.0)
    assert (out[2]["年龄"], out[2]["体重"]) == (59.0, 77.0)
    assert (out[3]["ASA分级_num"], out[3]["总量"], out[3]["镇痛泵配方_布托啡诺_mg"], out[3]["背景量"]) == (2.0, 150.0, 1.0, 4.0)
    assert (out[4]["阻滞镇痛部位_未记录/未实施"], out[4]["阻滞镇痛用药_总量"], out[4]["手术当天_静息痛"], out[4]["麻醉方法_oh_其他"]) == (1, 0.0, None, 1)
    assert (out[5]["总量"], out[5]["背景量"]) == (200.0, 4.0)


def test_registry_of_small_outputs(spark, tmp_path):
    run = tmp_path / "models" / "random_forest" / "outputs" / "raw"
    run.mkdir(parents=True)
    (run / "metrics.json").write_text(json.dumps({
        "target_column": "术后第一天_静息痛", "mae": 0.5, "rmse": 0.7, "r2": None, "accuracy": 0.0, "n_samples": 10,
        "hyperparameter_search": {"enabled": True, "best_score": -0.4, "best_params": {"n": 3}}, "threshold_4_recall": None}), encoding="utf-8")
    (run / "test_predictions.csv").write_text("y_true,y_pred,abs_error\n4,5,1\n5,3,2\n1,1,0\n", encoding="utf-8-sig")
    skipped = tmp_path / "tuning_records" / "x"
    skipped.mkdir(parents=True)
    (skipped / "metrics.json").write_text("{}", encoding="utf-8")
    for version, head, row in (("raw", "target,auc,accuracy", "POD1_RestPain,0.8,0.9"), ("new", "target,target_column,auc,f1", "POD1_RestPain,术后第一天_静息痛,0.7,nan")):
        folder = tmp_path / "models" / "logistic" / "outputs" / version
        folder.mkdir(parents=True)
        (folder / "prediction_overview_all_targets.csv").write_text(f"{head}\n{row}\n", encoding="utf-8-sig")
    rows = registry.registry(spark, str(tmp_path))
    assert rows.columns == registry.REGISTRY_COLUMNS and len(rows.columns) == 60 and rows.count() == 3
    forest = rows.where("task_type = 'regression'").first()
    assert (forest["model_family"], forest["run_name"], forest["group_name"]) == ("randomforest", "random_forest_raw", "raw")
    assert (forest["acc"], forest["r2"], forest["hyperparam_search_best_score"]) == ("0.0", None, "-0.4")
    assert (forest["high_pain_recall_at_4"], forest["high_pain_precision_at_4"], forest["high_pain_subset_mae_at_4"]) == ("0.5", "1.0", "1.5")
    assert (forest["high_pain_precision_at_5"], forest["high_pain_f1_at_5"]) == ("0.0", "0.0")
    assert forest["source_data_path"].endswith("data/processed/data_vectorized.csv") and forest["source_data_path_inferred"] == "true"
    summary = registry.registry_summary(rows).collect()
    assert [(r["task"], r["data_version"], r["f1"]) for r in summary] == [("classification", "new", None), ("classification", "raw", None), ("regression", "raw", None)]
    assert summary[0]["model"] == "logistic_regression"


def test_undefined_without_predictions_above(spark, tmp_path):
    run = tmp_path / "models" / "dummy" / "outputs" / "raw_mean"
    run.mkdir(parents=True)
    (run / "test_predictions.csv").write_text("y_true,y_pred\n4,1\n1,1\n", encoding="utf-8")
    row = registry.tail_from_predictions(spark, str(tmp_path)).first()
    assert (row["fb_recall_4"], row["fb_precision_4"], row["fb_f1_4"], row["fb_recall_5"]) == ("0.0", "undefined", "undefined", "undefined")


def test_layouts_of_output_paths(spark, tmp_path):
    expect = {
        "models/random_forest/outputs/raw/a/metrics.json": ("randomforest", "random_forest_raw", "data/processed/data_vectorized.csv"),
        "models/logistic/outputs/overview.csv": ("logistic_regression", "logistic_raw", None),
        "models/mlp/outputs/new/metrics.json": ("mlp", "mlp_new", None),
        "xgboost/outputs/x/metrics.json": ("xgboost", "outputs", "data/processed/data_vectorized.csv"),
        "data_argmentation_A/out/metrics.json": ("randomforest", "g1", "data_argmentation_A/datasets/g1/augmented_dataset.csv"),
        "randomforest/outputs_comparison/metrics.json": ("randomforest", "outputs_comparison", registry.COPY_INPUT),
        "baseline/run7/metrics.json": ("logistic_regression", "run7", None),
        "other/xgboost/metrics.json": ("xgboost", "other", None),
    }
    rows = spark.createDataFrame([(p,) for p in expect], "rel string")

    def facts():
        f = registry.path_facts(spark, F.col("rel"), str(tmp_path), F.lit("g1"))
        found = rows.select("rel", f["model_family"], f["run_name"], f["source_guess"]).collect()
        return {r[0]: (r[1], r[2], r[3] and r[3].removeprefix(f"{tmp_path}/")) for r in found}

    assert facts() == expect
    made = tmp_path / registry.AUGMENTED_INPUT
    made.parent.mkdir(parents=True)
    made.write_text("a\n1\n")
    assert facts()["xgboost/outputs/x/metrics.json"][2] == registry.AUGMENTED_INPUT


def test_registered_models_run_at_full_size(spark, monkeypatch):
    """Grids, folds, layers and targets of the registered model queries, read off without fitting."""
    from riskframe.catalog import modelling
    from riskframe.operators import models
    from riskframe.plans import runs

    class Stop(Exception):
        pass

    sf, seen = "/root/testdata/sf0.001", []

    def search(make, settings, train, y, folds=4, **_):
        seen.append((len(settings), folds))
        return {"results": spark.range(1)}

    monkeypatch.setattr(models, "search_and_fit", search)
    for query in (modelling.forest_run, modelling.boosted_importance):
        with pytest.raises(KeyError):
            query(spark, sf)
    assert seen == [(16, 4), (16, 4)]

    def network(**params):
        seen.append((params["layers"], params["maxIter"]))
        raise Stop

    monkeypatch.setattr(models, "MultilayerPerceptronClassifier", network)
    with pytest.raises(Stop):
        modelling.mlp_fit(spark, sf)
    assert seen[-1] == ([64, 96, 48, 2], 100)

    fits = []

    def prepare(df, targets, *_, **__):
        return [{"target": t["target"], "metric": t["metric"]} for t in targets.collect()]

    def fit(parts, targets, *_, oversample=2.5, loss_weight=2.0, **__):
        fits.append(({p["target"] for p in parts}, oversample, loss_weight))
        rows = [(p["target"], p["target"], *[0.5] * len(models.MEAN_METRICS)) for p in parts]
        return spark.createDataFrame(rows, "target string, target_en string, " + ", ".join(f"{m} double" for m in models.MEAN_METRICS))

    monkeypatch.setattr(runs, "prepare_logistic", prepare)
    monkeypatch.setattr(runs, "fit_prepared", fit)
    assert modelling.logistic_overview(spark, sf).count() == 20


def test_logistic_without_earlier_columns(spark):
    """Targets of the first day have no features; their model is the intercept, and later ones are fitted beside them."""
    from riskframe.plans import runs
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(v[0]), float(v[1]), 0.0) for i, v in enumerate(r.integers(0, 2, (200, 2)))], "row_id long, w0_a double, w1_a double, w1_b double")
    targets = spark.createDataFrame([(f"{d}_a", d, "a", f"{d}_a", "main", 1.0) for d in ("w0", "w1")] + [("w1_b", "w1", "b", "w1_b", "main", 9.0)],
                                    "target string, day string, metric string, target_en string, target_tier string, positive_min double")
    out = {r["target"]: r for r in runs.train_logistic(df, targets, ["w0_a", "w1_a", "w1_b"], ["w0", "w1"], strategy="fixed", pain_metrics=["a"], high_above=0.5).collect()}
    assert set(out) == {"w0_a", "w1_a", "w1_b"} and out["w1_b"]["auc"] is None and out["w0_a"]["auc"] == 0.5


def test_run_registry_keeps_every_flag(spark, tmp_path):
    """More than 100 runs, one without a name and one whose name has signs that paths escape."""
    from riskframe.catalog import modelling
    flags = [f"f{i}" for i in range(130)] + ["a b=c", None]
    lines = [(i, 1, f, "O", float(q), 15000.0 * i) for i, f in enumerate(flags) for q in (7, 49)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 100), (2, 900)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [r for r in modelling.run_registry(spark, str(tmp_path)).collect() if r["task"] == "regression"]
    assert {r["data_version"] for r in rows} == {f and f"flag_{f}" for f in flags} and len(rows) == len(flags)
    mae = lambda i: round((abs(i - 1) + abs(i - 7)) / 2, 4)
    assert {r["data_version"]: r["mae"] for r in rows}["flag_f40"] == mae(40)


def test_many_labels_and_levels(spark):
    from riskframe.operators import labels, profile
    rows = [(i, f"x{i}") for i in range(5_100)]
    df = spark.createDataFrame(rows, "row_id long, m string")
    assert len(labels.frequent_labels(df, "m", 1)) == 5_100
    assert labels.one_hot_long(df, "m", min_count=1).count() == 5_100
    levels = spark.createDataFrame([("d", float(i), 1) for i in range(10_050)], "drug string, level double, count long")
    assert len(profile.pivot_counts(levels, ["drug"], "level", "count").columns) == 10_051


def test_row_ids_over_files_of_unequal_size(spark, tmp_path):
    """Files count by path, whatever their size, and stretches of a file by their place."""
    sizes, lines = [3000, 1, 0, 40_000, 7], []
    for i, n in enumerate(sizes):
        own = [f"{i}-{j}" for j in range(n)]
        lines += own
        (tmp_path / f"part-{i}.csv").write_text("v\n" + "".join(f"{v}\n" for v in own), encoding="utf-8")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 10)
        df = tables.with_row_id(tables.read_table(spark, str(tmp_path)))
        assert df.rdd.getNumPartitions() > 5
        got = {r["row_id"]: r["v"] for r in df.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(lines))


def test_row_ids_of_an_empty_table(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a.b,c\n", encoding="utf-8")
    out = tables.with_row_id(tables.read_table(spark, str(tmp_path / "e.csv")))
    assert out.columns == ["a.b", "c", "row_id"] and out.count() == 0


def test_missing_words_become_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\nNA,none\nnan,0\nN/A,\n<NA>,None\n", encoding="utf-8")
    path = str(tmp_path / "m.csv")
    assert [tuple(r) for r in tables.read_table(spark, path).collect()] == [(None, "none"), (None, "0"), (None, None), (None, None)]
    assert tables.read_table(spark, path, missing=()).first()["a"] == "NA"


def test_saved_run_scores_raw_rows(spark, tmp_path):
    """Bundle with medians, leaf table and calibrator: reloaded, it repeats the run's predictions."""
    from riskframe.operators import models
    from riskframe.plans.runs import predict_saved, train_forest
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = np.round(np.clip(4 + 2 * x[:, 0], 0, 10))
    rows = [(i, None if i % 9 == 0 else float(x[i, 0]), str(round(x[i, 1], 3)), float(y[i]), "kept") for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, `b.c` string, y double, prediction string").withColumnRenamed("b.c", "b")
    path = str(tmp_path / "bundle")
    for quantiles, metric in (("0.5,0.7", "combined"), ("", "mae")):
        run = train_forest(df, "y", ["a", "b"], settings=[{"numTrees": 15, "maxDepth": 5}], quantiles=quantiles, calibrate=True, metric=metric,
                           folds=2, work_dir=str(tmp_path / "work"), bundle_dir=path)
        again = predict_saved(df, path, "again")
        assert again.columns == [*df.columns, "again"] and again.where("a IS NULL").count() == 45
        assert again.select(*df.columns).exceptAll(df).isEmpty()
        both = run["predictions"].join(again, "row_id").select("y_pred", "again").toPandas()
        assert len(both) == 40
        np.testing.assert_allclose(both["again"], both["y_pred"], rtol=1e-9)
        assert predict_saved(df, path, "again", fill="table").count() == 400
    bundle = models.load_model(path, spark)
    assert bundle["target"] == "y" and set(bundle["fills"]) == {"a", "b"}
    with pytest.raises(ValueError):
        models.score_bundle(bundle, df, "prediction")
    with pytest.raises(ValueError):
        models.score_bundle(bundle, df.drop("a"))
    with pytest.raises(ValueError):
        models.score_bundle({**bundle, "policy": {"policy": "q50", "calibrator": None}, "leaves": None}, df)


def test_saved_quantile_policy(spark, tmp_path):
    """A quantile policy is answered from the stored leaf table, also by the shuffled join."""
    from riskframe.operators import models, policy
    rows = [(float(i % 17), float(i % 5), float(i % 17) * 2 + i % 3) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "a double, b double, y double")
    train = models.impute_and_assemble(df, [], ["a", "b"])[0]
    model = models.forest("y", numTrees=9, maxDepth=4).fit(train)
    models.save_model(model, str(tmp_path), {"policy": "q75"}, ["a", "b"], spark, {"a": 1.0, "b": 0.0})
    bundle = models.load_model(str(tmp_path), spark)
    got = models.score_bundle(bundle, df).toPandas()
    trees = np.column_stack([[t.predict(v) for v in train.toPandas()["features"]] for t in model.trees])
    want = {(a, b): q for (a, b, _), q in zip(rows, np.quantile(trees, 0.75, axis=1))}
    assert len(got) == 600
    np.testing.assert_allclose(got["y_pred"], [want[k] for k in zip(got["a"], got["b"])])
    kept, policy.LEAF_BROADCAST = policy.LEAF_BROADCAST, 0
    try:
        shuffled = models.score_bundle(bundle, df).toPandas()
    finally:
        policy.LEAF_BROADCAST = kept
    np.testing.assert_allclose(shuffled["y_pred"], [want[k] for k in zip(shuffled["a"], shuffled["b"])])


def _signal(spark, n: int = 240):
    rows = spark.range(n).withColumnRenamed("id", "row_id").withColumns({"a": (F.col("row_id") * 37 % 101).cast("double"), "b": (F.col("row_id") * 53 % 7).cast("double")})
    return models.assemble(rows.withColumn("y", F.col("a") * 2 + F.col("b")), ["a", "b"])


def test_search_scores_are_those_of_single_fits(spark):
    train = _signal(spark)
    settings = [{"numTrees": 5, "maxDepth": 2}, {"numTrees": 8, "maxDepth": 4}]
    make = lambda **p: models.forest("y", 7, **p)
    got = {r["setting"]: r for r in models.cross_validate(make, settings, train, "y", folds=3, seed=7).collect()}
    part = models.stored_folds(train, 3, 7, "row_id")
    for i, setting in enumerate(settings):
        tests = []
        for fold in range(3):
            model = make(**setting).fit(part.where(F.col("fold") != fold))
            tests.append(-models.mean_abs_errors(model.transform(part.where(F.col("fold") == fold)), "y"))
        assert got[i]["mean_test_score"] == pytest.approx(sum(tests) / 3)
    assert got[1]["rank_test_score"] == 1


def test_forest_wraps_its_trees_when_asked(spark):
    model = models.forest("y", 7, numTrees=5, maxDepth=2).fit(_signal(spark))
    assert "trees" not in {p.name for p in model.params}
    assert len(model.trees) == model.getNumTrees == 5 and model.copy().getNumTrees == 5


def test_boosting_stops_when_marked_rows_gain_no_more(spark):
    noise = _signal(spark).withColumn("y", F.pmod(F.xxhash64("row_id"), F.lit(1000)).cast("double")).persist()
    found = models.fit_boosted(noise, "y", {"maxIter": [40], "maxDepth": [3], "stepSize": [0.5]}, draws=1, folds=2)
    assert found["params"]["maxIter"] == 40 and 1 <= found["model"].getNumTrees < 40
    marked = models.with_stop_rows(noise).where(F.col(models.STOP_ROWS)).count()
    assert 0 < marked < 60
    unmarked = noise.withColumn(models.STOP_ROWS, F.lit(False))
    assert models.EarlyStopping(models.boosted("y", maxIter=4, maxDepth=2)).fit(unmarked).getNumTrees == 4


def test_fits_side_by_side_keep_their_own_local_properties(spark):
    """Spark notes the running query among them: shared ones made fits fail with "Cannot parse null string"."""
    import time
    seen = []

    class Slow:
        def fit(self, rows):
            time.sleep(1)
            seen.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
            return models.forest("y", 7, numTrees=2, maxDepth=1).fit(rows)

    models.cross_validate(lambda **_: Slow(), [{"maxDepth": 1}, {"maxDepth": 2}], _signal(spark), "y", folds=2)
    assert sorted(seen) == [f"fit-{i}-{f}" for i in range(2) for f in range(2)]


def test_raw_rows_are_read_for_pruning_and_once_more(spark):
    """The aggregates that decide the columns read the parsed rows."""
    from riskframe.plans.outcomes import raw_surgeries
    from riskframe.plans.vectorize import vectorize_table
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(v):
        seen.add(1)
        return v

    raw = raw_surgeries(spark, "/root/testdata/sf0.001").limit(300).localCheckpoint()
    assert len(vectorize_table(raw.withColumn("麻醉方法", noted("麻醉方法"))).select("麻醉方法_oh_腰麻").collect()) == 300
    assert seen.value <= 2 * 300
