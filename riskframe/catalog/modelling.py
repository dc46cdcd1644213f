"""Metric, policy, model and registry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.catalog.common import MATRIX, MATRIX_CTE, WEEKS, outcome_matrix, query, rounded, table
from riskframe.catalog.sampling import SEED, order_by
from riskframe.operators import evaluate, linear, models, policy, schema
from riskframe.plans.outcomes import matrix_targets
from riskframe.session import shared_folder


def scored_documents(spark, sf):
    """Two labels per document and a score read off its length; unlabelled ones stay."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    p = F.col("n_chars") / (F.col("n_chars") + 1500.0)
    rows = F.explode(F.array(
        F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y"), p.alias("p")),
        F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y"), (1 - p).alias("p"))))
    return d.select(F.col("doc_id").alias("row_id"), "n_chars", rows.alias("r")).select("row_id", "n_chars", "r.*")


_DOCS = """allrows AS (SELECT d.doc_id AS row_id, d.n_chars, 'quality' AS target, l.quality AS y, n_chars / (n_chars + 1500.0::DOUBLE) AS p
  FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL
  SELECT d.doc_id, d.n_chars, 'toxic', l.toxic, 1 - n_chars / (n_chars + 1500.0::DOUBLE) FROM documents d LEFT JOIN labels l USING (doc_id)),
e AS (SELECT * FROM allrows WHERE y IS NOT NULL)"""


def rates_sql(tp="tp", fp="fp", fn="fn", tn="tn", prefix="") -> str:
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp})::DOUBLE ELSE 0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn})::DOUBLE ELSE 0 END)"
    s = f"(CASE WHEN {tn} + {fp} > 0 THEN {tn} / ({tn} + {fp})::DOUBLE ELSE 0 END)"
    f = f"(CASE WHEN {fp} + {tn} > 0 THEN {fp} / ({fp} + {tn})::DOUBLE ELSE 0 END)"
    return (f"({tp} + {tn}) / ({tp} + {tn} + {fp} + {fn})::DOUBLE AS {prefix}accuracy, 0.5 * ({r} + {s}) AS {prefix}balanced_accuracy, "
            f"{p} AS {prefix}precision, {r} AS {prefix}recall, {s} AS {prefix}specificity, {f} AS {prefix}fpr, "
            f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END AS {prefix}f1")


_RATES = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "fpr", "f1"]
_ROUND_RATES = ", ".join(f"round({r}, 6) AS {r}" for r in _RATES)


def counts_sql(threshold: str, source: str = "e") -> str:
    return f"""SELECT target, count(*) FILTER (WHERE y = 1 AND p >= {threshold}) AS tp, count(*) FILTER (WHERE y = 0 AND p >= {threshold}) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < {threshold}) AS fn, count(*) FILTER (WHERE y = 0 AND p < {threshold}) AS tn, avg(y) AS positive_rate
  FROM {source} GROUP BY target"""


@query(f"WITH {_DOCS}, c AS ({counts_sql('0.5')}), r AS (SELECT *, {rates_sql()} FROM c) SELECT target, tp, fp, fn, tn, "
       f"round(positive_rate, 6) AS positive_rate, {_ROUND_RATES} FROM r")
def confusion_at(spark, sf):
    return rounded(evaluate.confusion(scored_documents(spark, sf), 0.5))


_AUC = """a AS (SELECT target, count(*) AS n, sum(y)::BIGINT AS pos, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc
  FROM (SELECT target, y, rank() OVER (PARTITION BY target ORDER BY p) + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0 AS r FROM e) GROUP BY target)"""
_AP = """ap AS (SELECT target, count(*) AS n, sum(hit / rn::DOUBLE) FILTER (WHERE y = 1) / sum(y) AS ap FROM
  (SELECT target, y, row_number() OVER w AS rn, sum(y) OVER w AS hit FROM e WINDOW w AS (PARTITION BY target ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING)) GROUP BY target)"""
_LOSS = "-(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))"


@query(f"WITH {_DOCS}, {_AUC} SELECT target, n, pos, round(auc, 6) AS auc FROM a")
def auc(spark, sf):
    return rounded(evaluate.auc(scored_documents(spark, sf)))


@query(f"WITH {_DOCS}, {_AP} SELECT target, n, round(ap, 6) AS average_precision FROM ap")
def average_precision(spark, sf):
    return rounded(evaluate.average_precision(scored_documents(spark, sf)))


@query("""WITH e AS (SELECT l_returnflag AS target, l_orderkey * 10 + l_linenumber AS row_id, (l_linestatus = 'O')::INT AS y,
  l_quantity / 50.0 AS p FROM (SELECT DISTINCT ON (l_orderkey * 10 + l_linenumber) * FROM lineitem
    ORDER BY l_orderkey * 10 + l_linenumber, l_returnflag, l_linestatus, l_quantity)),
""" + _AUC + ", " + _AP + " SELECT target, n, round(auc, 6) AS auc, round(ap, 6) AS average_precision FROM a JOIN ap USING (target, n)")
def ranking_of_tied_scores(spark, sf):
    """Fifty distinct scores over all lines: every score is a large tie."""
    li = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    r = F.struct("l_returnflag", "l_linestatus", "l_quantity")
    one = li.groupBy("row_id").agg(F.min(r).alias("r"))
    rows = one.select(F.col("r.l_returnflag").alias("target"), "row_id", (F.col("r.l_linestatus") == "O").cast("int").alias("y"),
                      (F.col("r.l_quantity") / 50.0).alias("p"))
    both = evaluate.auc(rows).drop("pos").join(evaluate.average_precision(rows), ["target", "n"])
    return rounded(both)


@query(f"""WITH {_DOCS} SELECT target, round(avg({_LOSS}), 6) AS log_loss, round(sum({_LOSS} * n_chars) / sum(n_chars), 6) AS weighted_log_loss,
  round(avg((p - y) * (p - y)), 6) AS brier FROM e GROUP BY target""")
def log_losses(spark, sf):
    return rounded(evaluate.losses(scored_documents(spark, sf), weight="n_chars"))


_FOCAL = "CASE y WHEN 1 THEN -0.25 * pow(1 - p, 2) * ln(least(greatest(p, 1e-12), 1 - 1e-12)) WHEN 0 THEN -0.75 * pow(p, 2) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) ELSE 0 END"


@query(f"""WITH {_DOCS} SELECT target, round(sum({_FOCAL}), 4) AS focal_sum, count(y) AS n_labelled,
  round(sum({_FOCAL}) / count(y), 4) AS focal_mean FROM allrows GROUP BY target""")
def focal_loss(spark, sf):
    return rounded(evaluate.focal_losses(scored_documents(spark, sf), 0.25, 2.0), 4)


_TUNE = f"""{_DOCS}, g AS (SELECT i, 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) AS t FROM range(0, 181) x(i)),
gc AS (SELECT target, i, t, count(*) FILTER (WHERE y = 1 AND p >= t) AS tp, count(*) FILTER (WHERE y = 0 AND p >= t) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < t) AS fn, count(*) FILTER (WHERE y = 0 AND p < t) AS tn FROM e, g GROUP BY 1, 2, 3),
gr AS (SELECT *, {rates_sql()} FROM gc), b AS (SELECT target, {rates_sql(prefix='b_')} FROM ({counts_sql('0.5')})),
f AS (SELECT gr.*, (fpr <= b_fpr * (1.0::DOUBLE - 0.35::DOUBLE) AND accuracy >= b_accuracy - 0.02::DOUBLE AND recall >= b_recall * 0.75::DOUBLE) AS feasible FROM gr JOIN b USING (target)),
s AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY feasible DESC,
  CASE WHEN feasible THEN f1 ELSE f1 + 0.20::DOUBLE * precision + 0.10::DOUBLE * recall - 0.25::DOUBLE * fpr END DESC, CASE WHEN feasible THEN precision ELSE 0 END DESC,
  CASE WHEN feasible THEN recall ELSE 0 END DESC, CASE WHEN feasible THEN accuracy ELSE 0 END DESC, CASE WHEN feasible THEN -fpr ELSE 0 END DESC, i) AS rn FROM f),
best AS (SELECT * FROM s WHERE rn = 1)"""


@query(f"""WITH {_TUNE} SELECT target, CASE WHEN feasible THEN 'constrained_search' ELSE 'fallback_objective' END AS mode, round(t, 6) AS threshold,
  round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, tp, fp, fn, tn FROM best""")
def threshold_tune(spark, sf):
    return rounded(evaluate.tune_threshold(scored_documents(spark, sf)))


@query(f"""WITH {_DOCS}, c AS ({counts_sql("CASE target WHEN 'quality' THEN 0.55 ELSE 0.4 END")}) SELECT target, tp, fp, fn, tn,
  round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS p_true_low_pred_low, round(coalesce(fp / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS p_true_low_pred_high,
  round(coalesce(fn / nullif(fn + tp, 0)::DOUBLE, 0), 6) AS p_true_high_pred_low, round(coalesce(tp / nullif(fn + tp, 0)::DOUBLE, 0), 6) AS p_true_high_pred_high FROM c""")
def confusion_share_by_day(spark, sf):
    """Fixed thresholds by day, then the row-normalised table."""
    targets = spark.createDataFrame([("quality", "d0"), ("toxic", "d9")], "target string, day string")
    days = spark.createDataFrame([("d0", 0.55), ("d1", 0.5)], "day string, threshold double")
    t = evaluate.day_threshold(targets, days, 0.4)
    rows = scored_documents(spark, sf).join(F.broadcast(t), "target")
    out = evaluate.confusion_row_share(evaluate.confusion(rows, F.col("threshold")))
    return rounded(out.select("target", "tp", "fp", "fn", "tn", *[c for c in out.columns if c.startswith("p_true")]))


@query(f"""WITH {_TUNE}, {_AUC}, {_AP}, c AS ({counts_sql('t', '(SELECT e.*, t FROM e JOIN best USING (target))')}), r AS (SELECT *, {rates_sql()} FROM c),
l AS (SELECT target, avg({_LOSS}) AS log_loss, avg((p - y) * (p - y)) AS brier FROM e GROUP BY target)
SELECT r.target, r.tp, r.fp, r.fn, r.tn, {', '.join(f'round(r.{x}, 6) AS {x}' for x in _RATES)}, round(auc, 6) AS auc, round(ap, 6) AS auprc,
  round(ap / positive_rate, 6) AS auprc_lift, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(t, 6) AS chosen_threshold
FROM r JOIN a USING (target) JOIN ap USING (target) JOIN l USING (target) JOIN best USING (target)""")
def overview(spark, sf):
    rows = scored_documents(spark, sf)
    out = evaluate.overview(rows, evaluate.tune_threshold(rows))
    return rounded(out.select("target", "tp", "fp", "fn", "tn", *_RATES, "auc", "auprc", "auprc_lift", "log_loss", "brier", "chosen_threshold"))


@query("""WITH e AS (SELECT target, row_id, y, p FROM (SELECT doc_id AS row_id, quality AS y, 'quality' AS target, n_chars / (n_chars + 1500.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, toxic, 'toxic', 0.25::DOUBLE FROM documents JOIN labels USING (doc_id)) WHERE y IS NOT NULL), """ + _AUC + " SELECT target, n, pos, round(auc, 6) AS auc FROM a")
def multi_target_eval(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    probs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("quality"), F.lit(0.25).alias("toxic"))
    return rounded(evaluate.auc(evaluate.multi_target_rows(labels, probs, ["quality", "toxic"])))


# --- regression ---------------------------------------------------------------------


def scored_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_returnflag", F.floor(F.col("l_quantity") / 7).cast("double").alias("y_true"),
                     F.round(F.col("l_extendedprice") / 15000.0, 2).alias("y_pred"), F.round(F.col("l_extendedprice") / 13000.0, 2).alias("q60"))


_LINES = "t AS (SELECT l_returnflag, floor(l_quantity / 7)::DOUBLE AS y, round(l_extendedprice / 15000.0, 2) AS p, round(l_extendedprice / 13000.0, 2) AS q60 FROM lineitem)"


@query(f"""WITH {_LINES} SELECT l_returnflag, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r2 FROM t GROUP BY 1""")
def regression_metrics(spark, sf):
    return rounded(evaluate.regression_metrics(scored_lines(spark, sf), ["l_returnflag"]))


def _tail_sql() -> str:
    parts = []
    for k in (4, 5):
        parts.append(f"""count(*) FILTER (WHERE y >= {k}) AS threshold_{k}_actual_positive_count, count(*) FILTER (WHERE p >= {k}) AS threshold_{k}_predicted_positive_count,
  count(*) FILTER (WHERE y >= {k} AND p >= {k}) AS threshold_{k}_tp, count(*) FILTER (WHERE y < {k} AND p >= {k}) AS threshold_{k}_fp, count(*) FILTER (WHERE y >= {k} AND p < {k}) AS threshold_{k}_fn,
  round(avg(abs(p - y)) FILTER (WHERE y >= {k}), 6) AS threshold_{k}_subset_mae, round(avg(p - y) FILTER (WHERE y >= {k}), 6) AS threshold_{k}_subset_bias""")
    ratios = ", ".join(f"""round(threshold_{k}_tp / nullif(threshold_{k}_tp + threshold_{k}_fn, 0)::DOUBLE, 6) AS threshold_{k}_recall,
  round(threshold_{k}_tp / nullif(threshold_{k}_tp + threshold_{k}_fp, 0)::DOUBLE, 6) AS threshold_{k}_precision,
  CASE WHEN threshold_{k}_tp > 0 THEN round(2.0 * threshold_{k}_tp / (2 * threshold_{k}_tp + threshold_{k}_fn + threshold_{k}_fp), 6) END AS threshold_{k}_f1""" for k in (4, 5))
    return f"""WITH {_LINES}, m AS (SELECT l_returnflag, round(avg(abs(p - y)) FILTER (WHERE y = 0), 6) AS mae_true_0,
  round(avg(abs(p - y)) FILTER (WHERE y >= 1 AND y < 4), 6) AS mae_true_1_3, round(avg(abs(p - y)) FILTER (WHERE y >= 4), 6) AS mae_true_ge_4,
  round(avg(p - y) FILTER (WHERE y >= 4), 6) AS bias_true_ge_4, {', '.join(parts)} FROM t GROUP BY 1) SELECT *, {ratios} FROM m"""


@query(_tail_sql())
def tail_metrics(spark, sf):
    return rounded(evaluate.tail_metrics(scored_lines(spark, sf), ["l_returnflag"]))


@query(f"""WITH {_LINES}, w AS (SELECT l_returnflag, y, p, CASE WHEN y >= 7 THEN 4.0 WHEN y >= 4 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM t),
s AS (SELECT quantile_cont(abs(y - p), 0.75) AS scale FROM t WHERE abs(y - p) > 0),
f AS (SELECT *, least(greatest(1 + pow(least(abs(y - p) / scale, 5), 2), 1), 10) AS focus FROM w, s)
SELECT l_returnflag, weight, count(*) AS n, round(avg(focus), 4) AS focus, round(avg(least(greatest(weight * focus, 1), 10)), 4) AS final FROM f GROUP BY 1, 2""")
def residual_focus(spark, sf):
    rows = policy.tail_weights(scored_lines(spark, sf), "y_true")
    focused = policy.residual_focus(rows, "y_true", "y_pred", weight="weight")
    return rounded(focused.groupBy("l_returnflag", "weight").agg(
        F.count(F.lit(1)).alias("n"), F.avg("focus_weight").alias("focus"), F.avg("final_weight").alias("final")), 4)


_POLICIES = """, l AS (SELECT y, 'mean' AS policy, 1 AS position, p AS pred FROM t UNION ALL SELECT y, 'q60', 2, q60 FROM t),
m AS (SELECT policy, position, avg(abs(pred - y)) AS mae, avg(abs(pred - y)) FILTER (WHERE y >= 4) AS high_mae, avg(pred - y) FILTER (WHERE y >= 4) AS bias FROM l GROUP BY 1, 2),
s AS (SELECT *, coalesce(mae + 0.25 * high_mae + 0.25 * greatest(0, -bias), mae) AS score FROM m)"""


@query(f"""WITH {_LINES}{_POLICIES} SELECT policy, round(mae, 6) AS mae, round(high_mae, 6) AS high_pain_mae, round(bias, 6) AS high_pain_bias,
  round(score, 6) AS selection_score, position::INT AS position FROM s""")
def policy_scores(spark, sf):
    lines = scored_lines(spark, sf).withColumnRenamed("y_pred", "mean")
    return rounded(policy.policy_scores(lines, "y_true", ["mean", "q60"]))


@query(f"""WITH {_LINES}{_POLICIES} SELECT policy, round(mae, 6) AS mae, round(high_mae, 6) AS high_pain_mae, round(bias, 6) AS high_pain_bias,
  round(score, 6) AS selection_score FROM s ORDER BY s.score, position LIMIT 1""")
def policy_select(spark, sf):
    lines = scored_lines(spark, sf).withColumnRenamed("y_pred", "mean")
    return rounded(policy.best_policy(policy.policy_scores(lines, "y_true", ["mean", "q60"])))


@query("""SELECT 'mean' AS kind, round(avg(l_quantity), 6) AS value, round(avg(abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem))), 6) AS mae FROM lineitem
UNION ALL SELECT 'median', quantile_cont(l_quantity, 0.5), round(avg(abs(l_quantity - (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem))), 6) FROM lineitem""")
def constant_baseline(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y_true"))
    out = []
    for kind in ("mean", "median"):
        value = models.fit_constant(li, "y_true", kind)
        pred = models.predict_constant(li, value)
        out.append(evaluate.regression_metrics(pred).select(F.lit(kind).alias("kind"), F.lit(float(value)).alias("value"), "mae"))
    return rounded(out[0].unionByName(out[1]))


@query("""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my FROM lineitem)
SELECT 'l_quantity' AS feature, round(sum((l_quantity - mx) / sx * (l_extendedprice - my)) / (max(n) + 30.0), 3) AS coefficient FROM lineitem, s""")
def ridge_one_feature(spark, sf):
    """Ridge on one standardised feature with alpha 30."""
    li = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("y"))
    train = models.standardize_and_assemble(li, [], ["l_quantity"])[0]
    n, y_std = train.agg(F.count("y"), F.stddev_pop("y")).first()
    model = models.ridge(30.0, n, y_std, "y").fit(train)
    return rounded(models.coefficients(model, ["l_quantity"], spark), 3)


_TARGET = "w1_click"


def _features(spark, sf):
    m = outcome_matrix(spark, sf)
    kept, _ = schema.temporal_filter([c for c in m.columns if c != "row_id"], _TARGET, WEEKS)
    train = models.numeric_target(m, _TARGET)
    return kept, models.impute_and_assemble(train, [], kept)[0].select("row_id", _TARGET, "features").persist()


@query()
def linear_search(spark, sf):
    """Ridge and elastic-net searches over their whole grids, filled and scaled per fold."""
    rows = models.numeric_target(outcome_matrix(spark, sf), _TARGET).persist()
    kept, _ = schema.temporal_filter([c for c in rows.columns if c != "row_id"], _TARGET, WEEKS)
    ridge = linear.search_ridge(rows, kept, _TARGET)["results"]
    net = linear.search_elastic_net(rows, kept, _TARGET)["results"]
    return rounded(ridge.withColumn("model", F.lit("ridge")).unionByName(net.withColumn("model", F.lit("elastic_net"))))


_alphas = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(models.RIDGE_ALPHAS))


@query(f"""WITH r AS (SELECT ntile(4) OVER (ORDER BY {order_by('o_orderkey')}) - 1 AS fold, o_totalprice::DOUBLE AS y,
    CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 100 END::DOUBLE AS x FROM orders),
t AS (SELECT f.fold AS out, median(x) AS fill FROM r JOIN (SELECT DISTINCT fold FROM r) f ON r.fold <> f.fold GROUP BY f.fold),
z AS (SELECT t.out, r.fold, y, coalesce(x, fill) AS x FROM r, t),
s AS (SELECT out, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM z WHERE fold <> out GROUP BY out),
c AS (SELECT z.out, sum((x - mx) / sx * (y - my)) AS xy, count(*) AS n FROM z JOIN s USING (out) WHERE fold <> out GROUP BY z.out),
a(setting, alpha) AS (VALUES {_alphas}),
e AS (SELECT setting, alpha, out, avg(abs(y - my - (x - mx) / sx * xy / (n + alpha))) FILTER (fold = out) AS test,
        avg(abs(y - my - (x - mx) / sx * xy / (n + alpha))) FILTER (fold <> out) AS train FROM z JOIN s USING (out) JOIN c USING (out), a GROUP BY ALL),
m AS (SELECT setting, alpha, -avg(test) AS mean_test_score, stddev_pop(test) AS std_test_score, -avg(train) AS mean_train_score,
        stddev_pop(train) AS std_train_score FROM e GROUP BY setting, alpha)
SELECT setting::INT AS setting, round(mean_test_score, 3) AS mean_test_score, round(std_test_score, 3) AS std_test_score,
  round(mean_train_score, 3) AS mean_train_score, round(std_train_score, 3) AS std_train_score FROM m""")
def ridge_search_one_feature(spark, sf):
    """The ridge search on one column with gaps: fold medians, fold scaling, all alphas."""
    key = F.col("o_orderkey")
    x = F.when(key % 7 > 0, F.col("o_custkey") % 100).cast("double")
    rows = table(spark, sf, "orders").select(key.alias("row_id"), x.alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    return rounded(linear.search_ridge(rows, ["x"], "y", seed=SEED)["results"].drop("params", "rank_test_score"), 3)


@query(f"""WITH {MATRIX_CTE} SELECT row_id, {_TARGET}, true AS mean_is_prediction, true AS quantiles_ordered, true AS within_targets
FROM matrix WHERE {_TARGET} IS NOT NULL""")
def forest_quantiles(spark, sf):
    """Forest with mean and tree quantiles per row, and the laws they obey."""
    _, train = _features(spark, sf)
    model = models.forest(_TARGET, SEED, numTrees=100, maxDepth=10).fit(train)
    out = policy.tree_quantiles(model, train, [0.2, 0.5, 0.8], f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}")
    ends = train.agg(F.min(_TARGET).alias("lo"), F.max(_TARGET).alias("hi")).first()
    return out.select("row_id", _TARGET, (F.abs(F.col("mean") - F.col("prediction")) <= 1e-9 * F.abs("mean")).alias("mean_is_prediction"),
                      ((F.col("q20") <= F.col("q50")) & (F.col("q50") <= F.col("q80"))).alias("quantiles_ordered"),
                      ((F.col("q20") >= ends["lo"] - 1e-9) & (F.col("q80") <= ends["hi"] + 1e-9)).alias("within_targets"))


@query(f"""WITH {MATRIX_CTE} SELECT row_id, true AS scored, true AS same_as_run FROM matrix""")
def saved_forest(spark, sf):
    """A tail-aware run saved, loaded again and applied to all raw rows; test rows get the run's own predictions."""
    from riskframe.plans.runs import predict_saved, train_forest
    kept, _ = schema.temporal_filter(MATRIX, _TARGET, WEEKS)
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    matrix = outcome_matrix(spark, sf).persist()
    run = train_forest(matrix, _TARGET, kept, SEED, settings=[{"numTrees": 100, "maxDepth": 10}], weight_mode="tail", quantiles="0.50,0.70",
                       calibrate=True, high=60.0, severe=90.0, work_dir=f"{path}/work", bundle_dir=path)
    again = predict_saved(matrix, path, "again").select("row_id", "again")
    same = F.coalesce(F.abs(F.col("again") - F.col("y_pred")) <= 1e-9 * F.abs("y_pred"), F.col("y_pred").isNull())
    return again.join(run["predictions"].select("row_id", "y_pred"), "row_id", "left").select(
        "row_id", F.col("again").isNotNull().alias("scored"), same.alias("same_as_run"))


@query()
def isotonic_calibration(spark, sf):
    """Monotone map from price to quantity, learned on all lines."""
    lines = scored_lines(spark, sf)
    model = policy.fit_isotonic(lines, "y_true", "y_pred")
    out = policy.apply_isotonic(model, lines, "y_pred", "calibrated")
    return rounded(out.groupBy("l_returnflag").agg(F.avg(F.abs(F.col("y_true") - F.col("calibrated"))).alias("mae"), F.count(F.lit(1)).alias("n")))


@query(f"""WITH {MATRIX_CTE} SELECT '{_TARGET}' AS target_column, count({_TARGET})::BIGINT AS n_samples, 16::BIGINT AS n_settings,
  16::BIGINT AS n_distinct_settings, true AS parts_add_up, true AS best_is_first, true AS lawful_errors, true AS within_targets FROM matrix""")
def forest_run(spark, sf):
    """Tail-aware forest run (16 settings, 4 folds, residual refit, quantile policy, calibration): its size and the laws its outputs obey."""
    from riskframe.plans.runs import train_forest
    kept, _ = schema.temporal_filter(MATRIX, _TARGET, WEEKS)
    matrix = outcome_matrix(spark, sf).persist()
    run = train_forest(matrix, _TARGET, kept, SEED, weight_mode="focal_residual", quantiles="0.50,0.70", calibrate=True, high=60.0, severe=90.0,
                       work_dir=f"{shared_folder(spark)}/run-{uuid.uuid4().hex}")
    best = F.max("mean_test_score")
    search = run["search"].agg(F.count(F.lit(1)).alias("n_settings"), F.count_distinct("params").alias("n_distinct_settings"),
                               ((best == F.lit(run["best_score"])) & (best < 0) & (F.min("rank_test_score") == 1)).alias("best_is_first"))
    ends = matrix.agg(F.min(_TARGET).alias("lo"), F.max(_TARGET).alias("hi")).first()
    inside = run["predictions"].agg(F.bool_and(F.col("y_pred").between(ends["lo"] - 1e-9, ends["hi"] + 1e-9)).alias("within_targets"))
    laws = run["metrics"].select("target_column", "n_samples",
                                 (F.col("train_size") + F.col("val_size") + F.col("test_size") == F.col("n_samples")).alias("parts_add_up"),
                                 ((F.col("mae") >= 0) & (F.col("mae") <= F.col("rmse") + 1e-9) & (F.col("r2") <= 1)).alias("lawful_errors"))
    keyed = [d.withColumn("_k", F.lit(1)) for d in (laws, search, inside)]  # one row each
    return keyed[0].join(keyed[1], "_k").join(keyed[2], "_k").drop("_k")


@query(f"SELECT unnest({schema.temporal_filter(MATRIX, _TARGET, WEEKS)[0]}) AS feature, 16::BIGINT AS n_settings, true AS is_share, true AS shares_add_up")
def boosted_importance(spark, sf):
    """Features of the best of 16 boosting settings (4 folds, early stopping): importances are shares of one whole, or all 0 without any split."""
    kept, train = _features(spark, sf)
    found = models.fit_boosted(train, _TARGET)
    shares = models.feature_importance(found["model"], kept, spark)
    whole = float(sum(found["model"].featureImportances.toArray()))
    return shares.select("feature", F.lit(found["results"].count()).cast("long").alias("n_settings"), F.col("importance").between(0, 1).alias("is_share"),
                         F.lit(abs(whole - 1) < 1e-9 or whole == 0).alias("shares_add_up"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("double").alias("y"), "embedding")
    return models.to_feature_vector(e, "embedding").drop("embedding").withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0))


@query()
def logistic_fit(spark, sf):
    """Class-weighted logistic regression on embeddings, resampled by weight."""
    rows = _vectors(spark, sf).persist()
    model = models.fit_logistic(rows, "y", oversample="w")
    scored = models.scored_classes(model, rows).withColumn("target", F.lit("label0"))
    return rounded(evaluate.auc(scored))


@query()
def mlp_fit(spark, sf):
    rows = _vectors(spark, sf).persist()
    model = models.fit_mlp(rows, "y", 64, oversample="w")
    scored = models.scored_classes(model, rows).withColumn("target", F.lit("label0"))
    return rounded(evaluate.auc(scored))


@query()
def logistic_overview(spark, sf):
    """One model per target of the matrix, evaluated together."""
    from riskframe.plans.runs import train_logistic
    out = train_logistic(outcome_matrix(spark, sf), matrix_targets(spark), MATRIX, WEEKS, SEED, pain_metrics=["click"], high_above=60.0)
    return rounded(out)


@query()
def tuning_grid(spark, sf):
    """All oversampling and loss weights tried on all targets; the report order.

    Targets are prepared once; those without pain scores don't depend on the weights and are fitted once.
    """
    from riskframe.plans.runs import prepare_logistic, tune_logistic
    pain = ["click"]
    name = F.when(F.col("metric") == "click", F.concat("day", F.lit("_RestPain"))).otherwise(F.col("target_en"))
    targets = matrix_targets(spark).withColumn("target_en", name)
    prepared = prepare_logistic(outcome_matrix(spark, sf).persist(), targets, MATRIX, WEEKS, SEED)
    return rounded(models.rank_table(tune_logistic(prepared, models.tuning_settings(), SEED, pain_metrics=pain, high_above=60.0)))


@query(f"""WITH {_DOCS}, c AS ({counts_sql('0.5')}), r AS (SELECT *, {rates_sql()} FROM c), {_AUC}
SELECT 1::BIGINT AS run_id, count(*) AS n_targets, count(*) AS n_pain_targets, round(avg(auc), 6) AS mean_auc, round(avg(f1), 6) AS mean_f1,
  round(avg(auc), 6) AS pain_mean_auc, round(avg(f1), 6) AS pain_mean_f1 FROM r JOIN a USING (target)""")
def run_summary(spark, sf):
    """Mean metrics of a run, and the best run of one."""
    rows = scored_documents(spark, sf)
    both = evaluate.confusion(rows, 0.5).join(evaluate.auc(rows).select("target", "auc"), "target")
    both = both.withColumns({"target": F.concat(F.lit("POD1_RestPain_"), "target"), "run_id": F.lit(1).cast("long")})
    s = models.rank_runs(models.summarize_overview(both))
    return rounded(s.select("run_id", "n_targets", "n_pain_targets", "mean_auc", "mean_f1", "pain_mean_auc", "pain_mean_f1"))


@query(f"""WITH {_LINES}, m AS (SELECT l_returnflag, avg(abs(p - y)) AS mae,
  count(*) FILTER (WHERE y >= 4 AND p >= 4) AS tp, count(*) FILTER (WHERE y < 4 AND p >= 4) AS fp, count(*) FILTER (WHERE y >= 4 AND p < 4) AS fn FROM t GROUP BY 1),
{_DOCS}, {_AUC}
SELECT 'random_forest' AS run, 'regression' AS task, 'randomforest' AS model, 'flag_' || l_returnflag AS data_version, 'y_true' AS target, round(mae, 4) AS mae, NULL::DOUBLE AS auroc,
  round(tp / (tp + fn)::DOUBLE, 4) AS high_pain_recall_at_4, round(tp / (tp + fp)::DOUBLE, 4) AS high_pain_precision_at_4 FROM m
UNION ALL SELECT 'logistic', 'classification', 'logistic_regression', 'raw', target, NULL, round(auc, 4), NULL, NULL FROM a""")
def run_registry(spark, sf):
    """Run outputs of all lines and documents are written, then collected again."""
    from riskframe.operators.registry import METRICS_FILE, NO_RUN, PREDICTIONS_FILE, registry, registry_summary
    from riskframe.plans.runs import save_overview, save_runs
    root = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    lines = scored_lines(spark, sf)
    run, folder = F.concat(F.lit("flag_"), "l_returnflag"), f"{root}/models/random_forest/outputs"
    save_runs(evaluate.regression_metrics(lines, ["l_returnflag"]).select("*", F.lit("y_true").alias("target_column"), run.alias("group_name")), run, folder, METRICS_FILE)
    save_runs(lines.select("y_true", "y_pred", "l_returnflag"), run, folder, PREDICTIONS_FILE)
    save_overview(evaluate.auc(scored_documents(spark, sf)), f"{root}/models/logistic/outputs/raw")
    s = registry_summary(registry(spark, root))
    number = lambda c: F.round(F.col(c).try_cast("double"), 4).alias(c)
    return s.select(F.element_at(F.split("source_file", "/"), 2).alias("run"), "task", "model",
                    F.nullif("data_version", F.lit(NO_RUN)).alias("data_version"), "target", number("mae"), number("auroc"),
                    number("high_pain_recall_at_4"), number("high_pain_precision_at_4"))


