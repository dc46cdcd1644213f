"""Regression and classification metrics as grouped aggregations.

Classification works on long rows ``(target, row_id, y, p)``; rows whose label
is NULL do not count.  All targets are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import scalars
from riskframe.operators.ordering import bucket_by_value, running_totals

GRID_LOW, GRID_HIGH, GRID_SIZE = 0.05, 0.95, 181  # fixed values: the threshold grid
TIE_SPAN = 1_000_000  # row ids per bucket inside a group of tied scores


def regression_metrics(pred: DataFrame, group: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """n, MAE, RMSE and R² (NULL for a constant truth)."""
    err = F.col(p) - F.col(y)
    sst = F.var_pop(y) * F.count(y)
    return pred.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(err * err) / sst).alias("r2"))


def harmonic(a: Column, b: Column) -> Column:
    """F1 of two ratios, NULL when undefined or when both are 0."""
    return F.when(a + b > 0, 2 * a * b / (a + b))


def tail_metrics(pred: DataFrame, group: Sequence[str] = (), thresholds: Sequence[float] = (4.0, 5.0),
                 y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Errors in the low, middle and high range, and detection of high scores.

    Undefined ratios are NULL.  Scores strictly between 0 and 1 belong to no range.
    """
    yt, yp = F.col(y), F.col(p)
    err = F.abs(yt - yp)
    first = [
        F.avg(F.when(yt == 0, err)).alias("mae_true_0"),
        F.avg(F.when((yt >= 1) & (yt < 4), err)).alias("mae_true_1_3"),
        F.avg(F.when(yt >= 4, err)).alias("mae_true_ge_4"),
        F.avg(F.when(yt >= 4, yp - yt)).alias("bias_true_ge_4")]
    for t in thresholds:
        k = f"threshold_{t:g}"
        high, hit = yt >= t, yp >= t
        first += [F.count_if(high).alias(f"{k}_actual_positive_count"), F.count_if(hit).alias(f"{k}_predicted_positive_count"),
                  F.count_if(high & hit).alias(f"{k}_tp"), F.count_if(~high & hit).alias(f"{k}_fp"),
                  F.count_if(high & ~hit).alias(f"{k}_fn"),
                  F.avg(F.when(high, err)).alias(f"{k}_subset_mae"), F.avg(F.when(high, yp - yt)).alias(f"{k}_subset_bias")]
    out = pred.groupBy(*group).agg(*first)
    for t in thresholds:
        k = f"threshold_{t:g}"
        tp = F.col(f"{k}_tp")
        out = out.withColumns({f"{k}_recall": F.try_divide(tp, tp + F.col(f"{k}_fn")),
                               f"{k}_precision": F.try_divide(tp, tp + F.col(f"{k}_fp"))})
        out = out.withColumn(f"{k}_f1", harmonic(F.col(f"{k}_precision"), F.col(f"{k}_recall")))
    return out


def ratio(num: Column, den: Column) -> Column:
    """Ratio that is 0 when undefined, as the classification metrics use it."""
    return F.when(den > 0, num / den).otherwise(0.0)


def confusion_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "accuracy": (tp + tn) / (tp + tn + fp + fn), "balanced_accuracy": 0.5 * (recall + specificity),
        "precision": precision, "recall": recall, "specificity": specificity, "fpr": ratio(fp, fp + tn),
        "f1": ratio(2 * precision * recall, precision + recall)}


def confusion(pred: DataFrame, threshold: Column | float, group: Sequence[str] = ("target",),
              y: str = "y", p: str = "p") -> DataFrame:
    """Counts and rates at a threshold (a number or a column)."""
    yt, hit = F.col(y), F.col(p) >= threshold
    out = pred.where(yt.isNotNull()).groupBy(*group).agg(
        F.count_if((yt == 1) & hit).alias("tp"), F.count_if((yt == 0) & hit).alias("fp"),
        F.count_if((yt == 1) & ~hit).alias("fn"), F.count_if((yt == 0) & ~hit).alias("tn"),
        F.avg((yt == 1).cast("double")).alias("positive_rate"))
    return out.withColumns(confusion_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def score_totals(pred: DataFrame, group: Sequence[str], y: str, p: str) -> DataFrame:
    """Distinct scores in falling order with running rows and positives."""
    distinct = (pred.where(F.col(y).isNotNull()).groupBy(*group, F.col(p).alias("p"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
                .withColumn("neg_p", -F.col("p")))
    keyed = bucket_by_value(distinct, group, "neg_p")
    return running_totals(keyed, group, ["_b"], ["neg_p"], {"cum_n": F.col("n"), "cum_pos": F.col("pos")})


def auc(pred: DataFrame, group: Sequence[str] = ("target",), y: str = "y", p: str = "p") -> DataFrame:
    """Rank-sum AUC, tied scores at their average rank; NULL with one class."""
    t = score_totals(pred, group, y, p)
    rank = F.col("cum_n_total") - F.col("cum_n") + (F.col("n") + 1) / 2.0
    sums = t.groupBy(*group).agg(F.sum(rank * F.col("pos")).alias("_r"), F.max("cum_n_total").alias("n"),
                                 F.max("cum_pos_total").alias("pos"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return sums.select(*group, "n", "pos", F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2.0) / (pos * neg)).alias("auc"))


def average_precision(pred: DataFrame, group: Sequence[str] = ("target",), y: str = "y", p: str = "p",
                      id_col: str = "row_id") -> DataFrame:
    """Mean precision at the positives in falling score order, ties by row id.

    Single scores are settled on the table of distinct scores.  Only rows of
    tied scores that hold a positive are ordered, in buckets of row ids.
    """
    g = list(group)
    t = score_totals(pred, g, y, p).withColumns({
        "n0": F.col("cum_n") - F.col("n"), "pos0": F.col("cum_pos") - F.col("pos")})
    single = t.where((F.col("n") == 1) & (F.col("pos") == 1)).select(
        *g, ((F.col("pos0") + 1) / (F.col("n0") + 1)).alias("at"))
    tied = t.where((F.col("n") > 1) & (F.col("pos") > 0)).select(*g, "p", "n0", "pos0")
    rows = (pred.where(F.col(y).isNotNull()).select(*g, F.col(p).alias("p"), F.col(y).alias("y"), id_col)
            .join(tied, [*g, "p"]).withColumn("_range", F.floor(F.col(id_col) / TIE_SPAN)))
    inner = running_totals(rows, [*g, "p"], ["_range"], [id_col], {"_n": F.lit(1), "_pos": F.col("y").cast("long")})
    many = inner.where(F.col("y") == 1).select(
        *g, ((F.col("pos0") + F.col("_pos")) / (F.col("n0") + F.col("_n"))).alias("at"))
    sums = single.unionByName(many).groupBy(*g).agg(F.sum("at").alias("_s"), F.count(F.lit(1)).alias("_pos"))
    sizes = t.groupBy(*g).agg(F.max("cum_n_total").alias("n"))
    return sizes.join(sums, g, "left").select(*g, "n", (F.col("_s") / F.col("_pos")).alias("average_precision"))


def losses(pred: DataFrame, group: Sequence[str] = ("target",), y: str = "y", p: str = "p",
           weight: str | None = None) -> DataFrame:
    """Log loss, its weighted form and the Brier score."""
    rows = pred.where(F.col(y).isNotNull())
    loss = scalars.log_loss(F.col(y), F.col(p))
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return rows.groupBy(*group).agg(
        F.avg(loss).alias("log_loss"),
        F.when(F.sum(w) > 0, F.sum(loss * w) / F.sum(w)).otherwise(F.avg(loss)).alias("weighted_log_loss"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def focal_losses(pred: DataFrame, alpha: float, gamma: float, group: Sequence[str] = ("target",),
                 y: str = "y", p: str = "p") -> DataFrame:
    """Mean focal loss over all rows, unlabelled ones counting 0, and over labelled ones."""
    loss = scalars.focal_loss(F.col(y), F.col(p), alpha, gamma)
    return pred.groupBy(*group).agg(F.sum(loss).alias("focal_sum"), F.count(y).alias("n_labelled"),
                                    F.try_divide(F.sum(loss), F.count(y)).alias("focal_mean"))


def grid_value(i: Column, size: int = GRID_SIZE) -> Column:
    return F.lit(GRID_LOW) + i * F.lit((GRID_HIGH - GRID_LOW) / (size - 1))


def threshold_scores(val: DataFrame, group: Sequence[str] = ("target",), y: str = "y", p: str = "p",
                     size: int = GRID_SIZE, base_threshold: float = 0.5) -> DataFrame:
    """Counts and rates of every grid threshold, next to those of the base threshold.

    Rows are first counted per grid cell; only those at most ``size + 1`` cells
    per target are accumulated.
    """
    g = list(group)
    step = (GRID_HIGH - GRID_LOW) / (size - 1)
    guess = F.floor((F.col(p) - GRID_LOW) / step)
    cell = (F.when(F.col(p) < grid_value(guess, size), guess - 1)
            .when(F.col(p) >= grid_value(guess + 1, size), guess + 1).otherwise(guess))
    cell = F.least(F.greatest(cell, F.lit(-1)), F.lit(size - 1)).cast("int")
    yt, base_hit = F.col(y), F.col(p) >= base_threshold
    cells = val.where(yt.isNotNull()).groupBy(*g, cell.alias("cell")).agg(
        F.count_if(yt == 1).alias("pos"), F.count_if(yt == 0).alias("neg"),
        F.count_if((yt == 1) & base_hit).alias("b_pos"), F.count_if((yt == 0) & base_hit).alias("b_neg"))
    totals = cells.groupBy(*g).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"),
        F.sum("b_pos").alias("b_tp"), F.sum("b_neg").alias("b_fp"))
    frame = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    above = Window.partitionBy(*g).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    grid = frame.join(cells.select(*g, "cell", "pos", "neg"), [*g, "cell"], "left")
    grid = grid.withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(above),
                             "fp": F.sum(F.coalesce("neg", F.lit(0))).over(above)})
    grid = grid.withColumns({"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp"),
                             "threshold": grid_value(F.col("cell"), size)})
    grid = grid.withColumns(confusion_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))
    base = confusion_rates(F.col("b_tp"), F.col("b_fp"), F.col("all_pos") - F.col("b_tp"), F.col("all_neg") - F.col("b_fp"))
    return grid.withColumns({f"base_{k}": base[k] for k in ("accuracy", "recall", "fpr")})


def tune_threshold(val: DataFrame, group: Sequence[str] = ("target",), y: str = "y", p: str = "p",
                   fpr_reduction: float = 0.35, acc_drop: float = 0.02, min_recall: float = 0.75,
                   fp_penalty: float = 0.25, size: int = GRID_SIZE) -> DataFrame:
    """Best grid threshold per target.

    Among thresholds that lower the false-positive rate enough without losing
    too much accuracy or recall the best F1 wins; without any, a soft score
    decides.  The lowest threshold wins ties.
    """
    s = threshold_scores(val, group, y, p, size)
    ok = ((F.col("fpr") <= F.col("base_fpr") * max(0.0, 1.0 - fpr_reduction))
          & (F.col("accuracy") >= F.col("base_accuracy") - acc_drop)
          & (F.col("recall") >= F.col("base_recall") * min_recall))
    soft = F.col("f1") + 0.20 * F.col("precision") + 0.10 * F.col("recall") - fp_penalty * F.col("fpr")
    key = F.struct(
        ok.cast("int").alias("feasible"),
        F.when(ok, F.col("f1")).otherwise(soft).alias("score"),
        *[F.when(ok, c).otherwise(0.0).alias(f"k{i}") for i, c in enumerate(
            (F.col("precision"), F.col("recall"), F.col("accuracy"), -F.col("fpr")))],
        (-F.col("cell")).alias("lowest"))
    keep = ["threshold", "accuracy", "precision", "recall", "fpr", "f1", "tp", "fp", "fn", "tn"]
    best = s.withColumn("feasible", ok).groupBy(*group).agg(F.max_by(F.struct("feasible", *keep), key).alias("b"))
    mode = F.when(F.col("b.feasible"), "constrained_search").otherwise("fallback_objective")
    return best.select(*group, mode.alias("mode"), *[F.col(f"b.{k}").alias(k) for k in keep])


def day_threshold(targets: DataFrame, days: DataFrame, default: float = 0.5) -> DataFrame:
    """Fixed threshold of each target's day; ``days`` has (day, threshold)."""
    return targets.join(F.broadcast(days), "day", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(default)))


def confusion_row_share(counts: DataFrame) -> DataFrame:
    """Row-normalised 2x2 table; an empty row gives 0."""
    low, high = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return counts.withColumns({
        "p_true_low_pred_low": ratio(F.col("tn"), low), "p_true_low_pred_high": ratio(F.col("fp"), low),
        "p_true_high_pred_low": ratio(F.col("fn"), high), "p_true_high_pred_high": ratio(F.col("tp"), high)})


def overview(pred: DataFrame, thresholds: DataFrame, y: str = "y", p: str = "p", id_col: str = "row_id") -> DataFrame:
    """One row per target: all metrics at the target's chosen threshold."""
    rows = pred.where(F.col(y).isNotNull()).join(F.broadcast(thresholds.select("target", "threshold")), "target")
    counts = confusion(rows, F.col("threshold"), ["target"], y, p)
    out = confusion_row_share(counts).join(auc(pred, ["target"], y, p).select("target", "n", "auc"), "target")
    out = out.join(average_precision(pred, ["target"], y, p, id_col).select("target", F.col("average_precision").alias("auprc")), "target")
    out = out.join(losses(pred, ["target"], y, p).drop("weighted_log_loss"), "target")
    out = out.join(thresholds.select("target", F.col("threshold").alias("chosen_threshold")), "target")
    return out.withColumn("auprc_lift", F.when(F.col("positive_rate") > 0, F.col("auprc") / F.col("positive_rate")))


def multi_target_rows(labels: DataFrame, probs: DataFrame, targets: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """Long (target, row_id, y, p) rows from a label matrix and a probability matrix.

    Rows with any label stay; each target keeps the rows where its own label is known.
    """
    y = labels.select(id_col, *targets).unpivot([id_col], list(targets), "target", "y")
    p = probs.select(id_col, *targets).unpivot([id_col], list(targets), "target", "p")
    return y.where(F.col("y").isNotNull()).join(p, [id_col, "target"])
