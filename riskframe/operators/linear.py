"""Searches of linear models from moments, and many logistic fits at once by Newton steps.

Both hold what grows with columns and settings on the driver (sums of products, coefficients) and read the rows as a whole: a task
turns its rows into one array of sums, the sums are added per fold or per model.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars
from riskframe.operators.impute import column_medians
from riskframe.operators.models import ELASTIC_ALPHAS, ELASTIC_L1_RATIOS, RIDGE_ALPHAS, search_results
from riskframe.operators.splits import kfold

SUMS = "part string, size long, sums array<double>"


def added(partial: DataFrame) -> dict[str, np.ndarray]:
    """Sum of the arrays of each part, place by place; one row per place is all that reaches the driver."""
    cells = partial.select("part", F.posexplode("sums").alias("at", "v")).groupBy("part", "at").agg(F.sum("v").alias("v"))
    out: dict[str, list] = {}
    for r in cells.collect():
        out.setdefault(r["part"], []).append((r["at"], r["v"]))
    return {k: np.array([v for _, v in sorted(cells)]) for k, cells in out.items()}


def fold_moments(df: DataFrame, cols: Sequence[str], y: str, fold: str) -> dict[str, np.ndarray]:
    """Per fold the products of (1, values with 0 for NULL, NULL flags, target): any fill and scale can be applied to them later."""
    values = [scalars.to_double(F.col(c)) for c in cols]
    rows = df.select(F.col(fold).cast("string").alias("part"), F.array(
        F.lit(1.0), *[F.coalesce(v, F.lit(0.0)) for v in values], *[v.isNull().cast("double") for v in values], F.col(y).cast("double")).alias("x"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), object)
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            for part in set(parts):
                own = x[parts == part]
                held[part] = held.get(part, 0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([m.size for m in held.values()], pa.int64()),
                                          pa.array([m.reshape(-1) for m in held.values()], pa.list_(pa.float64()))], names=["part", "size", "sums"])

    found = added(rows.mapInArrow(run, SUMS))
    side = 2 * len(cols) + 2
    return {k: m.reshape(side, side) for k, m in found.items()}


def standardised(m: np.ndarray, fills: np.ndarray) -> dict[str, np.ndarray]:
    """Mean and deviation of the filled columns, and the products of the standardised columns and the centred target."""
    k = len(fills)
    fill = np.zeros((len(m), k + 2))  # (1, filled columns, target) from (1, values, flags, target)
    fill[0, 0] = fill[-1, -1] = 1
    fill[1:k + 1, 1:k + 1] = np.eye(k)
    fill[k + 1:2 * k + 1, 1:k + 1] = np.diag(fills)
    p = fill.T @ m @ fill
    n, mean = p[0, 0], p[0, 1:] / p[0, 0]
    centred = p[1:, 1:] - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(centred)[:k] / n, 0))
    std = np.where(std > 1e-12 * np.maximum(1, np.abs(mean[:k])), std, 1.0)  # a constant column is not scaled
    return {"n": n, "mean": mean[:k], "y": mean[k], "std": std, "xx": centred[:k, :k] / np.outer(std, std), "xy": centred[:k, k] / std}


def ridge_solution(s: dict, alpha: float) -> np.ndarray:
    """Least |y - Xw|^2 + alpha |w|^2."""
    return np.linalg.solve(s["xx"] + alpha * np.eye(len(s["xy"])), s["xy"])


def elastic_solution(s: dict, alpha: float, l1_ratio: float, rounds: int = 10_000, tolerance: float = 1e-10) -> np.ndarray:
    """Least |y - Xw|^2 / 2n + alpha (r |w|_1 + (1 - r) / 2 |w|^2), one coordinate after the other."""
    n, w = s["n"], np.zeros(len(s["xy"]))
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    for _ in range(rounds):
        change = 0.0
        for j in range(len(w)):
            left = s["xy"][j] - s["xx"][j] @ w + s["xx"][j, j] * w[j]
            new = np.sign(left) * max(abs(left) - l1, 0.0) / (s["xx"][j, j] + l2) if s["xx"][j, j] + l2 else 0.0
            change, w[j] = max(change, abs(new - w[j])), new
        if change <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def raw_line(s: dict, fills: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients of (1, values with 0 for NULL, NULL flags)."""
    slope = w / s["std"]
    return np.concatenate([[s["y"] - slope @ s["mean"]], slope, slope * fills])


def predict_line(line: dict) -> Column:
    """Prediction of a fitted line from its own columns."""
    terms = [(scalars.to_double(F.col(c)), i) for i, c in enumerate(line["features"])]
    return reduce(lambda a, b: a + b, [(F.coalesce(v, F.lit(line["fills"][i])) - F.lit(line["means"][i])) / F.lit(line["stds"][i]) * F.lit(line["weights"][i])
                                       for v, i in terms], F.lit(line["intercept"]))


def fold_errors(df: DataFrame, cols: Sequence[str], y: str, fold: str, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of absolute errors per (fold of the row, line), and rows per fold."""
    values = [scalars.to_double(F.col(c)) for c in cols]
    rows = df.select(F.col(fold).cast("string").alias("part"), F.array(
        F.lit(1.0), *[F.coalesce(v, F.lit(0.0)) for v in values], *[v.isNull().cast("double") for v in values], F.col(y).cast("double")).alias("x"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), object)
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            for part in set(parts):
                own = x[parts == part]
                sums = np.append(np.abs(own[:, -1:] - own[:, :-1] @ lines.T).sum(axis=0), len(own))
                held[part] = held.get(part, 0) + sums
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([m.size for m in held.values()], pa.int64()),
                                          pa.array(list(held.values()), pa.list_(pa.float64()))], names=["part", "size", "sums"])

    found = added(rows.mapInArrow(run, SUMS))
    table = np.array([found[k] for k in sorted(found, key=int)])
    return table[:, :-1], table[:, -1]


def search_linear(train: DataFrame, cols: Sequence[str], y: str, solutions: Sequence[tuple[dict, object]], folds: int = 4, seed: int = 42,
                  id_col: str = "row_id") -> dict:
    """Cross-validate settings of a linear model on raw columns; refit the best one on all rows.

    Every fold is filled with the medians and scaled with the means and deviations of its own training rows.  The moments of a
    fold's training rows are those of all rows less those of the fold, so the rows are read once for the moments and once for
    the errors of all settings and folds, besides the medians.  The score is the negative mean absolute error.
    """
    part = kfold(train.where(F.col(y).isNotNull()), folds, seed, id_col).persist()
    try:
        moments = fold_moments(part, cols, y, "fold")
        names = sorted(moments, key=int)
        if len(names) < 2:
            raise ValueError("a search needs rows in two folds at least")
        whole = sum(moments.values())
        trained = []
        for out in [*names, None]:
            found = column_medians(part.where(F.col("fold") != int(out)) if out is not None else part, cols)
            fills = np.array([0.0 if found[c] is None else found[c] for c in cols])
            trained.append((fills, standardised(whole - moments[out] if out is not None else whole, fills)))
        lines = np.array([raw_line(s, fills, solve(s)) for fills, s in trained[:-1] for _, solve in solutions])
        errors, sizes = fold_errors(part, cols, y, "fold", lines)
    finally:
        part.unpersist()
    errors = errors.reshape(len(names), len(names), len(solutions))  # rows of a fold, line without a fold, setting
    rows = []
    for i, (params, _) in enumerate(solutions):
        test = [-errors[f, f, i] / sizes[f] for f in range(len(names))]
        own = [-(errors[:, f, i].sum() - errors[f, f, i]) / (sizes.sum() - sizes[f]) for f in range(len(names))]
        rows.append((i, json.dumps(params, sort_keys=True), *[float(x) for x in (np.mean(test), np.std(test), np.mean(own), np.std(own))]))
    results = search_results(train.sparkSession.createDataFrame(
        rows, "setting int, params string, mean_test_score double, std_test_score double, mean_train_score double, std_train_score double"))
    best = min(rows, key=lambda r: (-r[2], r[0]))
    fills, s = trained[-1]
    w = solutions[best[0]][1](s)
    line = {"features": list(cols), "weights": w.tolist(), "intercept": float(s["y"]), "means": s["mean"].tolist(), "stds": s["std"].tolist(), "fills": fills.tolist()}
    return {"model": line, "params": solutions[best[0]][0], "best_score": best[2], "results": results}


def search_ridge(train: DataFrame, cols: Sequence[str], y: str, alphas: Sequence[float] = RIDGE_ALPHAS, **cv) -> dict:
    return search_linear(train, cols, y, [({"alpha": a}, lambda s, a=a: ridge_solution(s, a)) for a in alphas], **cv)


def search_elastic_net(train: DataFrame, cols: Sequence[str], y: str, alphas: Sequence[float] = ELASTIC_ALPHAS,
                       l1_ratios: Sequence[float] = ELASTIC_L1_RATIOS, **cv) -> dict:
    settings = [({"alpha": a, "l1_ratio": r}, lambda s, a=a, r=r: elastic_solution(s, a, r)) for a in alphas for r in l1_ratios]
    return search_linear(train, cols, y, settings, **cv)


def newton_sums(rows: DataFrame, weights: np.ndarray, betas: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Per target the (loss, sum of weights, gradient, Hessian) of all its models, before the penalty.

    ``rows``: target, y, high, times (one number per draw), x.  ``weights``: (draw, loss weight of high rows) per model.
    """
    draw, loss = weights[:, 0].astype(int), weights[:, 1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            targets = np.array(batch.column(0).to_pylist(), object)
            y, high = (np.asarray(batch.column(i)) for i in (1, 2))
            times = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            x = np.asarray(batch.column(4).flatten()).reshape(batch.num_rows, width)
            for target in set(targets):
                own = targets == target
                a, label = x[own], y[own][:, None]
                w = times[own][:, draw] * np.where(high[own][:, None] > 0, loss, 1.0)
                margin = a @ betas[target].T
                p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                lost = w * (np.logaddexp(0, margin) - label * margin)
                pairs = (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)
                sums = np.concatenate([lost.sum(0)[:, None], w.sum(0)[:, None], (w * (p - label)).T @ a, (w * p * (1 - p)).T @ pairs], axis=1)
                held[target] = held.get(target, 0) + sums
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([m.size for m in held.values()], pa.int64()),
                                          pa.array([m.reshape(-1) for m in held.values()], pa.list_(pa.float64()))], names=["part", "size", "sums"])

    return {k: v.reshape(len(weights), -1) for k, v in added(rows.select("target", "y", "high", "times", "x").mapInArrow(run, SUMS)).items()}


def fit_logistic_grid(rows: DataFrame, weights: Sequence[tuple[int, float]], width: int, l2: float = 1e-4, rounds: int = 50,
                      tolerance: float = 1e-7) -> dict[str, np.ndarray]:
    """Coefficients (models x width) per target: all models of all targets take a Newton step per pass over the rows.

    ``rows``: target, y (0 or 1), high (whether a model's loss weight applies), times (how often each draw has the row, times its
    class weight) and x of ``width`` values, the first of them 1; it is not penalised.  ``weights``: (draw, loss weight) per model.
    The loss is the weighted mean of the log loss plus l2 / 2 |w|^2.  A step that raises a model's loss is halved.  Columns that
    are 0 throughout a target keep the weight 0.
    """
    weights = np.array(weights, float)
    targets = [r["target"] for r in rows.select("target").distinct().collect()]
    here = {t: np.zeros((len(weights), width)) for t in targets}
    step = {t: np.zeros((len(weights), width)) for t in targets}
    share = {t: np.ones(len(weights)) for t in targets}
    best: dict[str, np.ndarray] = {t: np.full(len(weights), np.inf) for t in targets}
    penalised = np.full(width, l2)
    penalised[0] = 0.0
    for _ in range(rounds):
        trial = {t: here[t] + share[t][:, None] * step[t] for t in targets}
        sums, moved = newton_sums(rows, weights, trial, width), 0.0
        for t in targets:
            n = sums[t][:, 1]
            value = sums[t][:, 0] / n + (penalised * trial[t] ** 2).sum(1) / 2
            gradient = sums[t][:, 2:2 + width] / n[:, None] + penalised * trial[t]
            hessian = (sums[t][:, 2 + width:] / n[:, None]).reshape(-1, width, width) + np.diag(penalised + 1e-12)
            for m in range(len(weights)):
                if value[m] > best[t][m] + 1e-10 and share[t][m] > 1e-6:
                    share[t][m] /= 2
                else:
                    here[t][m], best[t][m], share[t][m] = trial[t][m], min(value[m], best[t][m]), 1.0
                    step[t][m] = -np.linalg.solve(hessian[m], gradient[m])
            moved = max(moved, (np.abs(share[t][:, None] * step[t]) / np.maximum(1, np.abs(here[t]))).max())
        if moved < tolerance:
            break
    return here


def grid_scores(rows: DataFrame, betas: dict[str, np.ndarray], ids: str = "row_id") -> DataFrame:
    """(target, model, row_id, y, p) of every model of a row's target; ``rows``: target, row_id, y, x."""
    kind = dict(rows.dtypes)[ids]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            targets = np.array(batch.column(0).to_pylist(), object)
            x = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            for target in set(targets):
                own = np.flatnonzero(targets == target)
                p = 1 / (1 + np.exp(-np.clip(x[own] @ betas[target].T, -500, 500)))
                models = p.shape[1]
                at = pa.array(np.repeat(own, models))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.tile(np.arange(models), len(own))), batch.column(1).take(at),
                                                  batch.column(2).take(at), pa.array(p.reshape(-1))], names=["target", "model", ids, "y", "p"])

    return rows.select("target", ids, F.col("y").cast("int").alias("y"), "x").mapInArrow(run, f"target string, model long, {ids} {kind}, y int, p double")
