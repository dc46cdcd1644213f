"""Pairwise-complete correlations of the outcome columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars
from riskframe.operators.ordering import average_ranks


def column_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, x, y) for every row and pair with both values.

    Each row unfolds into its own pairs, so no join over rows is needed.  The
    number of pairs depends on the column list only.
    """
    cols = list(cols)
    pairs = ", ".join(f"array({i}, {j})" for i, j in combinations(range(len(cols)), 2))
    values = df.select(F.array(*[scalars.to_double(F.col(f"`{c}`")) for c in cols]).alias("v"))
    both = values.select("v", F.expr(f"explode(array({pairs})) AS p")).select(
        F.get("p", 0).alias("i"), F.get("p", 1).alias("j"),
        F.get("v", F.get("p", 0)).alias("x"), F.get("v", F.get("p", 1)).alias("y"))
    return both.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def with_names(stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column names for the positions of a pair; pairs without rows are added."""
    names = [(i, j, a, b) for (i, a), (j, b) in combinations(list(enumerate(cols)), 2)]
    frame = stats.sparkSession.createDataFrame(names, "i int, j int, variable_1 string, variable_2 string")
    return frame.join(stats, ["i", "j"], "left").drop("i", "j").withColumn("n_pairwise", F.coalesce("n_pairwise", F.lit(0)))


def pearson_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n and r per pair; r is NULL below 3 rows or with a constant side."""
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    stats = column_pairs(df, cols).groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n_pairwise"),
        F.when((F.count(F.lit(1)) >= 3) & varies, F.try_divide(
            F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y")))).alias("pearson_r"))
    return with_names(stats, cols)


def spearman_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n and rank correlation per pair, ranks taken on the pair's own rows.

    Rows are merged to (pair, x, y, count) first; ranks come from the distinct
    values of each side.  The mean rank is (n + 1) / 2 whatever the ties.
    """
    pair = ["i", "j"]
    joint = column_pairs(df, cols).groupBy(*pair, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    rank_of = lambda side: average_ranks(joint, pair, side, F.col("n"), f"_r{side}")
    ranked = (joint.join(rank_of("x").select(*pair, "x", "_rx", "total"), [*pair, "x"])
              .join(rank_of("y").select(*pair, "y", "_ry"), [*pair, "y"]))
    dx = F.col("_rx") - (F.col("total") + 1) / 2.0
    dy = F.col("_ry") - (F.col("total") + 1) / 2.0
    sums = ranked.groupBy(*pair).agg(
        F.max("total").alias("n_pairwise"), F.sum(F.col("n") * dx * dy).alias("_xy"),
        F.sum(F.col("n") * dx * dx).alias("_xx"), F.sum(F.col("n") * dy * dy).alias("_yy"))
    r = F.when((F.col("n_pairwise") >= 3) & (F.col("_xx") > 0) & (F.col("_yy") > 0),
               F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    out = sums.select(*pair, "n_pairwise", r.alias("spearman_r"))
    return with_names(out, cols)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def _log_gamma(v: np.ndarray) -> np.ndarray:
    """ln Gamma: recurrence up to 10, then Stirling's series."""
    v = np.asarray(v, dtype=float).copy()
    shift = np.zeros_like(v)
    for _ in range(10):
        low = v < 10
        shift = np.where(low, shift - np.log(np.where(low, v, 1.0)), shift)
        v = np.where(low, v + 1, v)
    series = 1 / (12 * v) - 1 / (360 * v**3) + 1 / (1260 * v**5) - 1 / (1680 * v**7)
    return shift + (v - 0.5) * np.log(v) - v + 0.5 * np.log(2 * np.pi) + series


def two_sided_p(n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Two-sided t test of a correlation: I_x(df/2, 1/2) with x = 1 - r^2."""
    n, r = np.asarray(n, dtype=float), np.asarray(r, dtype=float)
    ok = np.isfinite(r) & (n > 2)
    df = np.where(ok, n - 2, 1.0)
    x = np.clip(np.where(ok, 1 - r * r, 0.5), 0.0, 1.0)
    a, b = df / 2, np.full_like(df, 0.5)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = inner < (a + 1) / (a + b + 2)
    p = np.where(direct, front * _beta_fraction(a, b, np.where(direct, inner, 0.5)) / a,
                 1 - front * _beta_fraction(b, a, np.where(direct, 0.5, 1 - inner)) / b)
    p = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, p))
    return np.where(ok, p, np.nan)


def with_pvalue(pairs: DataFrame, n: str, r: str, out: str) -> DataFrame:
    """Add the p-value to the pair table (a few hundred rows)."""

    @F.pandas_udf("double")
    def pvalue(n_: pd.Series, r_: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(n_.to_numpy(), r_.astype(float).to_numpy()))

    p = pvalue(F.col(n).cast("double"), F.col(r))
    return pairs.withColumn(out, F.when(F.col(r).isNotNull(), p))


def relationship(day1: Column, metric1: Column, day2: Column, metric2: Column) -> Column:
    return (F.when(day1 == day2, "within_day").when(metric1 == metric2, "cross_day_same_outcome")
            .otherwise("cross_day_mixed_outcome"))


def split_name(c: Column, prefixes: Sequence[str]) -> tuple[Column, Column]:
    """Day and metric of a ``{day}_{metric}`` name."""
    day, metric = F, F
    for p in prefixes:
        hit = c.startswith(f"{p}_")
        day, metric = day.when(hit, p), metric.when(hit, F.substring(c, len(p) + 2, 10_000))
    return day.otherwise(""), metric.otherwise(c)


def pairwise_table(df: DataFrame, cols: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Both correlations with p-values, strength and relationship, per pair."""
    pair = ["variable_1", "variable_2"]
    out = pearson_pairs(df, cols).join(spearman_pairs(df, cols).drop("n_pairwise"), pair)
    out = with_pvalue(out, "n_pairwise", "pearson_r", "pearson_p")
    out = with_pvalue(out, "n_pairwise", "spearman_r", "spearman_p")
    d1, m1 = split_name(F.col("variable_1"), prefixes)
    d2, m2 = split_name(F.col("variable_2"), prefixes)
    return (out.withColumn("abs_spearman_r", F.abs("spearman_r"))
            .withColumn("relationship", relationship(d1, m1, d2, m2))
            .select(*pair, "n_pairwise", "pearson_r", "pearson_p", "spearman_r", "spearman_p", "abs_spearman_r",
                    "relationship")
            .orderBy(F.col("abs_spearman_r").desc_nulls_last(), F.desc("n_pairwise"), *pair))


def correlation_matrix(pairs: DataFrame, cols: Sequence[str], r: str) -> DataFrame:
    """Symmetric wide matrix with a unit diagonal, one row per variable."""
    one_way = pairs.select("variable_1", "variable_2", r)
    other_way = pairs.select(F.col("variable_2").alias("variable_1"), F.col("variable_1").alias("variable_2"), r)
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], f"variable_1 string, variable_2 string, {r} double")
    return (one_way.unionByName(other_way).unionByName(diagonal)
            .groupBy(F.col("variable_1").alias("variable")).pivot("variable_2", list(cols)).agg(F.max(r)))


def strength_summary(pairs: DataFrame) -> DataFrame:
    """Strong, moderate and weaker pairs per relationship."""
    r = F.col("abs_spearman_r")
    return pairs.where(r.isNotNull()).groupBy("relationship").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(r >= 0.7).alias("n_strong"),
        F.count_if((r >= 0.4) & (r < 0.7)).alias("n_moderate"), F.count_if(r < 0.4).alias("n_weak"),
        F.max(r).alias("max_abs"))


def same_outcome_summary(pairs: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Across days, per metric: median and largest correlation, strongest pair."""
    _, metric = split_name(F.col("variable_1"), prefixes)
    rows = pairs.where((F.col("relationship") == "cross_day_same_outcome") & F.col("spearman_r").isNotNull())
    order = F.struct("abs_spearman_r", "n_pairwise", "variable_1", "variable_2")
    return rows.groupBy(metric.alias("metric")).agg(
        F.median("spearman_r").alias("median_r"), F.max("spearman_r").alias("max_r"),
        F.max_by(F.concat_ws(" vs ", "variable_1", "variable_2"), order).alias("strongest_pair"))


def group_pairs(pairs: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pairs with one side in each column group (or both in one group)."""
    a, b = F.col("variable_1"), F.col("variable_2")
    return pairs.where((a.isin(list(left)) & b.isin(list(right))) | (a.isin(list(right)) & b.isin(list(left))))


def same_day_pairs(pairs: DataFrame, prefixes: Sequence[str], first: str, second: str) -> DataFrame:
    """The pair (day_first, day_second) of every day."""
    names = [(f"{p}_{first}", f"{p}_{second}") for p in prefixes]
    pair = F.array_sort(F.array("variable_1", "variable_2"))
    return pairs.where(F.concat_ws("|", pair).isin(["|".join(sorted(n)) for n in names]))


def high_missing(described: DataFrame, n: int = 5, limit: float = 0.05) -> DataFrame:
    """Most incomplete columns above a missing rate."""
    return described.where(F.col("missing_rate") > limit).orderBy(F.desc("missing_rate"), "variable").limit(n)
