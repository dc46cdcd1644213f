"""Missingness, description, frequency, histogram and dose-level tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import scalars
from riskframe.operators.ordering import exact_quantiles
from riskframe.operators.schema import to_long

OTHER = "<OTHER>"
MISSING = "<NA>"


def _long_of_one_row(wide: DataFrame, names: Sequence[str], fields: dict[str, str], key: str) -> DataFrame:
    """Turn one wide aggregate row into one row per name."""
    rows = F.array(*[F.struct(F.lit(n).alias(key), *[F.col(f"`{p}{n}`").alias(f) for f, p in fields.items()])
                     for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count and ratio per column, in one pass, most missing first."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{c}") for c in cols])
    wide = wide.select("*", *[F.try_divide(F.col(f"`n_{c}`"), F.col("_rows")).alias(f"r_{c}") for c in cols])
    out = _long_of_one_row(wide, cols, {"missing_count": "n_", "missing_ratio": "r_"}, "variable")
    return out.orderBy(F.desc("missing_ratio"), F.desc("missing_count"), "variable")


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts, mean, sample deviation, exact median and IQR, range, per column."""
    long = to_long(df, [], cols)
    rows = F.count(F.lit(1))
    basic = long.groupBy("variable").agg(
        F.count("value").alias("n_non_missing"),
        (rows - F.count("value")).alias("n_missing"),
        ((rows - F.count("value")) / rows).alias("missing_rate"),
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75])
    return (basic.join(F.broadcast(q), "variable", "left")
            .select("variable", "n_non_missing", "n_missing", "missing_rate", "mean", "std",
                    F.get("quantiles", 1).alias("median"),
                    (F.get("quantiles", 2) - F.get("quantiles", 0)).alias("iqr"), "min", "max"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, count) over the text form of every column, NULL included."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = texts.unpivot([], list(cols), "variable", "value")
    clean = F.when(~F.col("value").isin("", "nan", "NaN"), F.col("value"))
    return long.withColumn("value", clean).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))


def fold_tail(counts: DataFrame, top_n: int = 30) -> DataFrame:
    """Keep the ``top_n`` most frequent values per variable, fold the rest."""
    w = Window.partitionBy("variable").orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    top = (counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n)
           .select("variable", F.coalesce("value", F.lit(MISSING)).alias("category"), "count"))
    kept = top.groupBy("variable").agg(F.sum("count").alias("_kept"))
    totals = counts.groupBy("variable").agg(F.sum("count").alias("_rows"))
    totals = totals.join(kept, "variable")
    rest = (totals.where(F.col("_rows") > F.col("_kept"))
            .select("variable", F.lit(OTHER).alias("category"), (F.col("_rows") - F.col("_kept")).alias("count")))
    return (top.unionByName(rest).join(F.broadcast(totals.select("variable", "_rows")), "variable")
            .select("variable", "category", "count", (F.col("count") / F.col("_rows")).alias("ratio")))


def frequency_table(df: DataFrame, cols: Sequence[str], top_n: int = 30) -> DataFrame:
    return fold_tail(value_counts(df, cols), top_n)


def in_table_order(freq: DataFrame) -> DataFrame:
    """Numeric order for variables whose categories are all numbers, else by count."""
    number = F.col("category").try_cast("double")
    numeric = F.count(number).over(Window.partitionBy("variable")) == F.count("category").over(
        Window.partitionBy("variable"))
    return (freq.withColumn("_num", F.when(numeric, number))
            .orderBy("variable", F.col("_num").asc_nulls_last(), F.desc("count"), "category").drop("_num"))


def histogram(df: DataFrame, cols: Sequence[str], max_bins: int = 30) -> DataFrame:
    """Equal-width bins per column; the last bin is closed; ratio over all rows."""
    long = to_long(df, [], cols)
    stats = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("value").alias("_n"),
        F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    stats = (stats.where(F.col("_n") > 0)
             .withColumn("_bins", F.least(F.lit(max_bins), F.greatest(F.lit(10), F.floor(F.sqrt("_n")).cast("int"))))
             .withColumn("_flat", F.col("_lo") == F.col("_hi"))
             .withColumn("_lo", F.when(F.col("_flat"), F.col("_lo") - 0.5).otherwise(F.col("_lo")))
             .withColumn("_hi", F.when(F.col("_flat"), F.col("_hi") + 0.5).otherwise(F.col("_hi")))
             .withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.col("_bins")).drop("_flat"))
    guess = F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")),
                    F.col("_bins") - 1)
    exact = (F.when(F.col("value") < F.col("_lo") + F.col("_g") * F.col("_w"), F.col("_g") - 1)
             .when((F.col("value") >= F.col("_lo") + (F.col("_g") + 1) * F.col("_w"))
                   & (F.col("_g") < F.col("_bins") - 1), F.col("_g") + 1)
             .otherwise(F.col("_g")))
    counts = (long.where(F.col("value").isNotNull()).join(F.broadcast(stats), "variable")
              .withColumn("_g", guess).withColumn("bin", exact.cast("int"))
              .groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("count")))
    frame = stats.select("*", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("bin"))
    right = F.when(F.col("bin") == F.col("_bins") - 1, F.col("_hi")).otherwise(
        F.col("_lo") + (F.col("bin") + 1) * F.col("_w"))
    return (frame.join(counts, ["variable", "bin"], "left")
            .select("variable", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_left"),
                    right.alias("bin_right"), F.coalesce("count", F.lit(0)).alias("count"),
                    (F.coalesce("count", F.lit(0)) / F.col("_rows")).alias("ratio")))


def grouped_flag_counts(df: DataFrame, prefix: str, order: Sequence[str] = (),
                        names: dict[str, str] | None = None) -> DataFrame:
    """Rows with a positive flag per column of a one-hot family.

    ``order`` lists the suffixes shown first; the others follow as they stand.
    """
    found = [c[len(prefix):] for c in df.columns if c.startswith(prefix)]
    suffixes = ([s for s in order if s in found] + [s for s in found if s not in order]) if order else sorted(found)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(scalars.to_double(F.col(f"`{prefix}{s}`")) > 0).alias(f"n_{s}") for s in suffixes])
    wide = wide.select("*", *[F.try_divide(F.col(f"`n_{s}`"), F.col("_rows")).alias(f"r_{s}") for s in suffixes],
                       *[F.lit(i).alias(f"p_{s}") for i, s in enumerate(suffixes)])
    out = _long_of_one_row(wide, suffixes, {"count": "n_", "ratio": "r_", "position": "p_"}, "category")
    return out.withColumn("category", scalars.map_label(F.col("category"), names or {}))


def domain_count(df: DataFrame, value: Column, lo: int, hi: int) -> DataFrame:
    """Counts over a fixed integer domain: absent values 0, values outside dropped."""
    counts = df.groupBy(value.cast("int").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    domain = rows.select("_rows", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("value"))
    return (domain.join(counts, "value", "left")
            .select("value", F.coalesce("count", F.lit(0)).alias("count"),
                    F.try_divide(F.coalesce("count", F.lit(0)), F.col("_rows")).alias("ratio")))


def dose_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per drug and non-zero level, over all rows and within the drug."""
    long = to_long(df, [], cols, "drug", "level")
    levels = long.groupBy("drug", "level").agg(F.count(F.lit(1)).alias("count"))
    totals = levels.groupBy("drug").agg(
        F.sum("count").alias("_rows"), F.sum(F.when(F.col("level") > 0, F.col("count"))).alias("_used"))
    return (levels.where(F.col("level") > 0).join(F.broadcast(totals), "drug")
            .select("drug", "level", "count", (F.col("count") / F.col("_rows")).alias("ratio_all_rows"),
                    (F.col("count") / F.col("_used")).alias("ratio_within_drug_nonzero")))


def level_column(level: float, unit: str = "mg") -> str:
    """Wide-table name of a level: up to four decimals, trailing zeros cut."""
    return f"dose_{level:.4f}".rstrip("0").rstrip(".") + f"{unit}_count"


def pivot_counts(df: DataFrame, index: Sequence[str], column: str, value: str,
                 levels: Sequence[float] | None = None, namer=level_column) -> DataFrame:
    """Zero-filled wide table, columns in level order.

    ``levels`` defaults to all levels present: a report has a few dozen.  ``df`` itself
    is the long form, the better one for many thousands.
    """
    if levels is None:
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct()
                  .orderBy(column).collect()]
    wide = df.groupBy(*index).pivot(column, list(levels)).agg(F.sum(value))
    names = wide.columns[len(index):]
    return wide.select(*index, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(namer(v)) for n, v in zip(names, levels)])


def row_share(df: DataFrame, index: Sequence[str], column: str, value: str) -> DataFrame:
    """Share of every count in its row; 0 in an empty row."""
    totals = df.groupBy(*index).agg(F.sum(value).alias("_sum"))
    share = F.when(F.col("_sum") > 0, F.col(value) / F.col("_sum")).otherwise(0.0)
    return df.join(totals, list(index)).select(*index, column, value, share.alias("share"))


def trend_by_day(df: DataFrame, day_columns: dict[str, str]) -> DataFrame:
    """Per day of one outcome: filled, missing, ratio, mean, exact median."""
    d = describe_columns(df, list(day_columns.values()))
    by_column = {c: day for day, c in day_columns.items()}
    return d.select(scalars.map_label(F.col("variable"), by_column).alias("day"),
                    F.col("variable").alias("column_name"), F.col("n_non_missing").alias("non_missing_count"),
                    F.col("n_missing").alias("missing_count"), F.col("missing_rate").alias("missing_ratio"),
                    "mean", "median")


def profile_table(df: DataFrame, cols: Sequence[str] | None = None, discrete_threshold: int = 20) -> DataFrame:
    """Manifest: histogram or bars per column, from one pass of value counts.

    A column is a histogram when it is numeric (by type, or 95 % of rows parse)
    and has more distinct numbers than the threshold.
    """
    cols = list(cols or df.columns)
    typed = [c for c, t in df.dtypes if c in cols and t.split("(")[0] in (
        "tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    number = scalars.to_double(F.col("value"))
    facts = value_counts(df, cols).withColumn("_num", number).groupBy("variable", "_num").agg(
        F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    facts = facts.groupBy("variable").agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_num").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_numeric"),
        F.count("_num").alias("n_distinct_numeric"))
    numeric = F.col("variable").isin(typed) | (F.col("n_numeric") / F.col("n_rows") >= 0.95)
    kind = F.when(numeric & (F.col("n_distinct_numeric") > discrete_threshold), "histogram").otherwise("bar")
    return facts.select("variable", "n_rows", "n_numeric", "n_distinct_numeric", kind.alias("analysis_type"))


def profile_tables(df: DataFrame, cols: Sequence[str] | None = None, top_n: int = 30, max_bins: int = 30) -> dict:
    """The manifest with its frequency tables and the histograms it asks for."""
    cols = list(cols or df.columns)
    manifest = profile_table(df, cols)
    wanted = [r["variable"] for r in manifest.where(F.col("analysis_type") == "histogram").collect()]
    return {"manifest": manifest, "frequency": frequency_table(df, cols, top_n),
            "histogram": histogram(df, wanted, max_bins) if wanted else None}


def error_by_true(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return pred.groupBy(F.col(y).alias("y_true")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mean_abs_error"))


def signed_error_histogram(pred: DataFrame, bins: int = 35, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Histogram of prediction minus truth with a fixed number of bins."""
    errors = pred.select((F.col(p) - F.col(y)).alias("error")).where(F.col("error").isNotNull())
    lo, hi = errors.agg(F.min("error"), F.max("error")).first()
    if lo is None:
        return errors.select(F.lit(0).alias("bin"), F.col("error").alias("bin_left"), F.lit(0).alias("count")).limit(0)
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    width = (hi - lo) / bins
    bin_of = F.least(F.floor((F.col("error") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = errors.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_left"),
        F.coalesce("count", F.lit(0)).alias("count"))


def top_features(importance: DataFrame, n: int = 20, names: dict[str, str] | None = None) -> DataFrame:
    """Largest importances with display names."""
    return (importance.orderBy(F.desc("importance"), "feature").limit(n)
            .withColumn("display_name", scalars.replace_tokens(F.col("feature"), names or {})))


def split_summary(splits: DataFrame) -> DataFrame:
    """Sizes and positives of every target's split."""
    part = lambda name: F.col("split") == name
    positive = F.col("y_binary") == 1
    return splits.groupBy("target", "split_seed").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(positive).alias("n_positive"),
        F.avg(F.when(F.col("y_binary").isNotNull(), positive.cast("double"))).alias("positive_rate"),
        *[F.count_if(part(s)).alias(f"{s}_size") for s in ("train", "validation", "test")],
        *[F.count_if(part(s) & positive).alias(f"{s}_positive") for s in ("train", "validation", "test")])


def lineage_counts(generated: DataFrame, rule: str = "__meta_generation_rule",
                   parent: str = "__meta_source_row_id") -> DataFrame:
    """Generated rows and distinct parents per rule (parents merged before counting)."""
    per_parent = generated.groupBy(rule, parent).agg(F.count(F.lit(1)).alias("_n"))
    return per_parent.groupBy(F.col(rule).alias("rule")).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("parents"))


def duplicates_per_parent(generated: DataFrame, parent: str = "__meta_source_row_id") -> DataFrame:
    """Smallest, largest and mean number of generated rows per parent."""
    counts = generated.groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.min("n"), F.lit(0)).alias("min"),
                      F.coalesce(F.max("n"), F.lit(0)).alias("max"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"))
