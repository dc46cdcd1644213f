"""Reproducible splits and samples, ordered by a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalars import binarize, half_even
from riskframe.operators.ordering import cut_in_hash_order, hash_order, hash_unit, running_totals

SHARED_TARGET = "__shared_backbone__"
CELLS = 65_536  # unit cells handled by one block of a resample


def check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError(f"ratios must add up to 1, got {sum(ratios)}")
    if min(ratios) <= 0:
        raise ValueError("all ratios must be positive")


def holdout_counts(n: Column, ratios: Sequence[float]) -> tuple[Column, Column]:
    """Test and validation rows of a class with n rows.

    Half-even rounding and at least one row each; below three rows only a test
    row is set aside, and only when there are two; when both would use up the
    class each gets one.
    """
    test = F.greatest(F.lit(1), half_even(n * ratios[2]))
    val = F.greatest(F.lit(1), half_even(n * ratios[1]))
    full = test + val >= n
    few = n < 3
    test = F.when(few, F.when(n >= 2, 1).otherwise(0)).when(full, 1).otherwise(test)
    val = F.when(few, 0).when(full, 1).otherwise(val)
    return test, val


def _label(out: DataFrame, test: str, held: str) -> DataFrame:
    return out.withColumn(
        "split", F.when(F.col(test), "test").when(F.col(held), "validation").otherwise("train")).drop(test, held)


def stratified_split(long: DataFrame, seed: int, ratios: Sequence[float] = (0.8, 0.1, 0.1),
                     group: Sequence[str] = ("target",), id_col: str = "row_id", y: str = "y_binary") -> DataFrame:
    """Train, validation and test per target and class, exact sizes."""
    check_ratios(ratios)
    out = cut_in_hash_order(long, [*group, y], [id_col], seed, {
        "_test": lambda n: holdout_counts(n, ratios)[0],
        "_held": lambda n: sum(holdout_counts(n, ratios))})
    return _label(out, "_test", "_held")


def reference_splits(long: DataFrame, dim: DataFrame, seed: int,
                     ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Split table of (row_id, target, value) rows; rows without a value drop out.

    ``dim`` gives target_en, target_tier and positive_min per target.
    """
    rows = (long.where(F.col("value").isNotNull()).join(F.broadcast(dim), "target")
            .withColumn("y_binary", binarize(F.col("value"), F.col("positive_min")).cast("long")))
    split = stratified_split(rows, seed, ratios)
    return split.select("row_id", "target", "target_en", "target_tier", F.lit(seed).cast("long").alias("split_seed"),
                        "split", F.col("value").alias("y_value"), "y_binary", "positive_min")


def shared_split(long: DataFrame, seed: int, ratios: Sequence[float] = (0.8, 0.1, 0.1), max_tries: int = 5000,
                 min_positive: int = 3, batch: int = 1) -> DataFrame:
    """One split of all rows that leaves every target positives in each part.

    ``long`` has (row_id, target, y_binary) with NULL for unknown labels; rows
    without any label drop out.  A try is one salt of the hash.  The tries of a
    batch run in one job, and batches grow because on large data the first
    salt nearly always passes.
    """
    check_ratios(ratios)
    labelled = long.where(F.col("y_binary").isNotNull())
    rows = labelled.groupBy("row_id").agg(
        F.collect_set(F.when(F.col("y_binary") == 1, F.col("target"))).alias("_positive"))
    counts = {r["target"]: r["n"] for r in labelled.groupBy("target").agg(
        F.count_if(F.col("y_binary") == 1).alias("n")).collect()}
    needed = [t for t, n in counts.items() if n >= min_positive]
    first = 0
    while first < max_tries:
        last = min(first + batch, max_tries)
        tried = shared_cut(rows.withColumn("_salt", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))),
                           seed, ratios)
        seen = (tried.select("_salt", "split", F.explode("_positive").alias("target")).where(F.col("target").isin(needed))
                .groupBy("_salt", "split", "target").agg(F.count(F.lit(1)).alias("n")))
        covered = seen.groupBy("_salt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 3 * len(needed))
        passed = covered.agg(F.min("_salt")).first()[0] if needed else first
        if passed is not None:
            chosen = shared_cut(rows.withColumn("_salt", F.lit(passed)), seed, ratios)
            return chosen.select("row_id", F.lit(SHARED_TARGET).alias("target"),
                                 F.lit(seed).cast("long").alias("split_seed"), "split",
                                 F.lit(passed).alias("salt"))
        first, batch = last, min(batch * 4, 64)
    raise ValueError(f"no shared split found in {max_tries} tries")


def shared_cut(rows: DataFrame, seed: int, ratios: Sequence[float]) -> DataFrame:
    """Cut all rows at the holdout sizes, for every salt."""
    size = lambda n, r: F.greatest(F.lit(1), half_even(n * r))
    salted = rows.withColumn("_sid", F.concat_ws("#", F.col("row_id").cast("string"), F.col("_salt").cast("string")))
    out = cut_in_hash_order(salted, ["_salt"], ["_sid"], seed, {
        "_test": lambda n: size(n, ratios[2]), "_held": lambda n: size(n, ratios[2]) + size(n, ratios[1])})
    return _label(out, "_test", "_held").drop("_sid")


def missing_from_split(df: DataFrame, splits: DataFrame, target: str, seed: int) -> DataFrame:
    """Rows the split table does not know."""
    known = splits.where((F.col("target") == target) & (F.col("split_seed") == seed)).select("row_id")
    return df.join(known, "row_id", "left_anti")


def apply_split(df: DataFrame, splits: DataFrame, target: str, seed: int, validate: bool = True) -> DataFrame:
    """Add the split of every row; unknown rows and empty parts are errors."""
    part = splits.where((F.col("target") == target) & (F.col("split_seed") == seed)).select("row_id", "split")
    if validate:
        lost = missing_from_split(df, splits, target, seed).select("row_id").limit(11).collect()
        if lost:
            raise ValueError(f"rows without a split: {[r['row_id'] for r in lost[:10]]}")
    out = df.join(part, "row_id", "left")
    if validate:
        seen = {r["split"] for r in out.select("split").distinct().collect()}
        if not {"train", "test"} <= seen:
            raise ValueError(f"split has no train or no test rows: {sorted(seen)}")
    return out


def random_split(df: DataFrame, val: float, test: float, seed: int, id_col: str = "row_id", group: Sequence[str] = ()) -> DataFrame:
    """Unstratified split of every group with exact sizes, held-out rows rounded up.

    The held-out share is cut first, the test share of it second.
    """
    if val < 0 or test < 0 or not 0 < val + test < 1:
        raise ValueError("validation + test must lie in (0, 1)")
    held = lambda n: F.ceil(F.round(n * (val + test), 9))
    n_test = lambda n: F.ceil(F.round(held(n) * (test / (val + test)), 9))
    out = cut_in_hash_order(df, group, [id_col], seed, {"_held": held, "_test": n_test})
    return _label(out, "_test", "_held")


def stratified_two_way(df: DataFrame, y: str, size: float, seed: int, id_col: str = "row_id",
                       group: Sequence[str] = (), out: str = "held_out") -> DataFrame:
    """Held-out flag with at least one and at most n - 1 rows of each class."""
    if not 0 <= size < 1:
        raise ValueError("size must lie in [0, 1)")
    if size == 0:
        return df.withColumn(out, F.lit(False))
    k = lambda n: F.least(F.greatest(F.lit(1), half_even(n * size)), n - 1)
    return cut_in_hash_order(df, [*group, y], [id_col], seed, {out: k})


def multitask_two_way(rows: DataFrame, targets: Sequence[str], size: float, seed: int, id_col: str = "row_id",
                      max_tries: int = 128, need_test_labels: bool = True) -> DataFrame:
    """Held-out flag such that every 0/1 head keeps two classes in train.

    With ``need_test_labels`` every head also needs a labelled held-out row and
    failure is an error; without it failure means "no validation part".
    """
    if size == 0:
        return rows.withColumn("held_out", F.lit(False))
    k = lambda n: F.least(F.greatest(F.lit(1), half_even(n * size)), n - 1)
    for attempt in range(max_tries):
        cut = cut_in_hash_order(rows, [], [id_col], f"{seed}#{attempt}", {"held_out": k})
        train = ~F.col("held_out")
        checks = []
        for t in targets:
            checks += [F.count_if(train & (F.col(t) == 1)) > 0, F.count_if(train & (F.col(t) == 0)) > 0]
            if need_test_labels:
                checks.append(F.count_if(~train & F.col(t).isNotNull()) > 0)
        if all(cut.agg(*[c.alias(str(i)) for i, c in enumerate(checks)]).first()):
            return cut
    if need_test_labels:
        raise ValueError("no valid train/test split for all heads")
    return rows.withColumn("held_out", F.lit(False))


def resolve_split(df: DataFrame, target: str, seed: int, splits: DataFrame | None = None,
                  split_col: str = "__meta_dataset_split", val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Split by an explicit column if it names a test part, else by table, else at random."""
    if split_col in df.columns and df.where(F.col(split_col) == "test").limit(1).count():
        named = F.col(split_col)
        return df.withColumn("split", F.when(named.isin("test", "validation"), named).otherwise("train"))
    if splits is not None:
        return apply_split(df, splits, target, seed)
    return random_split(df, val, test, seed)


def balanced_training_pool(train: DataFrame, seed: int, id_col: str = "row_id",
                           generated: str = "__meta_is_generated",
                           parent: str = "__meta_source_row_id") -> tuple[DataFrame, DataFrame]:
    """Untouched originals plus an equal-size sample of the augmented side.

    The augmented side is every generated row and every original with generated
    children.  When either side is empty all rows stay.  Also returns one row of
    counts.
    """
    is_gen = F.coalesce(F.col(generated), F.lit(0)) == 1
    made, originals = train.where(is_gen), train.where(~is_gen)
    # only originals look up their children: generated rows may all share one parent id
    parents = made.select(F.coalesce(F.col(parent), F.lit(-1)).alias("_parent")).distinct().withColumn("_has", F.lit(True))
    looked_up = originals.withColumn("_parent", F.coalesce(F.col(parent), F.lit(-1))).join(parents, "_parent", "left")
    side = F.when(F.col("_has"), "augmented").otherwise("untouched")
    tagged = looked_up.withColumn("_side", side).drop("_parent", "_has").unionByName(
        made.withColumn("_side", F.lit("augmented")))
    sizes = tagged.groupBy("_side").count().collect()
    n = {"untouched": 0, "augmented": 0, **{r["_side"]: r["count"] for r in sizes}}
    limit = min(n.values()) or max(n.values())
    keep = F.when(F.col("_side") == "untouched", n["untouched"]).otherwise(limit)
    cut = cut_in_hash_order(tagged.withColumn("_limit", keep), ["_side", "_limit"], [id_col], seed,
                            {"_in": lambda total: F.least(F.col("_limit"), total)})
    selected = cut.where("_in")
    counts = cut.agg(
        F.lit(n["untouched"]).cast("long").alias("untouched_available"),
        F.lit(n["augmented"]).cast("long").alias("augmented_pool_available"),
        F.count_if(F.col("_in") & (F.col("_side") == "untouched")).alias("untouched_selected"),
        F.count_if(F.col("_in") & (F.col("_side") == "augmented") & ~is_gen).alias("augmented_original_selected"),
        F.count_if(F.col("_in") & is_gen).alias("generated_selected"),
        F.count_if(F.col("_in")).alias("selected_total"))
    return selected.select(*train.columns), counts


def sample_fraction(df: DataFrame, fraction: float, seed: int, id_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Exactly max(1, round(n * fraction)) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    if fraction == 1:
        return df
    k = lambda n: F.least(F.greatest(F.lit(1), half_even(n * fraction)), n)
    return cut_in_hash_order(df, [], id_cols, seed, {"_in": k}).where("_in").drop("_in")


def kfold(df: DataFrame, k: int, seed: int, id_col: str = "row_id", out: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1 whose sizes differ by at most one, larger ones first."""
    cut_at = lambda i: (lambda n: F.floor(n / k) * i + F.least(n % k, F.lit(i)))
    names = {f"_f{i}": cut_at(i) for i in range(1, k)}
    cut = cut_in_hash_order(df, [], [id_col], seed, names)
    fold = sum([(~F.col(c)).cast("int") for c in names], F.lit(0))
    return cut.withColumn(out, fold).drop(*names)


def weighted_resample(df: DataFrame, weight: str, seed: int, id_col: str = "row_id") -> DataFrame:
    """n draws with replacement, each row with probability proportional to weight.

    Every row owns an interval of [0, n) as long as its share of the weight and
    every draw is a hashed point in it.  Rows and draws meet on the unit cell of
    the point, so a heavy row spreads over many cells and none is hot.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    # decimal sums are exact, so neighbouring intervals share their end point
    ordered = df.withColumn("_h", hash_order([id_col], f"{seed}#row")).withColumns({
        "_b": F.substring("_h", 1, 4), "_w": w.cast("decimal(28,10)")})
    placed = running_totals(ordered, [], ["_b"], ["_h", id_col], {"_cum": F.col("_w"), "_rn": F.lit(1)})
    n, total = F.col("_rn_total"), F.col("_cum_total")
    point = lambda weight_sum, rank: F.when(
        total > 0, weight_sum.cast("double") / total.cast("double") * n).otherwise(rank.cast("double"))
    placed = placed.withColumns({
        "_lo": point(F.col("_cum") - F.col("_w"), F.col("_rn") - 1), "_hi": point(F.col("_cum"), F.col("_rn"))})
    draws = placed.select(
        (F.col("_rn") - 1).alias("draw"),
        (hash_unit(F.md5(F.concat_ws("|", F.col("_rn").cast("string"), F.lit(f"{seed}#draw")))) * n).alias("_u")
    ).withColumn("_cell", F.floor("_u"))
    blocks = placed.where(F.col("_hi") > F.col("_lo")).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_lo") / CELLS), F.floor(F.col("_hi") / CELLS))))
    cells = blocks.repartition("_block").withColumn("_cell", F.explode(F.sequence(
        F.greatest(F.floor("_lo"), F.col("_block") * CELLS),
        F.least(F.floor("_hi"), F.col("_block") * CELLS + CELLS - 1))))
    met = cells.join(draws, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return met.select(*df.columns, "draw")
