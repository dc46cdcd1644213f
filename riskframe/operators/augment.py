"""Rule-based augmentation, copy control and selection of synthetic rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalars import shift_clip
from riskframe.operators.ordering import bucket_by_value, cut_in_hash_order, replicate, running_totals
from riskframe.operators.profile import duplicates_per_parent, lineage_counts
from riskframe.operators.schema import META_PREFIX, align_union, round_binary_columns

IS_GENERATED, SPLIT = f"{META_PREFIX}is_generated", f"{META_PREFIX}dataset_split"
PARENT, RULE = f"{META_PREFIX}source_row_id", f"{META_PREFIX}generation_rule"
TRIGGER, VARIANT = f"{META_PREFIX}trigger_reason", f"{META_PREFIX}variant_name"
SCORE_SHIFT = f"{META_PREFIX}pain_shift"
AGE_DELTA, WEIGHT_DELTA = f"{META_PREFIX}age_delta", f"{META_PREFIX}weight_delta"
META_COLUMNS = [PARENT, IS_GENERATED, SPLIT, RULE, TRIGGER, SCORE_SHIFT, AGE_DELTA, WEIGHT_DELTA, VARIANT]


@dataclass(frozen=True)
class AugmentSpec:
    """Columns and thresholds of the augmentation rules."""

    sex: str
    age: str
    weight: str
    families: dict[str, list[str]]
    same_day: list[str]
    male_code: float = 1.0
    age_above: float = 60
    same_day_from: float = 3
    deltas: tuple[int, ...] = (-2, -1, 0, 1, 2)
    keep: int = 10
    wave_above: float = 4
    wave_count: int = 2
    lo: float | None = 0.0
    hi: float | None = None
    original_rule: str = "high_pain_original_jitter"
    shifted_rule: str = "high_pain_upshift_jitter"

    @property
    def scores(self) -> list[str]:
        return [c for cols in self.families.values() for c in cols]


def trigger_reason(spec: AugmentSpec) -> Column:
    """Why a row is augmented, NULL when it is not."""
    male = F.when(F.col(spec.sex) == spec.male_code, "male")
    older = F.when(F.col(spec.age) > spec.age_above, f"age_gt_{spec.age_above:g}")
    cols = [F.col(c) for c in spec.same_day]
    worst = F.greatest(*cols) if len(cols) > 1 else cols[0]
    who = F.concat_ws("|", male, older)
    reason = F.concat_ws("|", who, F.lit(f"same_day_pain_gte_{spec.same_day_from:g}"))
    return F.when((who != "") & (worst >= spec.same_day_from), reason)


def trigger_rows(df: DataFrame, spec: AugmentSpec) -> DataFrame:
    return df.withColumn(TRIGGER, trigger_reason(spec)).where(F.col(TRIGGER).isNotNull())


def _generated(df: DataFrame, spec: AugmentSpec, shifts: dict[str, Column], age: Column, weight: Column) -> DataFrame:
    """Shift scores and demographics and mark the rows as generated for training."""
    shifted = {c: shift_clip(F.col(c), d, spec.lo, spec.hi) for c, d in shifts.items()}
    return df.withColumns({
        **shifted, spec.age: F.col(spec.age) + age, spec.weight: F.col(spec.weight) + weight,
        IS_GENERATED: F.lit(1), SPLIT: F.lit("train"), AGE_DELTA: age, WEIGHT_DELTA: weight})


def jitter_variants(spec: AugmentSpec) -> list[tuple[int, int, int, str, str]]:
    """(shift, age delta, weight delta, rule, name) of every candidate but the identity."""
    out = []
    for a in spec.deltas:
        for w in spec.deltas:
            for shift, rule, tag in ((0, spec.original_rule, "orig"), (1, spec.shifted_rule, "upshift")):
                if (shift, a, w) != (0, 0, 0):
                    out.append((shift, a, w, rule, f"{tag}_age_{a:+d}_weight_{w:+d}"))
    return out


def jitter_candidates(df: DataFrame, spec: AugmentSpec, seed: int, id_col: str = PARENT) -> DataFrame:
    """``keep`` of the jittered variants of every triggered row.

    The choice is the head of the variants in the order of
    md5(parent | variant | seed): an array of each row, so nothing is shuffled.
    """
    variants = jitter_variants(spec)
    grid = F.expr("array(" + ", ".join(
        f"named_struct('h', md5(concat_ws('|', CAST(`{id_col}` AS STRING), '{name}', '{seed}')), 's', {s}, 'a', {a}, 'w', {w}, "
        f"'rule', '{rule}', 'name', '{name}')" for s, a, w, rule, name in variants) + ")")
    chosen = trigger_rows(df, spec).withColumn(
        "_v", F.explode(F.slice(F.array_sort(grid), 1, min(spec.keep, len(variants)))))
    out = _generated(chosen, spec, dict.fromkeys(spec.scores, F.col("_v.s")), F.col("_v.a"), F.col("_v.w"))
    return out.withColumns({RULE: F.col("_v.rule"), SCORE_SHIFT: F.col("_v.s"), VARIANT: F.col("_v.name")}).drop("_v")


def wave_rows(df: DataFrame, spec: AugmentSpec) -> DataFrame:
    """One copy up and one down per family with enough high scores."""
    families = []
    for name, cols in spec.families.items():
        high = sum([F.coalesce((F.col(c) > spec.wave_above).cast("int"), F.lit(0)) for c in cols], F.lit(0))
        reason = f"{name}_pain_{spec.wave_count}of{len(cols)}_gt_{spec.wave_above:g}"
        for step, way in ((1, "up"), (-1, "down")):
            families.append(F.when(high >= spec.wave_count, F.struct(
                F.lit(name).alias("family"), F.lit(step).alias("step"), F.lit(reason).alias("reason"),
                F.lit(f"{name}_wave_{way}").alias("rule"))))
    out = df.withColumn("_v", F.explode(F.filter(F.array(*families), lambda x: x.isNotNull())))
    shifts = {c: F.when(F.col("_v.family") == name, F.col("_v.step")).otherwise(0)
              for name, cols in spec.families.items() for c in cols}
    kept = {c: F.when(F.col("_v.family") == name, shift_clip(F.col(c), shifts[c], spec.lo, spec.hi)).otherwise(F.col(c))
            for name, cols in spec.families.items() for c in cols}
    out = _generated(out.withColumns(kept), spec, {}, F.lit(0), F.lit(0))
    return out.withColumns({RULE: F.col("_v.rule"), TRIGGER: F.col("_v.reason"), SCORE_SHIFT: F.col("_v.step"),
                            VARIANT: F.col("_v.rule")}).drop("_v")


def dedup_generated(generated: DataFrame, cols: Sequence[str], order: Sequence[str] = (PARENT, RULE, VARIANT)) -> DataFrame:
    """Of generated rows equal in ``cols`` the first in ``order`` stays.

    Written as an aggregate, so copies are merged before the shuffle and a
    heavily repeated row is no hot group.
    """
    rest = [c for c in generated.columns if c not in cols]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return generated.groupBy(*cols).agg(first).select(*cols, "_first.*").select(*generated.columns)


def assemble_augmented(train: DataFrame, generated: DataFrame, validation: DataFrame, test: DataFrame,
                       meta: Sequence[str] = META_COLUMNS) -> DataFrame:
    """Original and generated rows under one column order, provenance last."""
    columns = [c for c in train.columns if c not in meta] + list(meta)
    return align_union([train, generated, validation, test], columns)


def original_rows(df: DataFrame, split: str, id_col: str = "row_id") -> DataFrame:
    """Provenance of untouched rows."""
    same = F.lit("original")
    return df.withColumns({
        PARENT: F.col(id_col).cast("long"), IS_GENERATED: F.lit(0), SPLIT: F.lit(split), RULE: same, TRIGGER: same,
        SCORE_SHIFT: F.lit(0), AGE_DELTA: F.lit(0), WEIGHT_DELTA: F.lit(0), VARIANT: same})


def augmentation_summary(augmented: DataFrame) -> DataFrame:
    """Rows per part and generated rows, in one row."""
    gen = F.col(IS_GENERATED) == 1
    part = lambda s: F.count_if((F.col(SPLIT) == s) & ~gen)
    return augmented.agg(
        part("train").alias("train_original_rows"), part("validation").alias("validation_original_rows"),
        part("test").alias("test_original_rows"), F.count_if(gen).alias("generated_rows"),
        F.count(F.lit(1)).alias("final_rows"))


def augmentation_report(augmented: DataFrame) -> dict[str, DataFrame]:
    generated = augmented.where(F.col(IS_GENERATED) == 1)
    return {"summary": augmentation_summary(augmented), "lineage": lineage_counts(generated),
            "per_parent": duplicates_per_parent(generated)}


def unknown_parents(train: DataFrame, generated: DataFrame) -> DataFrame:
    return generated.select(PARENT).distinct().join(train.select(PARENT), PARENT, "left_anti")


def copy_control(train: DataFrame, reference_generated: DataFrame, validate: bool = True) -> DataFrame:
    """Each parent copied exactly as often as it was augmented."""
    counts = reference_generated.groupBy(PARENT).agg(F.count(F.lit(1)).alias("_n"))
    if validate:
        lost = unknown_parents(train, reference_generated).limit(10).collect()
        if lost:
            raise ValueError(f"parents not in the training part: {sorted(r[0] for r in lost)}")
    rest = [c for c in train.columns if c != PARENT]
    tie = F.xxhash64(*rest) if "row_id" not in rest else F.col("row_id")
    once = train.groupBy(PARENT).agg(F.min_by(F.struct(*rest), tie).alias("_r")).select(PARENT, "_r.*")
    copies = replicate(once.join(counts, PARENT), "_n", "_i", [PARENT])
    return copies.withColumns({
        IS_GENERATED: F.lit(1), SPLIT: F.lit("train"), RULE: F.lit("direct_duplicate"),
        TRIGGER: F.lit("matched_reference_augmentation_count"), SCORE_SHIFT: F.lit(0), AGE_DELTA: F.lit(0),
        WEIGHT_DELTA: F.lit(0), VARIANT: F.format_string("duplicate_%04d", F.col("_i"))}).drop("_n", "_i")


def synthetic_provenance(df: DataFrame, method: str, task: str, target: str, threshold: float) -> DataFrame:
    flag = (F.col(target) >= threshold).cast("long") if task == "classification" else F.lit(None).cast("long")
    return df.withColumns({
        IS_GENERATED: F.lit(1), SPLIT: F.lit("train"), PARENT: F.lit(-1).cast("long"),
        f"{META_PREFIX}augmentation_method": F.lit(method), f"{META_PREFIX}generation_task": F.lit(task),
        f"{META_PREFIX}target_column": F.lit(target), f"{META_PREFIX}target_threshold": F.lit(float(threshold)),
        f"{META_PREFIX}binary_target": flag})


def _take(df: DataFrame, k: int, id_cols: Sequence[str], seed: int) -> DataFrame:
    return cut_in_hash_order(df, [], id_cols, seed, {"_in": lambda n: F.least(F.lit(k), n)}).where("_in").drop("_in")


def _ceil_share(multiplier: float, n: int) -> int:
    return -int(-max(0.0, multiplier) * n // 1)


def highest_scoring(df: DataFrame, target: str, k: int, id_cols: Sequence[str], seed: int) -> DataFrame:
    """The k rows with the highest scores; the last score is filled in hash order.

    The cut-off score comes from the counts per distinct score, so no row is sorted.
    """
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).withColumn("_neg", -F.col(target))
    ranked = running_totals(bucket_by_value(counts.withColumn("_g", F.lit(0)), ["_g"], "_neg"), ["_g"], ["_b"],
                            ["_neg"], {"_cum": F.col("_n")})
    last = ranked.where(F.col("_cum") >= k).orderBy("_cum").limit(1).first()
    if last is None:
        return df
    rest = k - (last["_cum"] - last["_n"])
    edge = _take(df.where(F.col(target) == last[target]), rest, id_cols, seed)
    return df.where(F.col(target) > last[target]).unionByName(edge)


def select_synthetic(candidates: DataFrame, train: DataFrame, target: str, threshold: float, multiplier: float,
                     binary_cols: Sequence[str] = (), method: str = "external", id_cols: Sequence[str] = ("row_id",),
                     seed: int = 42) -> DataFrame:
    """ceil(multiplier x train positives) candidates that reach the threshold.

    When none does, the highest-scoring candidates are taken instead.
    """
    positives = train.agg(F.count_if(F.col(target) >= threshold)).first()[0]
    k = _ceil_share(multiplier, positives)
    usable = round_binary_columns(candidates, binary_cols).where(F.col(target).isNotNull())
    reaching = usable.where(F.col(target) >= threshold)
    if k == 0 or reaching.limit(1).count():
        chosen = _take(reaching, k, id_cols, seed)
    else:
        chosen = highest_scoring(usable, target, k, id_cols, seed)
    return synthetic_provenance(chosen, method, "classification", target, threshold)


def take_synthetic_regression(candidates: DataFrame, train: DataFrame, target: str, threshold: float,
                              multiplier: float, binary_cols: Sequence[str] = (), method: str = "external",
                              id_cols: Sequence[str] = ("row_id",), seed: int = 42) -> DataFrame:
    """ceil(multiplier x train rows) candidates, those with a target kept."""
    k = _ceil_share(multiplier, train.count())
    drawn = _take(round_binary_columns(candidates, binary_cols), k, id_cols, seed)
    return synthetic_provenance(drawn.where(F.col(target).isNotNull()), method, "regression", target, threshold)


def augment_training_part(train: DataFrame, spec: AugmentSpec, seed: int, keep_fraction: float = 1.0) -> DataFrame:
    """All generated rows of a training part: jitter and waves, without repeats."""
    from riskframe.operators.splits import sample_fraction
    generated = reduce(lambda a, b: a.unionByName(b), [jitter_candidates(train, spec, seed), wave_rows(train, spec)])
    values = [c for c in train.columns if c not in META_COLUMNS and c != "row_id"]
    unique = dedup_generated(generated, values)
    return sample_fraction(unique, keep_fraction, seed, [PARENT, VARIANT])
