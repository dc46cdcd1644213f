"""Order-based building blocks that stay balanced on any distribution.

Ranks, running totals and exact quantiles need a global order.  A window over
a whole group would put that group into one task, so the order is cut into
buckets first: rows are ordered inside a bucket, and the small table of bucket
totals says where each bucket starts.

* hash order (seeded shuffles): the bucket is the head of the hash, so buckets
  are even whatever the group sizes are;
* value order: equal values are merged into one row first, so a value held by
  a third of all rows weighs nothing, and buckets of the distinct values come
  from approximate quantiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_DIGITS = 4  # 65,536 buckets per group
VALUE_BUCKETS = 512
SEARCH_STEPS = [256, 128, 64, 32, 16, 8, 4, 2, 1]  # binary search over < VALUE_BUCKETS boundaries
EXPLODE_BLOCK = 65_536


def hash_order(ids: Sequence[str], seed: int | str) -> Column:
    """Seeded pseudo-random order that depends on the row's key only."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def hash_unit(h: Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of a hash."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(2**52)


def _with_group(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group:
        return df, list(group)
    return df.withColumn("_g", F.lit(0)), ["_g"]


def few(df: DataFrame, few_groups: bool) -> DataFrame:
    """Broadcast a table with one row per group when the groups are few.

    Groups are columns, pairs of columns, targets, classes or salts: their
    number is set by the column list, not by the data.  Callers that group by
    data values pass ``few_groups=False`` and get an ordinary join.
    """
    return F.broadcast(df) if few_groups else df


def replicate(df: DataFrame, times: str, index: str, keys: Sequence[str]) -> DataFrame:
    """Copy every row ``times`` times, numbered from 1.

    Copies are made in blocks that are spread first, so a row with very many
    copies neither fills one array nor one task.
    """
    last = F.floor((F.col(times) - 1) / EXPLODE_BLOCK)
    blocks = df.where(F.col(times) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = blocks.repartition(*keys, "_block")
    first = F.col("_block") * EXPLODE_BLOCK + 1
    return blocks.withColumn(index, F.explode(F.sequence(
        first, F.least(first + EXPLODE_BLOCK - 1, F.col(times).cast("long"))))).drop("_block")


def bucket_starts(counts: DataFrame, group: list[str], bucket: Sequence[str | Column],
                  sums: Sequence[str]) -> DataFrame:
    """Add ``{s}_before`` and ``{s}_total`` to a table of bucket sums."""
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return counts.withColumns({
        **{f"{s}_before": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums},
        **{f"{s}_total": F.sum(s).over(whole) for s in sums}})


def cut_in_hash_order(df: DataFrame, group: Sequence[str], ids: Sequence[str], seed: int | str,
                      cuts: dict[str, Callable[[Column], Column]], total: str | None = None,
                      few_groups: bool = True) -> DataFrame:
    """Flag the first k rows of every group in seeded hash order.

    ``cuts`` maps a new boolean column to a function of the group's row count
    that gives k.  Only one hash value per (group, cut) travels to the rows, so
    wide rows are not shuffled when the groups are few (see ``few``).
    """
    df, g = _with_group(df, group)
    key = F.concat_ws("|", hash_order(ids, seed), *[F.col(c).cast("string") for c in ids])
    hashed = df.withColumn("_key", key).withColumn("_b", F.substring("_key", 1, HASH_BUCKET_DIGITS))
    keys = hashed.select(*g, "_key", "_b")

    counts = keys.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("n"))
    starts = bucket_starts(counts, g, ["_b"], ["n"])
    names = list(cuts)
    wanted = starts.select(
        *g, "_b", "n", "n_before", "n_total",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("cut"), cuts[c](F.col("n_total")).cast("long").alias("k"))
            for i, c in enumerate(names)])).alias("_c"),
    ).select(*g, "_b", "n", "n_before", "n_total", "_c.cut", "_c.k")
    wanted = wanted.where((F.col("k") > F.col("n_before")) & (F.col("k") <= F.col("n_before") + F.col("n")))

    inside = Window.partitionBy(*g, "cut").orderBy("_key")
    marks = (keys.join(few(wanted, few_groups), [*g, "_b"])
             .withColumn("_r", F.row_number().over(inside) + F.col("n_before"))
             .where(F.col("_r") == F.col("k"))
             .groupBy(*g)
             .agg(*[F.max(F.when(F.col("cut") == i, F.col("_key"))).alias(f"_mark{i}") for i in range(len(names))]))
    if total:
        sizes = starts.groupBy(*g).agg(F.max("n_total").alias(total))
        marks = sizes.join(marks, g, "left")
    out = hashed.join(few(marks, few_groups), g, "left")
    out = out.withColumns({c: F.coalesce(F.col("_key") <= F.col(f"_mark{i}"), F.lit(False)) for i, c in enumerate(names)})
    drop = ["_key", "_b", *[f"_mark{i}" for i in range(len(names))]]
    return out.drop(*drop, *([] if group else ["_g"]))


def value_bounds(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Up to 127 sorted boundary values per group, about equally many rows apart."""
    probs = ", ".join(f"{i / VALUE_BUCKETS}D" for i in range(1, VALUE_BUCKETS))
    bounds = F.expr(f"array_distinct(percentile_approx(`{value}`, array({probs}), {VALUE_BUCKETS * 8}))")
    return df.groupBy(*group).agg(bounds.alias("_bounds"))


def bucket_by_value(df: DataFrame, group: Sequence[str], value: str, bucket: str = "_b",
                    few_groups: bool = True) -> DataFrame:
    """Add the value bucket to a table of distinct values per group.

    The bucket is the number of boundaries below the value: a binary search
    whose steps refer to each other, which stays inside generated code.  The boundary
    table has one row per group, see ``few``.
    """
    bounds = value_bounds(df.where(F.col(value).isNotNull()), group, value)
    steps, at = [], "0"
    for i, step in enumerate(SEARCH_STEPS):
        steps.append(f"{at} + CASE WHEN get(_bounds, {at} + {step - 1}) < `{value}` THEN {step} ELSE 0 END AS _s{i}")
        at = f"_s{i}"
    out = df.join(few(bounds, few_groups), list(group)).selectExpr("*", *steps).withColumnRenamed(at, bucket)
    return out.drop("_bounds", *[f"_s{i}" for i in range(len(SEARCH_STEPS) - 1)])


def running_totals(df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[str | Column],
                   sums: dict[str, Column]) -> DataFrame:
    """Inclusive running totals of every group in the given order.

    ``bucket`` columns must agree with the order.  Adds ``name`` and
    ``{name}_total`` for every entry of ``sums``.
    """
    df, g = _with_group(df, group)
    bucket = list(bucket)
    parts = df.groupBy(*g, *bucket).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    starts = bucket_starts(parts, g, bucket, list(sums)).drop(*sums)
    w = Window.partitionBy(*g, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({n: F.sum(e).over(w) for n, e in sums.items()}).join(starts, [*g, *bucket])
    out = out.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop(*[f"{n}_before" for n in sums])
    return out if group else out.drop("_g")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                    out: str = "quantiles", few_groups: bool = True) -> DataFrame:
    """Linear-interpolated exact quantiles of the non-NULL values, as an array.

    Equal values are merged first (map side), so a hot value is one row.  Bucket
    counts then say which buckets hold the wanted ranks, and only the values of
    those buckets are ordered.
    """
    df, g = _with_group(df.where(F.col(value).isNotNull()), group)
    distinct = df.groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n"))
    keyed = bucket_by_value(distinct, g, value, few_groups=few_groups)
    counts = keyed.groupBy(*g, "_b").agg(F.sum("_n").alias("n"))
    starts = bucket_starts(counts, g, ["_b"], ["n"])
    ends: Callable[[Column], Column] = lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n"))
    pos = F.col("_p") * (F.col("n_total") - 1)
    wanted = (starts
              .select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
              .withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos)).withColumn("_frac", pos - F.floor(pos))
              .where(ends(F.col("_lo")) | ends(F.col("_hi"))))
    per_bucket = wanted.groupBy(*g, "_b").agg(
        F.max("n_before").alias("n_before"), F.collect_list(F.struct("_i", "_lo", "_hi", "_frac")).alias("_want"))
    w = Window.partitionBy(*g, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (keyed.join(few(per_bucket, few_groups), [*g, "_b"])
              .withColumn("_end", F.sum("_n").over(w))
              .withColumn("_end", F.col("_end") + F.col("n_before"))
              .withColumn("_start", F.col("_end") - F.col("_n"))
              .select(*g, value, "_start", "_end", F.explode("_want").alias("_w"))
              .select(*g, value, "_start", "_end", "_w.*"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_start")) & (F.col(r) < F.col("_end")), F.col(value)))
    picked = ranked.groupBy(*g, "_i").agg(at("_lo").alias("_vlo"), at("_hi").alias("_vhi"), F.max("_frac").alias("_frac"))
    picked = picked.withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    result = picked.groupBy(*g).agg(
        F.array(*[F.max(F.when(F.col("_i") == i, F.col("_q"))) for i in range(len(probs))]).alias(out))
    return result if group else result.drop("_g")


def average_ranks(df: DataFrame, group: Sequence[str], value: str, weight: Column | None = None,
                  rank: str = "rank") -> DataFrame:
    """One row per (group, distinct value): its count and tie-averaged rank."""
    df, g = _with_group(df, group)
    distinct = df.groupBy(*g, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    keyed = bucket_by_value(distinct, g, value)
    ranked = running_totals(keyed, g, ["_b"], [value], {"_end": F.col("n")})
    out = (ranked.withColumn(rank, F.col("_end") - (F.col("n") - 1) / 2.0)
           .withColumnRenamed("_end_total", "total").drop("_b", "_end"))
    return out if group else out.drop("_g")
