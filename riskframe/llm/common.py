"""What several operators share: words, stored tables, text keys, bounded broadcasts, global orders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import shared_folder

BETWEEN = r"[\x20\x09-\x0D]+"  # fixed value of the query contracts: what is in no word
BROADCAST_ROWS = 100_000  # a table is broadcast only after it was counted and has no more rows
BROADCAST_BYTES = 2**20  # of files that Spark may broadcast by its own guess; a table well coded in files is ten times as large in memory
GUESSES = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
SALTS = 32


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none.  Cutting between words is several times faster than matching them."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        t.stored_at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(t.stored_at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast; Spark's guess at its size, from files and column types, misses what unfolds or is coded short."""
    return df.hint("merge")


def bounded(df: DataFrame) -> DataFrame:
    """A stored side of a join: broadcast if a count shows at most BROADCAST_ROWS rows, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else shuffled(df)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What runs inside is broadcast by Spark's own guess up to BROADCAST_BYTES only; a lower limit of the session stays."""
    before = {name: spark.conf.get(name, None) for name in GUESSES}  # None where the session names no limit; the first has one nevertheless
    for name, limit in {**before, GUESSES[0]: spark.conf.get(GUESSES[0])}.items():
        if limit is not None:
            number, unit = re.match(r"(-?\d+)\s*([kmgtp]?)", limit.lower()).groups()
            spark.conf.set(name, min(int(number) * 1024 ** " kmgtp".index(unit or " "), BROADCAST_BYTES))
    try:
        yield
    finally:
        for name, limit in before.items():
            spark.conf.unset(name) if limit is None else spark.conf.set(name, limit)


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys`` (distinct, stored); no shuffle if a count shows that they are few."""
    return df.join(bounded(keys), key, "left_semi")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def attach(df: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that has one row per key, null keys included.

    It is broadcast only if a count shows at most BROADCAST_ROWS rows; a larger one is
    joined on (key, salt), so that a key with a third of all rows meets it in many tasks.
    """
    names = [c for c in dimension.columns if c not in keys]
    right = dimension.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *names)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    if dimension.count() <= BROADCAST_ROWS:
        out = df.join(F.broadcast(right), on, how)
    else:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")]), F.lit(SALTS)))
        right = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = salted.join(shuffled(right), on & (F.col("_salt") == F.col("_rsalt")), how).drop("_salt", "_rsalt")
    return out.drop(*[f"_r_{k}" for k in keys])


def globally_ordered(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add ``place`` (from 1) and inclusive running sums in a global order, without one task for all rows.

    The order is cut into ranges once and stored; only the totals of the ranges are accumulated together.
    ``sums`` maps a new column to the summed one.
    """
    ranges = max(1, df.sparkSession.sparkContext.defaultParallelism)
    cut = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_place"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in ("place", *sums)])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({"place": F.row_number().over(inside), **{n: F.sum(c).over(inside) for n, c in sums.items()}})
    out = out.join(F.broadcast(starts), "_range")  # one row per range
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in ("place", *sums)}).drop("_range", *[f"_{n}" for n in ("place", *sums)])
