"""Reading and writing tables and documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import shared_folder

STRETCH_BROADCAST = 200_000  # rows of a path and four numbers

# Words that stand for a missing value in a CSV file.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                 "NULL", "NaN", "None", "n/a", "nan", "null")

BAD_CHARACTER = "\ufffd"
PLAIN_CHARSETS = ("iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32")


def _read_csv(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    if encoding.lower() not in PLAIN_CHARSETS:
        # Spark reads the other charsets of the JVM only with this setting
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, header=True, encoding=encoding, multiLine=multi_line, escape='"', inferSchema=False)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df


def _has_bad_text(df: DataFrame) -> bool:
    if any(BAD_CHARACTER in c for c in df.columns):
        return True
    bad = reduce(lambda a, b: a | b, [F.col(f"`{c}`").contains(BAD_CHARACTER) for c in df.columns], F.lit(False))
    return df.where(bad).limit(1).count() > 0


def _has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line break lies inside quotes: then some line has an odd number of them."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_table(spark: SparkSession, path: str, encodings: Sequence[str] = ("utf-8", "gbk"), multi_line: bool | None = None,
               missing: Sequence[str] = MISSING_WORDS) -> DataFrame:
    """Table of texts from CSV; the first encoding that decodes every value wins.

    Spark marks undecodable bytes instead of failing, so a marked value means
    "try the next encoding".  Values equal to a word of ``missing`` become NULL.
    A file with line breaks inside quotes has to be read as a whole; by default
    one pass over the lines finds out, so that all other files are split.  A
    folder of parquet files is read as it is.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    wide = any(e.lower().startswith(("utf-16", "utf-32")) for e in encodings)
    if multi_line is None:
        multi_line = wide or _has_open_quotes(spark, path)
    for encoding in encodings:
        df = _read_csv(spark, path, encoding, multi_line)
        if not _has_bad_text(df):
            return _without_words(df, missing)
    raise ValueError(f"cannot decode {path} as any of {list(encodings)}")


def _without_words(df: DataFrame, missing: Sequence[str]) -> DataFrame:
    if not missing:
        return df
    values = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*[F.when(~v.isin(list(missing)), v).alias(c) for c, v in zip(df.columns, values)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Store a table; split tables are usually partitioned by seed and target."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON document per row; a metric frame has one row."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive row numbers from 0 in file order, fixed once at ingest.

    For a frame read straight from files.  Files count in the order of their
    paths, so a table written in order by Spark keeps its order.  A first pass
    counts the rows of every stretch of a file that one task reads at a time;
    the stretches are added up inside their file, then the files.  Rows only
    look up the start of their stretch: nothing wide is shuffled while there
    are at most ``STRETCH_BROADCAST`` stretches.  A scan that splits the files
    otherwise in the second pass fails instead of numbering wrongly.  Store the
    result; later reads must not number again.
    """
    shared_folder(df.sparkSession)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    seen = F.monotonically_increasing_id().alias("_seen")
    sizes = df.select(*at, seen).groupBy("_file", "_start").agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    sizes = sizes.checkpoint()
    before = lambda *group: Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    # one row per file, in one task
    files = files.select("_file", F.coalesce(F.sum("_rows").over(before().orderBy("_file")), F.lit(0)).alias("_above"))
    inside = F.coalesce(F.sum("_n").over(before("_file").orderBy("_start")), F.lit(0))
    starts = sizes.withColumn("_before", inside).join(files, "_file")
    starts = starts.select("_file", "_start", "_first", "_n", (F.col("_above") + F.col("_before")).alias("_offset"))
    if sizes.count() <= STRETCH_BROADCAST:
        starts = F.broadcast(starts)
    place = F.col("_seen") - F.col("_first")
    moved = F.raise_error(F.lit("the files were split otherwise in the second pass")).cast("long")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_offset") + place).otherwise(moved)
    return df.select("*", *at, seen).join(starts, ["_file", "_start"], "left").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


