"""Registration of queries and the tables they derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TYPES = ["click", "view", "purchase", "signup", "error"]
WEEKS = ["w0", "w1", "w2", "w3"]
MATRIX = [f"{w}_{t}" for w in WEEKS for t in TYPES]
SCORES = {"view": 60.0, "click": 60.0, "purchase": 50.0, "signup": 50.0, "error": 40.0}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def week(ts):
    return F.least(F.lit(3), F.floor(F.datediff(ts, F.lit("2024-01-01").cast("date")) / 7)).cast("int")


def outcome_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Worst value per user, week and event type, NULL without such events.

    Conditional maxima in one aggregation: a single shuffle, combined before it.
    """
    e = table(spark, sf, "events").select("user_id", "event_type", "value", week(F.col("ts")).alias("week"))
    cols = [F.max(F.when((F.col("week") == i) & (F.col("event_type") == t), F.col("value"))).alias(f"{w}_{t}")
            for i, w in enumerate(WEEKS) for t in TYPES]
    return e.groupBy(F.col("user_id").alias("row_id")).agg(*cols)


_cells = ",\n".join(
    f"max(CASE WHEN week = {i} AND event_type = '{t}' THEN value END) AS {w}_{t}"
    for i, w in enumerate(WEEKS) for t in TYPES)
MATRIX_CTE = f"""matrix AS (
  SELECT user_id AS row_id, {_cells}
  FROM (SELECT user_id, event_type, value,
               least(3, floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0))::INT AS week FROM events)
  GROUP BY user_id),
long AS (SELECT row_id, variable, value FROM matrix UNPIVOT INCLUDE NULLS (value FOR variable IN ({', '.join(MATRIX)})))"""
