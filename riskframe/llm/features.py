"""Sparse hashed text features and the follow-the-regularised-leader update, shared by the two trained operators.

A model is bounded by its 2^BITS hash buckets.  It is fitted on a bounded, documented sample of labelled rows, spread over
SHARDS tasks that each walk their part a few times; the fitted weights are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
SHARDS = 4
EPOCHS = 4
PASSED_ROWS = 500  # whole rows that are sent back together


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 penalties; a weight is read off its gradient sums."""

    def __init__(self, size: int, rate: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.rate, self.l1, self.l2 = rate, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((1.0 + np.sqrt(n)) / self.rate + self.l2))

    def update(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.rate * weights
        self.n[at] = more


def held_out(doc_id: Column) -> Column:
    """The rows no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """(text, y) of at most about ``most[class]`` labelled rows of each class, chosen by a hash of doc_id.

    The chosen label rows are few (the sum of ``most``), so they are broadcast and no text is shuffled.  Rows without
    doc_id or label give none; repeated labels count by their majority.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("y") == value) & (part < min(1.0, most.get(value, 0) / n)))
    return docs.select("doc_id", "text").join(F.broadcast(y.where(keep)), "doc_id").select("text", "y")


def fit(rows: DataFrame, train: Callable[[list], dict[int, float]], size: int) -> np.ndarray:
    """Weights averaged over the shards; ``rows`` has (y, at array<int>, value array<double>), ``train`` fits one shard.

    A long ``key`` of the rows deals them to the shards, where equal features would bring too many together.
    """

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.random.default_rng(11).permutation(len(rows))
        found = train([(rows["y"].iat[i], np.asarray(rows["at"].iat[i]), np.asarray(rows["value"].iat[i], dtype=float)) for i in order])
        return pd.DataFrame({"at": list(found), "w": list(found.values())}, columns=["at", "w"])

    spread = rows.withColumn("_shard", F.pmod(F.xxhash64(*(["key"] if "key" in rows.columns else ["at", "value"])), F.lit(SHARDS)))
    sums = spread.groupBy("_shard").applyInPandas(shard, "at int, w double").groupBy("at").agg(F.sum("w").alias("w"))
    out = np.zeros(size)
    for r in sums.collect():  # at most one row per bucket
        out[r["at"]] = r["w"] / SHARDS
    return out


def featurised(sample: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [features(t or "") for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "at": [p[0] for p in pairs], "value": [p[1] for p in pairs]})

    return sample.mapInPandas(run, "y int, at array<int>, value array<double>")


def scored(docs: DataFrame, scorer: Callable[[], Callable[[str], tuple[float, ...]]], columns: list[str]) -> DataFrame:
    """doc_id and the doubles that the scorer, made once per task, gives for each whole text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = scorer()
        for batch in batches:
            found = [score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[i] for f in found], pa.float64()) for i in range(len(columns))]], names=["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{c} double" for c in columns]]))


def passing(docs: DataFrame, scorer: Callable[[], Callable[[str], tuple[float, ...]]], least: float) -> DataFrame:
    """The rows, with all their columns, whose first score is ``least`` or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = scorer()
        for batch in batches:
            for i in range(0, batch.num_rows, PASSED_ROWS):
                part = batch.slice(i, PASSED_ROWS)
                yield part.filter(pa.array([score(t.as_py() or "")[0] >= least for t in part.column(at)], pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
