"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades 0 (not toxic) to 3 share one weight vector; ordered thresholds t1 < t2 < t3 say P(grade >= k) = sigmoid(w.x - tk),
and the output is the expected severity, the sum of these three probabilities.  Features are the distinct words of a text,
lower-cased and stripped of signs at their ends, and their prefixes of 3 to 7 characters, hashed into 2^18 buckets; a
feature's value is the number of distinct words that have it.

The labels say only toxic or not.  The grade of a toxic training text is the number of its words that occur with toxic
labels alone (in at least MARKED_IN training texts of the whole sample): up to 2, up to 5, more.

Scale: labels are learnt from at most TRAIN_DOCS rows of each class (a parameter), never from the held-out fold; scoring is
one pass without a shuffle, a word's weight being looked up once per task.

Nulls and other cases: a null or empty text has no features and gets the severity of the thresholds alone; rows without
label or doc_id teach nothing; without any labels every severity is 0; equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import features
from riskframe.llm.common import stored

TRAIN_DOCS = {0: 8_000, 1: 6_000}
GRADES = 4
MARKED_IN, TELLING, EPOCHS = 3, 5, 10
EDGES = ".,;:!?|()[]{}\"'*#$%&<>-_"
SEVERE = 0.25  # expected severity from which a text counts as toxic


def word_features(word: str) -> list[int]:
    word = word.lower().strip(EDGES)
    if not word:
        return []
    parts = ["w" + word] + [f"{n}" + word[:n] for n in range(3, 8) if len(word) >= n]
    return [crc32(p.encode("utf-8", "replace")) >> (32 - features.BITS) for p in parts]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    at = [i for w in set(text.split()) for i in word_features(w)]
    found, counts = np.unique(np.asarray(at, dtype=np.int64), return_counts=True)
    return found, counts.astype(float)


def marked_words(text: str) -> list[int]:
    """Buckets of a text's distinct words, which its grade is counted in."""
    return sorted({word_features(w)[0] for w in set(text.split()) if w.strip(EDGES)})


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    """Toxic and clean texts of the whole sample per bucket: at most 2^18 rows."""
    return rows.select("y", F.explode(column).alias("i")).groupBy("i").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))


def graded(sample: DataFrame) -> DataFrame:
    """(y, at, value, key) with grades instead of labels, and only with telling features; counts are over the whole sample.

    A feature tells if MARKED_IN toxic texts or more have it and their share is TELLING times that of the clean texts; the
    others would add noise of thousands of terms to every sum.  A word marks if MARKED_IN toxic texts or more and no clean
    one have it: the number of a toxic text's marking words is its grade.  ``key`` is a hash of all features, as most clean
    texts have no telling one.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            pairs = [text_features(t) for t in texts]
            yield pd.DataFrame({"y": batch["y"], "at": [p[0] for p in pairs], "value": [p[1] for p in pairs], "words": [marked_words(t) for t in texts]})

    rows = stored(sample.mapInPandas(take, "y int, at array<int>, value array<double>, words array<int>").withColumn("key", F.xxhash64("at", "value")), "toxicity-sample")
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    enough = F.col("toxic") >= MARKED_IN
    share = F.col("toxic") / F.lit(max(1, size.get(1, 0))) >= TELLING * (F.col("clean") + 0.5) / F.lit(max(1, size.get(0, 0)))
    telling = {r["i"] for r in class_counts(rows, "at").where(enough & share).select("i").collect()}
    marking = {r["i"] for r in class_counts(rows, "words").where(enough & (F.col("clean") == 0)).select("i").collect()}

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [np.array([i in telling for i in at], dtype=bool) for at in batch["at"]]
            marks = [sum(i in marking for i in words) for words in batch["words"]]
            yield pd.DataFrame({"y": [(1 if n <= 2 else 2 if n <= 5 else 3) if y else 0 for y, n in zip(batch["y"], marks)],
                                "at": [at[k] for at, k in zip(batch["at"], keep)], "value": [v[k] for v, k in zip(batch["value"], keep)], "key": batch["key"]})

    return rows.mapInPandas(grade, "y int, at array<int>, value array<double>, key long")


def train_shard(rows: list) -> dict[int, float]:
    size = 2**features.BITS
    model = features.Ftrl(size, rate=0.3, l1=0.1, l2=0.05)
    cuts, sigmoid = np.array([2.5, 3.5, 4.5]), lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    for _ in range(EPOCHS):
        for y, at, value in rows:
            w = model.weights(at)
            s = float(w @ value)
            below = sigmoid(cuts[y - 1] - s) if y else 0.0  # P(grade < y)
            upto = sigmoid(cuts[y] - s) if y < GRADES - 1 else 1.0  # P(grade <= y)
            p = max(upto - below, 1e-6)
            model.update(at, w, (1 - upto - below) * value)
            if y < GRADES - 1:
                cuts[y] += 0.01 * upto * (1 - upto) / p
            if y:
                cuts[y - 1] -= 0.01 * below * (1 - below) / p
            cuts[1], cuts[2] = max(cuts[1], cuts[0] + 0.1), max(cuts[2], max(cuts[1], cuts[0] + 0.1) + 0.1)
    w = model.weights()
    return {int(i): float(w[i]) for i in np.flatnonzero(w)} | {size + k: float(c) for k, c in enumerate(cuts)}


def fit(docs: DataFrame, labels: DataFrame, train_docs: dict[int, int] = TRAIN_DOCS) -> np.ndarray:
    """2^18 weights and the three thresholds."""
    sample = features.labelled_sample(docs, labels, "toxic", train_docs)
    return features.fit(graded(sample), train_shard, 2**features.BITS + GRADES - 1)


def score(docs: DataFrame, weights: np.ndarray, severe: float = SEVERE) -> DataFrame:
    """doc_id, held_out, severity (0 to 3), score (severity / 3), grade and predicted (1: toxic)."""
    packed, fitted = weights.astype(np.float32), bool(np.any(weights))
    cuts = [float(c) for c in weights[-(GRADES - 1):]]

    def scorer():
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            if len(known) >= 500_000:
                known.clear()
            known[word] = w = float(sum(packed[i] for i in word_features(word)))
            return w

        def run(text: str) -> tuple[float]:
            s = 0.0
            for word in set(text.split()):
                w = known.get(word)
                s += weight(word) if w is None else w
            return (sum(1 / (1 + math.exp(-max(-30.0, min(30.0, s - c)))) for c in cuts) if fitted else 0.0,)

        return run

    out = features.scored(docs, scorer, ["severity"])
    return out.select("doc_id", features.held_out(F.col("doc_id")).alias("held_out"), "severity", (F.col("severity") / (GRADES - 1)).alias("score"),
                      F.round("severity").cast("int").alias("grade"), (F.col("severity") >= severe).cast("int").alias("predicted"))
