"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader updates.

Features are the words, pairs of neighbouring words, the words' forms (runs of capitals, small letters and digits become one sign each, other signs stay)
and pairs of neighbouring forms (a word after itself is a pair of its own kind), hashed into 2^18 buckets; a feature's value is its share of the text's words, so length
does not matter.  The score is a sparse dot product: a text's score is the sum of its words' and pairs' weights over its
number of words; a task keeps the weights of KEPT_WORDS words at most.

Scale: labels are learnt from at most TRAIN_DOCS rows (a parameter), chosen by hash; the model has at most 2^18 weights.
Scoring is one pass over whole texts without a shuffle.

Nulls and other cases: a null or empty text gets the score of the intercept alone; rows without label or doc_id teach
nothing; without any labels every score is 0.5; equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from sys import intern
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import features

TRAIN_DOCS = 12_000
THRESHOLD = 0.7
KEPT_WORDS = 100_000  # words that a task remembers, some 250 bytes each
SCALE = 10.0  # of the shares, so that the penalty is small beside them
FORMS = [(re.compile(r"[^\W\d_]+"), lambda m: ("A" if m[0].isupper() and len(m[0]) > 1 else "a")), (re.compile(r"\d+"), lambda m: "0"),
         (re.compile(r"([^\w\s])\1+"), lambda m: m[1])]
WORD, PAIR = crc32(b"w"), crc32(b"n")  # checksums so far of a word and of the first one of a pair


def form(word: str) -> str:
    if word.isalpha():  # one run of letters
        return "A" if word.isupper() and len(word) > 1 else "a"
    for pattern, to in FORMS:
        word = pattern.sub(to, word)
    return word[:12]


def bucket(kind: str, value: str) -> int:
    return crc32(f"{kind}{value}".encode("utf-8", "replace")) >> (32 - features.BITS)


def pair_forms(words: list[str], forms: list[str]) -> list[str]:
    """Neighbouring forms, with a sign of their own where a word follows itself."""
    return ["=" if a is b or a == b else f + " " + g for a, b, f, g in zip(words, words[1:], forms, forms[1:])]


def pair_ends(word: str) -> tuple[int, bytes]:
    """A word as the first one of a pair (its checksum so far) and as the second."""
    raw = word.encode("utf-8", "replace")
    return crc32(b"n" + raw), b" " + raw


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and shares of a text's features; the last bucket is the intercept."""
    words = text.split()
    forms = [form(w) for w in words]
    at = [bucket("w", w) for w in words] + [bucket("f", f) for f in forms] + [bucket("p", p) for p in pair_forms(words, forms)]
    ends = [pair_ends(w) for w in words]
    at += [crc32(b, a) >> (32 - features.BITS) for (a, _), (_, b) in zip(ends, ends[1:])]
    found, counts = np.unique(np.asarray(at, dtype=np.int64), return_counts=True)
    return np.append(found, 2**features.BITS), np.append(counts * SCALE / max(1, len(words)), 1.0)


def train_shard(rows: list) -> dict[int, float]:
    model = features.Ftrl(2**features.BITS + 1, rate=0.5, l1=0.3, l2=0.01)
    for _ in range(features.EPOCHS):
        for y, at, value in rows:
            w = model.weights(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ value)))))
            model.update(at, w, (p - y) * value)
    w = model.weights()
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    both = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~features.held_out(F.col("doc_id")))
    share = {r["y"]: r["n"] for r in both.groupBy(F.col("quality").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(share.values()) or 1
    sample = features.labelled_sample(docs, labels, "quality", {y: max(1, train_docs * n // whole) for y, n in share.items()})
    return features.fit(features.featurised(sample, text_features), train_shard, 2**features.BITS + 1)


def _scorer(weights: np.ndarray):
    packed = weights.astype(np.float32)

    def scorer():
        single: dict[str, tuple[float, str, int, bytes]] = {}
        flat, shift = packed.tolist(), 32 - features.BITS
        pairs: dict[str, float] = {}

        def one(word: str) -> tuple[float, str, int, bytes]:
            f, raw = intern(form(word)), word.encode("utf-8", "replace")
            if len(single) >= KEPT_WORDS:
                single.clear()
            single[word] = out = (float(packed[crc32(raw, WORD) >> shift] + packed[bucket("f", f)]), f, crc32(raw, PAIR), b" " + raw)
            return out

        def two(pair: str) -> float:
            if len(pairs) >= 100_000:
                pairs.clear()
            pairs[pair] = out = float(packed[bucket("p", pair)])
            return out

        def run(text: str) -> tuple[float]:
            words = text.split()
            found = [single.get(w) or one(w) for w in words]
            forms = [f[1] for f in found]
            total = sum([f[0] for f in found]) + sum([flat[crc32(b[3], a[2]) >> shift] for a, b in zip(found, found[1:])])
            for pair in pair_forms(words, forms):
                w = pairs.get(pair)
                total += two(pair) if w is None else w
            margin = float(packed[-1]) + total * SCALE / max(1, len(words))
            return (1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))),)

        return run

    return scorer


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = features.scored(docs, _scorer(weights), ["score"])
    return out.select("doc_id", features.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all columns, whose score is ``threshold`` or more."""
    return features.passing(docs, _scorer(weights), threshold)
