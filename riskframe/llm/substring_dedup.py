"""Substring removal by suffix automata: words under long runs that an earlier document has already.

A shard's automaton takes in its reference stretches in ascending order of doc_id; each state keeps the first document that
holds its strings (a clone is as old as the state it was split from).  Documents are then streamed through it: the current
state and match length are the matching statistics, and climbing to the state that holds the last WINDOW words tells the
first document with this window.  Windows first seen in a smaller doc_id are removed, overlaps joined to maximal spans.

Scale: every document is reference for the later ones, so the reference is the corpus and cannot be broadcast; shards are
cut by anchor instead (see ``anchors``): equal windows share an anchor, so a shard meets exactly the stretches that may
match.  Shards are bounded in size; anchors beyond the bound are spread window by window.  Equal texts are merged first.

Nulls and other cases: a null text has no words; a null doc_id counts as larger than all others and equal to other nulls;
documents with one doc_id don't remove each other's words; texts shorter than the window keep all words.  Empty tables
give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.anchors import covered, repeats
from riskframe.llm.common import attach, stored, text_key, words_of
from riskframe.llm.jaccard_join import rolling, word_hashes

WINDOW = 50
GRAM = 16
LAST = 2**63 - 1


class SuffixAutomaton:
    """Automaton of all substrings of the word lists taken in, each state with its first owner."""

    def __init__(self):
        self.after: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [LAST]

    def take_in(self, words: list[bytes], owner: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word, owner)

    def _state(self, length: int, owner: int, after: dict, link: int) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(owner)
        return len(self.after) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.after[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.after[p].get(word) == q:
            self.after[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes, owner: int) -> int:
        q = self.after[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, owner, {}, 0)
        p = last
        while p >= 0 and word not in self.after[p]:
            self.after[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.after[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def first_owners(self, words: list[bytes], width: int) -> list[int]:
        """First owner of each window of the words, LAST where none has it."""
        after, link, length, first = self.after, self.link, self.length, self.first
        state = matched = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in after[state]:
                state = link[state]
                matched = length[state]
            if word in after[state]:
                state = after[state][word]
                matched += 1
            while length[link[state]] >= width if state else False:
                state = link[state]
                matched = length[state]
            if i >= width - 1:
                out.append(first[state] if matched >= width else LAST)
        return out


def earlier_windows(rows: list) -> Iterator[tuple[bytes, int, int, int]]:
    """Ranges of window starts of one anchor's bodies with one first owner."""
    automaton = SuffixAutomaton()
    listed = [(digest, body.split(b" "), owner) for digest, body, _, _, _, owner in rows]
    for _, words, owner in listed:
        automaton.take_in(words, owner)
    for digest, words, _ in listed:
        owners = automaton.first_owners(words, WINDOW)
        begin = 0
        for i in range(1, len(owners) + 1):
            if i == len(owners) or owners[i] != owners[begin]:
                yield digest, begin, i, owners[begin]
                begin = i


def word_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    values, starts = word_hashes(b" " + b" ".join(texts) + b" " * 8)
    return rolling(values, GRAM), np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))


def cut_words(text: bytes):
    words = text.split()
    return lambda first, last: b" ".join(words[first:last + WINDOW])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    base = docs.select("doc_id", owner.alias("owner"), text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("_w"))
    base = base.select("doc_id", "owner", "key", F.size("_w").cast("long").alias("n_words"), F.sha2(F.array_join("_w", " "), 256).alias("_whole"))
    base = stored(base, "base")
    first = base.groupBy("key").agg(F.min("owner").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    texts = docs.select(text_key(F.col("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), owner.alias("owner"))
    held, spans = repeats(texts, word_grams, WINDOW - GRAM + 1, WINDOW, cut_words, earlier_windows, earlier=True)

    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, text, found in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.split()
                gone = covered([(s["start"], s["stop"]) for s in found], WINDOW)
                edges = [0, *[x for span in gone for x in span], len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                out.append((key, len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["key", "_removed", "_kept"])

    removed = held.join(spans, "key").select("key", "text", "spans").mapInArrow(remove, "key binary, _removed long, _kept string")
    rows = attach(base, stored(first, "first"), ["key"], "left").withColumn("_first", F.coalesce("_first", "owner"))
    own, later = rows.where("owner = _first"), rows.where("owner > _first")
    own = own.join(removed, "key", "left").select("doc_id", "n_words", F.coalesce("_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_kept", "_whole").alias("kept_sha256"))
    gone = F.col("n_words") >= WINDOW
    later = later.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).alias("n_removed"),
                         F.when(gone, F.lit(sha256(b"").hexdigest())).otherwise(F.col("_whole")).alias("kept_sha256"))
    return own.unionByName(later)
