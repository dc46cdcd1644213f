"""Token counts by heap-and-linked-list byte-pair merging, without token ids.

The vocabulary is that of a piece model: a text gets one mark before it, spaces become marks, and a piece's rank is its
place among the merged pieces.  The symbols of a stretch form a linked list; a heap holds every adjacent pair that makes a
piece, the lowest rank first and the leftmost among equals; popping a pair joins it and offers its new neighbours.  The
count is the number of initial symbols minus the number of merges; a symbol that is no piece counts as its UTF-8 bytes.

No piece joins a character with a mark behind it (checked when the vocabulary is read), so a text falls into stretches
``marks + word`` that merge apart from each other; the counts of repeated stretches are kept in a table of bounded size.

Scale: one pass without a shuffle; texts are read in small Arrow batches.  The vocabulary (32,000 pieces) is read from the
path on each worker's machine.

Nulls and other cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; equal rows and
repeated or null doc_ids are returned as they come; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LIMIT = 4096
REMEMBERED = 500_000  # stretches whose counts a task keeps; when full, it starts anew
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Merger(dict):
    """Token count of a stretch, remembered."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=model)
        plain = [i for i in range(pieces.get_piece_size())
                 if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))]
        self.rank = {pieces.id_to_piece(i): -pieces.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces reach across words")

    def __missing__(self, stretch: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[stretch] = n = self.count(stretch)
        return n

    def count(self, stretch: str) -> int:
        rank, n = self.rank, len(stretch)
        symbols = list(stretch)
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(stretch[i:i + 2])) is not None]
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = heappop(heap)
            j = after[i]
            left = symbols[i]
            if left is None or j >= n or rank.get(pair := left + symbols[j]) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(pair + symbols[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + pair)) is not None:
                heappush(heap, (r, h))
        extra = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
        return n - merges + extra

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        marked = (MARK + text).replace(" ", MARK)
        return sum(map(self.__getitem__, STRETCH.findall(marked)))


def with_token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        merger = Merger(model)
        for batch in batches:
            counts = [merger.tokens(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
