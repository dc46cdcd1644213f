"""Where long sequences may repeat: windows meet at the least gram inside them.

Two equal windows of ``width`` symbols hold the same grams, so the same least gram hash (the leftmost among equals) at the
same offset.  Every text is cut into runs of windows with one least gram, its anchor; only runs whose anchor stands in two
places can hold repeated windows.  The stretch of text under such a run is a segment.  Segments with one anchor come
together in one task, merged into distinct bodies first, so copies and shared passages weigh one body each.

Anchors whose distinct bodies exceed a bound are not brought together: their windows are spread one by one by digest.

Texts are told apart by ``key``; equal texts are one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import bounded, discard, stored

PIECE = 1 << 22  # windows looked at together
MOST_BYTES = 800_000  # of the distinct bodies of an anchor that meet in one task, which holds some 300 bytes for each
CHUNK = 1 << 17  # bytes of text that are cut into runs together; a longer text is a chunk of its own
SEEN = 500_000  # bodies a task remembers as sent
PLACE = np.uint64(0xFFFFFF)
NONE = -(2**63)

Grams = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # grams of several texts in line, and where each text's symbols begin and the last ends
Cut = Callable[[bytes], Callable[[int, int], bytes]]  # the bytes under the windows first..last of a text
Solve = Callable[[list], Iterator[tuple[bytes, int, int, int]]]  # rows (digest, body, windows, lead, n, owner)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window; compares the upper 40 bits."""
    n = len(values) - width + 1
    keyed = (values & ~PLACE) | np.arange(len(values), dtype=np.uint64)
    keyed = np.append(keyed, np.full(-len(keyed) % width, np.iinfo(np.uint64).max))
    blocks = keyed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & PLACE).astype(np.int64)


def runs(grams: np.ndarray, cuts: np.ndarray, per_window: int, width: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, anchor position, first window, last window) of the runs of windows inside each text.

    Text i has the symbols ``cuts[i]`` to ``cuts[i + 1]`` of the line of symbols that the grams were made of; positions are those in the text.
    """
    windows = max(0, len(grams) - per_window + 1)
    found = [sliding_least(grams[i:min(windows, i + PIECE) + per_window - 1], per_window) + i for i in range(0, windows, PIECE)]
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    begins = np.zeros(windows, bool)
    begins[1:] = at[1:] != at[:-1]
    over = np.maximum(cuts[1:] - width + 1, cuts[:-1])  # from here on a text's windows would reach into the next one
    begins[cuts[cuts < windows]] = True
    begins[over[over < windows]] = True
    first = np.flatnonzero(begins)
    last = np.append(first, windows)[1:] - 1
    text = np.searchsorted(cuts, first, "right") - 1
    inside = first < over[text]
    first, last, text = first[inside], last[inside], text[inside]
    least, base = at[first], cuts[text]
    return text, grams[least].view(np.int64), least - base, first - base, last - base


def find_runs(texts: DataFrame, grams: Grams, per_window: int, width: int) -> DataFrame:
    """(anchor, key, at, first, last) of all texts (key, text as bytes); a key once per task, texts taken together up to CHUNK bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(keys: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
            text, anchor, *places = runs(*grams(bodies), per_window, width)
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(keys, pa.binary()).take(pa.array(text)), *[pa.array(x.astype(np.int32)) for x in places]],
                                              names=["anchor", "key", "at", "first", "last"])

        seen, keys, bodies, held = set(), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                bodies.append(text.as_py())
                held += len(bodies[-1])
                if held > CHUNK:
                    yield found(keys, bodies)
                    keys, bodies, held = [], [], 0
        if keys:
            yield found(keys, bodies)

    def batched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return texts.select("key", "text").mapInArrow(batched, "anchor long, key binary, at int, first int, last int")


def shared_runs(found: DataFrame) -> DataFrame:
    """The runs whose anchor stands in two places, listed per text: (key, runs)."""
    place = F.xxhash64("key", "at")
    twice = found.groupBy("anchor").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b").select("anchor")
    return found.join(twice, "anchor").groupBy("key").agg(F.collect_set(F.struct("anchor", "at", "first", "last")).alias("runs"))


def segments(texts: DataFrame, cut: Cut) -> DataFrame:
    """(anchor, key, owner, first, windows, lead, digest, body) of texts (key, text, owner, runs); a body once per task, else null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            for key, text, owner, found in zip(*batch.columns):
                part, rows = cut(text.as_py()), found.as_py()
                for i in range(0, len(rows), 20_000):
                    some = rows[i:i + 20_000]
                    bodies = [part(r["first"], r["last"]) for r in some]
                    digests = [blake2b(b, digest_size=16).digest() for b in bodies]
                    for j, r in enumerate(some):
                        if (name := (r["anchor"], digests[j])) in seen:
                            bodies[j] = None
                        seen.add(name)
                    if len(seen) > SEEN:
                        seen.clear()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["anchor"] for r in some], pa.int64()), pa.array([key.as_py()] * len(some), pa.binary()), pa.array([owner.as_py()] * len(some), pa.int64()),
                         *[pa.array(x, pa.int32()) for x in ([r["first"] for r in some], [r["last"] - r["first"] + 1 for r in some], [r["at"] - r["first"] for r in some])],
                         pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())],
                        names=["anchor", "key", "owner", "first", "windows", "lead", "digest", "body"])

    return texts.select("key", "text", "owner", "runs").mapInArrow(
        run, "anchor long, key binary, owner long, first int, windows int, lead int, digest binary, body binary")


def by_window(large: DataFrame, cut: Cut) -> DataFrame:
    """(anchor, digest, start, window, n, owner): the windows of the bodies one by one, by digest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for anchor, digest, body, windows, n, owner in zip(*[c.to_pylist() for c in batch.columns]):
                part = cut(body)
                found = [blake2b(part(i, i), digest_size=16).digest() for i in range(windows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * windows, pa.int64()), pa.array([digest] * windows, pa.binary()), pa.array(range(windows), pa.int32()), pa.array(found, pa.binary()),
                     pa.array([n] * windows, pa.int64()), pa.array([owner] * windows, pa.int64())], names=["anchor", "digest", "start", "window", "n", "owner"])

    return large.select("anchor", "digest", "body", "windows", "n", "owner").mapInArrow(run, "anchor long, digest binary, start int, window binary, n long, owner long")


def grouped(few: DataFrame, solve: Solve) -> DataFrame:
    """Ranges (anchor, digest, start, stop, least) that ``solve`` finds among the bodies of each anchor, in order of owner."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solved(anchor: int, rows: list) -> pa.RecordBatch:
            out = list(solve(rows))
            return pa.RecordBatch.from_arrays([pa.array([anchor] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()),
                                               pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int64())], names=["anchor", "digest", "start", "stop", "least"])

        now, rows = None, []
        for batch in batches:
            for anchor, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if anchor != now and rows:
                    yield solved(now, rows)
                    rows = []
                now = anchor
                rows.append(rest)
        if rows:
            yield solved(now, rows)

    parts = max(int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = few.select("anchor", "digest", "body", "windows", "lead", "n", "owner").repartition(parts, "anchor").sortWithinPartitions("anchor", "owner", "digest")
    return ordered.mapInArrow(run, "anchor long, digest binary, start int, stop int, least long")


def repeats(texts: DataFrame, grams: Grams, per_window: int, width: int, cut: Cut, solve: Solve, earlier: bool) -> tuple[DataFrame, DataFrame]:
    """(texts that may repeat something: key, text; spans: key, starts as ranges (start, stop)).

    ``texts`` has (key, text, owner), equal texts with equal keys; a window has ``width`` symbols and ``per_window`` grams.  A window counts if it also stands elsewhere or, with
    ``earlier``, in a text with a smaller owner.
    """
    found = stored(find_runs(texts, grams, per_window, width), "found")  # read twice, texts are cut once
    listed = stored(shared_runs(found), "runs")
    discard(found)
    owners = texts.groupBy("key").agg(F.min("owner").alias("owner"))
    wanted = stored(owners.join(listed.select("key"), "key"), "wanted")
    rows = texts.join(bounded(wanted), ["key", "owner"]).dropDuplicates(["key"])
    held = stored(rows.join(listed, "key").select("key", "text", "owner", "runs"), "texts")
    cuts = stored(segments(held, cut), "segments")

    each = cuts.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"), F.max("windows").alias("windows"),
                                                F.max("lead").alias("lead"), F.first("body", ignorenulls=True).alias("body"))
    each = stored(each, "bodies")
    sizes = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("body")).alias("_s"))
    sized = each.drop("body").join(sizes, "anchor")
    least = F.col("owner") if earlier else F.lit(NONE)
    alone = sized.where("_n = 1 and n > 1").select("anchor", "digest", F.lit(0).alias("start"), F.col("windows").alias("stop"), least.alias("least"))
    large = stored(sizes.where((F.col("_n") > 1) & (F.col("_s") > MOST_BYTES)).select("anchor"), "large")
    small = sizes.where((F.col("_n") > 1) & (F.col("_s") <= MOST_BYTES)).select("anchor")
    marks = alone.unionByName(grouped(each.join(small, "anchor"), solve))
    spread = stored(by_window(each.join(large, "anchor"), cut), "windows")
    again = spread.groupBy("window").agg(F.sum("n").alias("_n"), F.min("owner").alias("_o")).where("_n > 1")
    marks = marks.unionByName(spread.join(again, "window").select("anchor", "digest", "start", (F.col("start") + 1).alias("stop"), (F.col("_o") if earlier else F.lit(NONE)).alias("least")))
    marks = stored(marks, "marks")
    placed = cuts.select("anchor", "digest", "key", "owner", "first").join(marks, ["anchor", "digest"]).where("owner > least")
    spans = placed.groupBy("key").agg(F.collect_list(F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))).alias("spans"))
    return held.select("key", "text"), spans


def covered(spans: list, width: int) -> list[tuple[int, int]]:
    """Maximal runs of positions under windows that start in the (start, stop) ranges."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop - 1 + width)
        else:
            out.append([start, stop - 1 + width])
    return [(a, b) for a, b in out]
