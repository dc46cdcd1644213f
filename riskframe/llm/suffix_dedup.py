"""Suffix-array removal of long byte strings that stand twice.

The suffix array is built by linear grouping: suffixes start in groups of one first symbol.  Groups are taken in descending
order; every suffix of the group points to the previous smaller one, whose Lyndon prefix it lengthens, and the suffixes
lengthened alike split off into a group of their own just above.  When all groups are done, each holds the suffixes with
one Lyndon prefix, and a suffix's place in its group is that of the suffix behind this prefix, so one ascending walk emits
the order.  Nothing is renamed and nothing recurses.  Neighbours in the order tell whether a window stands twice.

Scale: a suffix array of the whole corpus would be one task.  Windows that are equal share their anchor (see ``anchors``),
so a suffix array per anchor, over the few distinct segments there, finds the same repeats.  The stretch around the anchor
that all of them share enters as one symbol.  Anchors with very many distinct segments are spread window by window.  Equal
texts are merged first, and all but short ones are removed whole without a suffix array.

Nulls and other cases: a null text counts as empty; texts shorter than the window keep all their bytes; equal rows, also
with one doc_id, are texts of their own and repeat each other; null doc_ids are values like others.  Empty tables give an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.anchors import NONE, covered, repeats
from riskframe.llm.common import attach, stored, text_key
from riskframe.llm.jaccard_join import ODD, scramble

WINDOW = 400
GRAM_BITS = 7  # grams of 2^7 bytes


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffixes in ascending order; the end is smaller than every symbol."""
    n = len(symbols)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        members.setdefault(c, []).append(i)
    order = sorted(members)
    groups = [members[c] for c in order]
    number = {c: g for g, c in enumerate(order)}
    group_of = [number[c] for c in symbols]
    below = list(range(-1, len(groups) - 1))
    above = list(range(1, len(groups) + 1))
    if groups:
        above[-1] = -1
    length, previous, done = [1] * n, [-1] * n, bytearray(n)
    g = len(groups) - 1
    while g >= 0:
        own = [i for i in groups[g] if group_of[i] == g]
        groups[g] = own
        if own:
            own.sort()
            for i in own:
                done[i] = 1
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            longer = length[own[0]]
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                length[p] += k * longer
                split.setdefault((group_of[p], -k), []).append(p)
            for (old, _), moved in sorted(split.items()):  # most repeats first: each lands right above the old group
                new = len(groups)
                groups.append(moved)
                for p in moved:
                    group_of[p] = new
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    # emit: groups ascending give the slots, the suffix behind the Lyndon prefix gives the order inside
    lowest = 0
    slot, at = [0] * len(groups), 0
    while lowest >= 0 and groups:
        slot[lowest] = at
        at += len(groups[lowest])
        lowest = above[lowest]
    behind: list[list[int] | None] = [None] * (n + 1)
    for p in range(n):
        s = p + length[p]
        if behind[s] is None:
            behind[s] = [p]
        else:
            behind[s].append(p)
    out = [0] * n
    for i in range(-1, n):
        for p in behind[out[i] if i >= 0 else n] or ():
            g = group_of[p]
            out[slot[g]] = p
            slot[g] += 1
    return out


def common_lengths(symbols: list[int], order: list[int]) -> list[int]:
    """Common symbols of each suffix in the order with the one before it."""
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        if (r := rank[i]) == 0:
            h = 0
            continue
        j = order[r - 1]
        most = n - max(i, j)
        while h < most and symbols[i + h] == symbols[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def repeated_windows(rows: list) -> Iterator[tuple[bytes, int, int, int]]:
    """Ranges of window starts that stand twice among the bodies of one anchor.

    All bodies are in line at the anchor; the stretch they share there becomes symbol 257, other bytes 1 to 256, and 0 ends a body.
    """
    bodies = [(digest, body, windows, lead, n) for digest, body, windows, lead, n, _ in rows]
    left = len(commonprefix([b[:lead][::-1] for _, b, _, lead, _ in bodies]))
    right = len(commonprefix([b[lead:] for _, b, _, lead, _ in bodies]))
    symbols: list[int] = []
    starts = []
    for _, body, _, lead, _ in bodies:
        starts.append(len(symbols))
        symbols += [c + 1 for c in body[:lead - left]]
        symbols.append(257)
        symbols += [c + 1 for c in body[lead + right:]]
        symbols.append(0)
    order = suffix_array(symbols)
    shared = common_lengths(symbols, order)
    most = [0] * len(symbols)
    for r, i in enumerate(order):
        most[i] = max(shared[r], shared[r + 1] if r + 1 < len(order) else 0)
    core = left + right
    for (digest, body, windows, lead, n), start in zip(bodies, starts):
        if n > 1:
            yield digest, 0, windows, NONE
            continue
        before = lead - left  # bytes before the shared stretch
        end = start + before + 1 + len(body) - lead - right
        hit = []
        for w in range(min(before, windows)):
            k = min(most[start + w], end - start - w)
            hit.append((k + core - 1 if k > before - w else k) >= WINDOW)
        if windows > before:  # windows from inside the shared stretch: what follows it decides
            follow = min(most[start + before], end - start - before) - 1
            reach = core + max(0, follow)
            hit += [reach - w >= WINDOW for w in range(windows - before)]
        w = 0
        while w < len(hit):
            if hit[w]:
                first = w
                while w < len(hit) and hit[w]:
                    w += 1
                yield digest, first, w, NONE
            w += 1


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    factor = int(ODD)
    for bit in range(GRAM_BITS):
        step = 1 << bit
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
    return scramble(h), np.cumsum([0, *[len(t) for t in texts]])


def cut_bytes(text: bytes):
    return lambda first, last: text[first:last + WINDOW]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    base = stored(base, "base")
    copies = base.groupBy("key").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    texts = docs.select(text_key(F.col("text")).alias("key"), text.cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("owner"))
    texts = texts.where(F.octet_length("text") >= WINDOW)
    held, spans = repeats(texts, byte_grams, WINDOW - 2**GRAM_BITS + 1, WINDOW, cut_bytes, repeated_windows, earlier=False)

    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, body, found in zip(*[c.to_pylist() for c in batch.columns]):
                gone = covered([(s["start"], s["stop"]) for s in found], WINDOW)
                edges = [0, *[x for span in gone for x in span], len(body)]
                kept = sha256()
                for a, b in zip(edges[::2], edges[1::2]):
                    kept.update(body[a:b])
                out.append((key, sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["key", "_removed", "_spans", "_kept"])

    removed = held.join(spans, "key").select("key", "text", "spans").mapInArrow(remove, "key binary, _removed long, _spans long, _kept string")
    out = attach(base, stored(copies, "copies"), ["key"], "left")
    single, many = out.where("_copies is null").drop("_copies"), out.where("_copies is not null")
    single = single.join(removed, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("_kept", "_whole").alias("kept_sha256"))
    gone = F.col("n_bytes") >= WINDOW
    many = many.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
                       F.when(gone, F.lit(sha256(b"").hexdigest())).otherwise(F.col("_whole")).alias("kept_sha256"))
    return single.unionByName(many)
