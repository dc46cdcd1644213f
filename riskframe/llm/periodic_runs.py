"""Periodic run detection by block convolution over dyadic scales.

A run is a stretch of consecutive words with smallest period q and at least max(24, 3 q) words that no neighbouring word extends.
For each scale B = 1, 2, 4, ... the words are cut into blocks of B.  A run with B <= q < 2 B has a whole block in its first
2 q words, and the block occurs again q words on.  A number theoretic transform of length 2 B of the block and of the window
that follows it gives, for every distance d from B to 2 B - 1, the sum of the squared differences of the words' numbers, modulo
a prime; it is zero at every occurrence.  Zeros of neighbouring blocks at the same distance are one seed, which is extended to
both sides over less than a block.  A stretch that long enough a run of period q < d with q | d contains is that run again and
is left out (Fine and Wilf), smaller scales come first.  A zero modulo the prime could be no match, so what is long enough is
compared word by word, and cut into its true stretches if it is not periodic throughout.

Only blocks all of whose words occur again within 2 B words are transformed: the others have no occurrence in their window.

Scale: no shuffle; a task transforms the words of many texts at once, at most CHUNK words or one text, and at most CELLS cells
of transforms.  Memory follows the longest text (about 100 bytes a word).  Work is n log n for the transforms and what the
seeds are extended by.  Texts of up to 2^27 words are within the transform's length.

Nulls and other cases: null and empty texts have no words, no runs and four null columns; a null doc_id is not rewritten;
equal rows and doc_ids get equal results; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from binascii import crc32
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_PERIODS = 24, 3
PRIME, ROOT, TWOS = 2_013_265_921, 31, 27  # fixed values: 15 * 2^27 + 1 and a primitive root of it
CHUNK, CELLS = 2**17, 2**20
RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "runs array<struct<start:long,length:long,period:long>>")
_roots: dict[tuple[int, bool], list[np.ndarray]] = {}


def powers(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each level of a transform, largest first."""
    if (size, inverse) not in _roots:
        levels, half = [], size // 2
        while half:
            w = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
            w = pow(w, PRIME - 2, PRIME) if inverse else w
            level, have = np.ones(half, np.uint64), 1
            while have < half:  # doubling: w^have times what is there
                level[have:2 * have] = level[:have] * np.uint64(pow(w, have, PRIME)) % PRIME
                have *= 2
            levels.append(level)
            half //= 2
        _roots[size, inverse] = levels
    return _roots[size, inverse]


def forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row, in bit-reversed order."""
    rows, size = a.shape
    for w in powers(size, False):
        half = len(w)
        a = a.reshape(rows, -1, 2, half)
        x, y = a[:, :, 0], a[:, :, 1]
        out = np.empty_like(a)
        out[:, :, 0] = (x + y) % PRIME
        out[:, :, 1] = (x + (PRIME - y)) % PRIME * w % PRIME
        a = out
    return a.reshape(rows, size)


def backward(a: np.ndarray) -> np.ndarray:
    """Rows from their transforms in bit-reversed order."""
    rows, size = a.shape
    for w in reversed(powers(size, True)):
        half = len(w)
        a = a.reshape(rows, -1, 2, half)
        x, y = a[:, :, 0], a[:, :, 1] * w % PRIME
        out = np.empty_like(a)
        out[:, :, 0] = (x + y) % PRIME
        out[:, :, 1] = (x + (PRIME - y)) % PRIME
        a = out
    return a.reshape(rows, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % PRIME


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether row i's block (B words) occurs at place s < B of its window (2 B words): zeros of the squared differences."""
    b = blocks.shape[1]
    if windows.shape[1] != 2 * b or 2 * b > 2**TWOS:
        raise ValueError("a window has two blocks of at most 2^26 words")
    turned = np.zeros_like(windows)
    turned[:, :1] = blocks[:, :1]
    turned[:, b + 1:] = blocks[:, 1:][:, ::-1]  # place -i holds word i: the product is a correlation
    both = backward(forward(turned) * forward(windows) % PRIME)[:, :b]
    squares = np.cumsum(np.concatenate([np.zeros((len(windows), 1), np.uint64), windows * windows % PRIME], axis=1), axis=1)
    own = (blocks * blocks % PRIME).sum(axis=1, dtype=np.uint64)[:, None]
    return (own + squares[:, b:2 * b] - squares[:, :b] + (PRIME - both) * 2) % PRIME == 0


def seeds(words: np.ndarray, again: np.ndarray, ends: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every occurrence of a block at a distance of B to 2 B - 1 in the same text.

    ``again`` says how far on each word occurs again, ``ends`` where its text ends.
    """
    b = 2**scale
    count = len(words) // b
    first = np.arange(count) * b
    fits = (again[: count * b].reshape(count, b).max(axis=1) < 2 * b) & (ends[first] >= first + 2 * b) if count else np.zeros(0, bool)
    found_block, found_distance = [], []
    wanted = np.flatnonzero(fits)
    padded = np.concatenate([words, np.full(3 * b, len(words), np.uint64)]) if len(wanted) else words
    step = max(1, CELLS // (2 * b))
    for at in range(0, len(wanted), step):
        own = wanted[at:at + step]
        view = np.lib.stride_tricks.sliding_window_view(padded, 3 * b)[own * b]
        hit, shift = np.nonzero(occurrences(np.ascontiguousarray(view[:, :b]), np.ascontiguousarray(view[:, b:])))
        inside = own[hit] * b + shift + 2 * b <= ends[own[hit] * b]
        found_block.append(own[hit][inside])
        found_distance.append(shift[inside] + b)
    if not found_block:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_block).astype(np.int64), np.concatenate(found_distance).astype(np.int64)


def matching(words: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """How many places from ``at`` on, in direction ``step``, hold the same word as ``distance`` further, up to ``limit``."""
    out = np.zeros(len(at), np.int64)
    active, width = np.flatnonzero(limit > 0), 4
    while len(active):
        width = min(2 * width, max(1, CELLS // len(active)))
        reach = np.minimum(limit[active] - out[active], width)
        k = np.arange(width)
        place = at[active, None] + step * (out[active, None] + np.minimum(k, reach[:, None] - 1))
        differs = (words[place] != words[place + distance[active, None]]) & (k < reach[:, None])
        stop = np.where(differs.any(axis=1), differs.argmax(axis=1), reach)
        out[active] += stop
        active = active[(stop == reach) & (out[active] < limit[active])]
    return out


def true_stretches(words: np.ndarray, start: int, end: int, period: int) -> list[tuple[int, int]]:
    """Maximal stretches with the period within a range."""
    equal = words[start:end - period] == words[start + period:end]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    return [(start + int(i), start + int(j) + period) for i, j in edges.reshape(-1, 2)]


def all_runs(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in a row of texts that begin at ``starts`` (ascending, the first is 0)."""
    n = len(words)
    if not n:
        return []
    sizes = np.diff(np.append(starts, n))
    begins, ends = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    order = np.argsort(words, kind="stable")
    again = np.full(n, np.iinfo(np.int64).max)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    again[again + np.arange(n).astype(np.int64) >= ends] = np.iinfo(np.int64).max
    found: list[tuple[int, int, int]] = []
    scale = 0
    while LEAST_PERIODS * 2**scale <= sizes.max():
        b = 2**scale
        block, distance = seeds(words, again, ends, scale)
        smaller = list(found)
        order = np.lexsort((block, distance))
        block, distance = block[order], distance[order]
        head = np.ones(len(block), bool)
        head[1:] = (block[1:] != block[:-1] + 1) | (distance[1:] != distance[:-1]) | (begins[block[1:] * b] != begins[block[:-1] * b])
        last = np.append(head[1:], True) if len(block) else head
        first, tail, d = block[head] * b, block[last] * b + b, distance[head]  # [first, tail) equals what is d further
        need = np.maximum(LEAST_WORDS - d, (LEAST_PERIODS - 1) * d)
        keep = tail - first + 2 * (b - 1) >= need
        first, tail, d, need = first[keep], tail[keep], d[keep], need[keep]
        by_start = np.argsort(first, kind="stable")
        first, tail, d, need = first[by_start], tail[by_start], d[by_start], need[by_start]
        known = np.zeros(len(first), bool)
        for start, end, period in smaller:
            if end - start < 2 * b:
                continue
            lo, hi = np.searchsorted(first, [start, end])
            known[lo:hi] |= (d[lo:hi] % period == 0) & (tail[lo:hi] + d[lo:hi] <= end)
        first, tail, d, need = first[~known], tail[~known], d[~known], need[~known]
        left = matching(words, first - 1, d, -1, np.minimum(first - begins[first], b - 1))
        right = matching(words, tail, d, 1, np.minimum(ends[first] - d - tail, b - 1))
        start, stop = first - left, tail + right
        for i in np.flatnonzero(stop - start >= need):
            whole, period = (int(start[i]), int(stop[i] + d[i])), int(d[i])
            for s, e in true_stretches(words, *whole, period):
                if e - s < max(LEAST_WORDS, LEAST_PERIODS * period):
                    continue
                # after a zero that was no match, a part could have a smaller period
                if (s, e) == whole or not any(period % p == 0 and x <= s and e <= y for x, y, p in smaller):
                    found.append((s, e, period))
        scale += 1
    return found


def rewritten(words: list[str], h: int) -> list[str]:
    """A tenth of the texts end in a stretch that repeats itself: word i >= a becomes word a + (i - a) mod p."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def split_words(text: bytes) -> list[bytes]:
    """Splitting bytes cuts at ASCII white space only."""
    return text.split()


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """One text's row: number of runs, the most repetitive one, digests of the runs and of the text without repetitions."""
    runs = sorted(((s, e - s, p) for s, e, p in runs), key=lambda r: (r[0], r[2]))
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    best, exponent, kept = (None, None, None), None, words
    if runs:
        best = runs[0]
        for run in runs[1:]:
            if run[1] * best[2] > best[1] * run[2]:
                best = run
        exponent = 1000 * best[1] // best[2]
        change = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            change[s + p] += 1
            change[s + n] -= 1
        kept = [w for w, inside in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not inside]
    return (len(runs), *best, exponent, sha256(told.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest(),
            [{"start": s, "length": n, "period": p} for s, n, p in runs])


def texts_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, places counted from its first word; all texts go through the transforms together."""
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for ws in texts for w in ws), np.uint64)
    sizes = np.array([len(ws) for ws in texts], np.int64)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in all_runs(flat, starts):
        which = int(np.searchsorted(starts, start, "right")) - 1
        out[full[which]].append((start - int(starts[which]), end - int(starts[which]), period))
    return out


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """doc_id and RESULT for each document; ``rewrite`` gives a tenth of the documents a periodic end first."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, total = 0, batch.num_rows
            while at < total:
                texts: list[list[bytes]] = []
                start, held = at, 0
                while at < total and (not texts or held < CHUNK):
                    words = split_words(batch.column(2)[at].as_py() or b"")
                    name = batch.column(1)[at].as_py()
                    texts.append(rewritten(words, crc32(name.encode())) if rewrite and name is not None else words)
                    held += len(words)
                    at += 1
                rows = [summary(ws, runs) for ws, runs in zip(texts, texts_runs(texts), strict=True)]
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]
                names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                                                 names=["doc_id", *names])

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("_name"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {RESULT}")
