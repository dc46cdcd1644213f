"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A text's set holds its distinct 5-word shingles.  Sets r and s with Jaccard similarity of 3/4 or more differ in at most
D = (|r| + |s|) / 7 shingles.  By size band, the universe of shingles is hashed into m segments; a set's subsets in these
segments agree with a partner's in at least m - D segments.

Allocation by cost: with m somewhat larger than D + 1, a set can leave out its costliest segments.  Both sides order their
segments alike, large subsets first (they are rare), empty ones last, and index the first D + k of them, k being 1/14 of the
set: two sets that agree in m - D of m segments then share k indexed ones.  So a set with fewer than k shared ones has no
partner and is dropped before anything is compared; a passage shared by many texts is not enough to keep them.  A set that
would have to index an empty segment (possible by chance in small sets) indexes single shingles in addition, where it meets
the other such sets.  Pairs that differ in at most one shingle need a single segment: sets of up to 7 shingles index
themselves and their one-deletion neighbourhoods.

Candidates are verified on the whole sets.  First in rounds: every set is compared with the hub of one of its tokens, linked
sets are joined to components, and tokens with one component left drop out; a later round's hubs are of other components.
Then the sets of different components that still share a token: a set u not linked with its hub h can only be linked with v
if v has some of u's shingles that h has not (|u & v| <= |u & h| + |(u - h) & v|), so such pairs are found by joining these
few, rare shingles and counting them.  Pairs about which the hubs say nothing are compared if they share enough tokens.
So copies are never expanded into pairs and no link between components is lost.

Scale: a set stands for all documents with that set, and each task indexes it once, so thousands of copies meet as one
row per task.  About 0.4 index rows of 16 bytes leave per shingle.  Groups are read as sorted runs, never collected.
Shingle sets are built again for candidate sets only, found by a broadcast join below a counted bound, a shuffled one
above.  Texts go to workers 4 MB at a time, and their words are hashed together.  Shingles are 64-bit hashes of their
words; the tie of two different shingles is left out of account.

Nulls and other cases: null and empty texts have no shingles and are linked with nothing, not even with each other; texts
of fewer than five words have one shingle, the whole; null doc_ids take part, a component's id is its smallest doc_id that is
not null; equal rows get equal results.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import attach, bounded, discard, only, small_broadcasts, stored
from riskframe.llm.components import as_edges, components

WIDTH = 5
FIRST_BAND, WHOLE_UPTO = 6, 7
SEGMENT_SHARE = 0.42  # segments per shingle of the band's largest set; D is at most 2/7 of it
ROUNDS = 3  # in which groups are compared with a hub
SHARED_PART = 14  # of its shingles, so many index tokens are shared with a partner
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
CHUNK = 2**17  # bytes of text that a task handles at once; a longer text is a chunk of its own
IN_WORD = bytes(c not in b" \t\n\x0b\x0c\r" for c in range(256))
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier of the rolling hash


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values."""
    out = np.zeros(max(0, len(values) - width + 1), dtype=np.uint64)
    for i in range(width):
        out = out * ODD + values[i:i + len(out)]
    return scramble(out)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word, by eight bytes at a time; a text (lower-cased, in white space, eight blanks at its end) or several."""
    inside = np.frombuffer(text.translate(IN_WORD), np.int8)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, left = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    found = scramble((eights[starts] & FIRST_BYTES[np.minimum(left, 8)]) + left.astype(np.uint64) * ODD)
    longer, at = np.flatnonzero(left > 8), 8
    while len(longer):
        found[longer] = scramble(found[longer] * ODD + (eights[starts[longer] + at] & FIRST_BYTES[np.minimum(left[longer] - at, 8)]))
        at += 8
        longer = longer[left[longer] > at]
    return found, starts


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    again = values[1:] == values[:-1]
    return values[np.append(True, ~again)] if again.any() else values


def shingles_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text in UTF-8; words end at ASCII white space only."""
    values, starts = word_hashes(b" " + b" ".join(texts).lower() + b" " * 8)
    cuts = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]])).tolist()
    runs = rolling(values, WIDTH)
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= WIDTH:
            yield distinct(runs[a:b - WIDTH + 1])
        else:
            yield rolling(values[a:b], b - a) + np.uint64(WIDTH - (b - a)) if b > a else values[:0]


def sets_of(column) -> Iterator[np.ndarray]:
    """The shingles of each text of an Arrow column; texts are taken together up to CHUNK bytes."""
    texts, held = [], 0
    for t in column:
        texts.append(t.as_py() or b"")
        held += len(texts[-1])
        if held > CHUNK:
            yield from shingles_of(texts)
            texts, held = [], 0
    yield from shingles_of(texts)


def set_id(found: np.ndarray) -> int:
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_of(n: int) -> int:
    return (n // FIRST_BAND).bit_length() - 1


def least_shared(n: int) -> int:
    """Index tokens that a set of n shingles shares at least with a partner that is no smaller."""
    return max(1, n // SHARED_PART)


def index_tokens(found: np.ndarray) -> np.ndarray:
    """What a set is indexed under."""
    n = len(found)
    out = []
    if 3 <= n <= WHOLE_UPTO:
        whole = scramble(found).sum(dtype=np.uint64)
        out += [np.array([whole + np.uint64(n)]), whole - scramble(found) + np.uint64(n - 1)]
    if n >= FIRST_BAND:
        band, poor = band_of(n), False
        mixed = scramble(found + ODD)
        for b in (band, band + 1):
            largest = FIRST_BAND * 2 ** (b + 1) - 1
            partner = min(largest, 4 * n // 3)
            if partner < FIRST_BAND * 2**b:
                continue  # no partner so large
            need = (n + partner) // 7 + least_shared(n)
            m = int(SEGMENT_SHARE * largest) + 2
            segment = (mixed % np.uint64(m)).astype(np.intp)
            sizes, sums = np.bincount(segment, minlength=m), np.zeros(m, np.uint64)
            np.add.at(sums, segment, mixed)
            places = np.flatnonzero(sizes)
            subsets = scramble(sums[places] + places.astype(np.uint64) * ODD + np.uint64(b))
            rank = np.uint64(63) - np.minimum(sizes[places], 63).astype(np.uint64)  # large subsets first
            out.append(np.sort((rank << np.uint64(58)) | (subsets >> np.uint64(6)))[:need])
            poor |= need > len(places)
        if poor:
            out.append(np.sort(scramble(found ^ ODD))[: n - -(-3 * n // 4) + least_shared(n)])
    return scramble(np.concatenate(out) ^ np.uint64(n <= 2)) if out else np.zeros(0, dtype=np.uint64)


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text), n_shingles, set (null if there are no shingles)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [(len(s), set_id(s) if len(s) else None) for s in sets_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in sets], pa.int64()), pa.array([name for _, name in sets], pa.int64())],
                names=["doc_id", "_h", "n_shingles", "set"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, _h long, n_shingles long, set long")


def index_rows(docs: DataFrame) -> DataFrame:
    """(token, set): what each set is indexed under, a set once per task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = set()
        for batch in batches:
            tokens, sets, held = [], [], 0
            for found in sets_of(batch.column(0)):
                if len(found) < 3 or (name := set_id(found)) in seen:
                    continue
                seen.add(name)
                own = index_tokens(found)
                tokens.append(own.view(np.int64))
                sets.append(np.full(len(own), name))
                held += len(own)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(sets))], names=["token", "set"])
                    tokens, sets, held = [], [], 0
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(sets))], names=["token", "set"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "token long, set long")


def shared_tokens(index: DataFrame) -> DataFrame:
    """(token, set) of the tokens that two different sets have.

    Tokens come as sorted runs; what is held is one batch and the state of the run that reaches into the next.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token, first, last, told = None, None, None, False
        for batch in batches:
            t, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(t):
                continue
            begins = np.append(True, t[1:] != t[:-1])
            firsts = s[np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))]
            again = np.append(False, (t[1:] == t[:-1]) & (s[1:] == s[:-1]))
            if t[0] == token:  # the run of the batch before goes on
                firsts[: int(np.argmin(np.append(t == token, False)))] = first
                again[0] = s[0] == last
            later = ~again & (s != firsts)
            # the first set of each run that has a second one
            heads = np.unique(np.stack([t[later], firsts[later]]), axis=1)
            if token is not None and told:
                heads = heads[:, heads[0] != token]
            told = bool(later[t == t[-1]].any()) or (told and t[-1] == token)
            token, first, last = t[-1], firsts[-1], s[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(t[later], heads[0])), pa.array(np.append(s[later], heads[1]))], names=["token", "set"])

    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = index.repartition(parts, "token").sortWithinPartitions("token", "set")
    return ordered.mapInArrow(run, "token long, set long")


def with_partners(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, set, n) without the sets that share too few tokens."""
    sizes = sets.where("set is not null").groupBy("set").agg(F.max("n_shingles").alias("n"))
    counts = shared.groupBy("set").agg(F.count(F.lit(1)).alias("shared"))
    least = F.greatest(F.floor(F.floor(F.col("n") * 3 / 4) / SHARED_PART), F.lit(1))  # a partner has three quarters of the shingles or more
    keep = stored(counts.join(sizes, "set").where(F.col("shared") >= least).select("set", "n"), "keep")
    return attach(shared, keep, ["set"])


def hub_pairs(rows: DataFrame, hubs: DataFrame | None = None, compared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(v, hub): each set v of ``rows`` (token, set, n, root) with the hub of one of its tokens, of another component, of fitting
    size and with most tokens in common; and the hubs (token, set) themselves.

    A token's hub is the set whose tokens have most sets together: in a group of copies of one text that is the text, which
    the copies resemble more than one another.  In later rounds components that have a hub in the token already name no more.
    """
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_k"))
    weights = rows.join(sizes, "token").groupBy("set").agg(F.sum("_k").alias("_w"))
    weighted = attach(rows, stored(weights, "weights"), ["set"])
    if hubs is not None:
        roots = rows.select("token", "set", "root").join(hubs, ["token", "set"]).select("token", "root").distinct()
        weighted = weighted.join(roots, ["token", "root"], "left_anti")
    chosen = stored(weighted.groupBy("token").agg(F.max(F.struct("_w", "set", "n", "root")).alias("_f")), "hubs")
    met = rows.join(chosen, "token").where(F.col("root") != F.col("_f.root"))
    fits = 4 * F.least("n", "_f.n") >= 3 * F.greatest("n", "_f.n")
    counts = met.where(fits).groupBy(F.col("set").alias("v"), F.col("_f.set").alias("hub")).agg(F.count(F.lit(1)).alias("_k"))
    if compared is not None:
        counts = counts.join(compared, ["v", "hub"], "left_anti")
    best = counts.groupBy("v").agg(F.max(F.struct("_k", "hub")).alias("_best")).select("v", F.col("_best.hub").alias("hub"))
    return stored(best, "pairs"), chosen.select("token", F.col("_f.set").alias("set"))


def mixed_groups(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows, with their component's root, of the tokens that more than one component has."""
    at = attach(shared, roots.withColumnRenamed("node", "set"), ["set"], "left").withColumn("root", F.coalesce("root", "set"))
    mixed = at.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("token")
    return stored(at.join(mixed, "token"), "open")


def shingle_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, n, small, found) of the wanted sets, each from one document: the shingles, and their distinct last 16 bits."""
    places = only(sets, wanted, "set").groupBy("set").agg(F.min(F.struct("doc_id", "_h")).alias("_d")).select("set", F.col("_d.doc_id").alias("_id"), F.col("_d._h").alias("_k"))
    places = stored(places, "places")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("text"))
    right = bounded(places)
    rows = rows.join(right, rows["doc_id"].eqNullSafe(right["_id"]) & (rows["_h"] == right["_k"])).select("set", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [f.view(np.int64) for f in sets_of(batch.column(1))]
            small = [distinct(f.astype(np.int16)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array(small, pa.list_(pa.int16())),
                                              pa.array(found, pa.list_(pa.int64()))], names=["set", "n", "small", "found"])

    return rows.mapInArrow(run, "set long, n int, small array<short>, found array<long>")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with a Jaccard similarity of 3/4 or more.

    The last 16 bits of the shingles bound the intersection from above; only pairs that pass get their whole sets compared.
    """

    def met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        side = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"_n{x}"), F.col(column).alias(f"_{x}"))
        return pairs.join(side("v"), "v").join(side("u"), "u").withColumn("_both", F.size(F.array_intersect("_u", "_v")))

    enough = lambda common: common * 7 >= (F.col("_nu") + F.col("_nv")) * 3
    lost = F.least(F.col("_nu") - F.size("_u"), F.col("_nv") - F.size("_v"))  # shingles that share their last bits within a set
    close = stored(met(pairs, sets, "small").where(enough(F.col("_both") + lost)).select("u", "v"), "close")
    near = stored(close.select(F.explode(F.array("u", "v")).alias("set")).distinct(), "near")
    return met(close, only(sets, near, "set"), "found").where(enough(F.col("_both"))).select("u", "v")


def without_loners(open_: DataFrame, own: DataFrame) -> DataFrame:
    """``open_`` with ``c``, the number of a set's shingles that other open sets have too; sets with too small a ``c`` go.

    A shingle of a single set is in no intersection, so two sets share at most the smaller ``c`` and link only if
    7 c >= 3 (|r| + |s|); a partner has c shingles at least, so a set with 4 c < 3 n has none.
    """
    alone = own.groupBy("_s").agg(F.max("set").alias("set"), F.count(F.lit(1)).alias("_k")).where("_k = 1")
    alone = stored(alone.groupBy("set").agg(F.count(F.lit(1)).alias("_alone")), "alone")
    counted = attach(open_, alone, ["set"], "left").withColumn("c", F.col("n") - F.coalesce("_alone", F.lit(0)))
    return counted.where(4 * F.col("c") >= 3 * F.col("n")).drop("_alone")


def off_hub(compared: DataFrame, found: DataFrame, open_sets: DataFrame) -> DataFrame:
    """(set, both, off) of the open sets that are not linked with their hub: the size of the intersection with the one of
    their hubs that they resemble most, and the shingles that it has not."""
    mine = found.select(F.col("set").alias("v"), F.col("n").alias("_nv"), F.col("found").alias("_v"))
    hubs = found.select(F.col("set").alias("hub"), F.col("n").alias("_nh"), F.col("found").alias("_h"))
    met = compared.join(open_sets.select(F.col("set").alias("v")), "v", "left_semi").join(mine, "v").join(hubs, "hub")
    met = met.withColumn("off", F.array_except("_v", "_h")).withColumn("both", F.col("_nv") - F.size("off"))
    best = met.groupBy("v").agg(F.max_by(F.struct("both", "off", "_nv", "_nh"), "both").alias("_b")).select(F.col("v").alias("set"), "_b.*")
    return best.where(7 * F.col("both") < 3 * (F.col("_nv") + F.col("_nh"))).select("set", "both", "off")


def remaining_pairs(open_: DataFrame, own: DataFrame, off: DataFrame) -> DataFrame:
    """(u, v) of different components that may still be linked.

    A set u that shares ``both`` shingles with a hub shares at most ``both`` plus k with v, if v has k of u's shingles that the
    hub has not.  Where ``both`` alone is too little for a link, the pair is found by joining those shingles, which are rare,
    instead of the tokens, which a whole group of copies shares.  The other pairs (the partner much smaller than the hub, or
    both linked with a hub of their own) meet by tokens.
    """
    facts = stored(attach(open_.select("set", "n", "c", "root").distinct(), off.select("set", "both"), ["set"], "left"), "facts")
    side = lambda x: [F.col("set").alias(x), *[F.col(k).alias(f"_{k}{x}") for k in ("n", "c", "root", "both")]]
    fits = (F.col("_rootu") != F.col("_rootv")) & (4 * F.least("_nu", "_nv") >= 3 * F.greatest("_nu", "_nv"))
    fits = fits & (7 * F.least("_cu", "_cv") >= 3 * (F.col("_nu") + F.col("_nv")))
    short = lambda x: F.coalesce(7 * F.col(f"_both{x}") < 3 * (F.col("_nu") + F.col("_nv")), F.lit(False))

    rare = attach(off.select("set", F.explode("off").alias("_s")), facts, ["set"]).select("_s", *side("u"))
    all_ = attach(own, facts, ["set"]).select("_s", *side("v"))
    by_shingle = rare.join(all_, "_s").where(fits & short("u")).groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("_k"), F.max(F.col("_nu") + F.col("_nv")).alias("_n"), F.max("_bothu").alias("_both"))
    by_shingle = by_shingle.where(7 * (F.col("_both") + F.col("_k")) >= 3 * F.col("_n"))

    rows = attach(open_.select("token", "set"), facts, ["set"])
    met = rows.select("token", *side("u")).join(rows.select("token", *side("v")), "token")
    met = met.where(fits & (F.col("u") < F.col("v")) & ~short("u") & ~short("v"))
    by_token = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("_k"), F.min(F.least("_nu", "_nv")).alias("_n"))
    by_token = by_token.where(F.col("_k") >= F.greatest(F.floor(F.col("_n") / SHARED_PART), F.lit(1)))
    return by_shingle.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(by_token.select("u", "v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; ``_h`` tells equal doc_ids apart."""
    return classes(docs).drop("_class")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to a Python worker by BATCH_BYTES at once, which is less than the usual number of rows."""
    before = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_LIMIT) if before is None else spark.conf.set(BATCH_LIMIT, before)


def classes(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with ``_class``, which differs between components even where their least doc_ids are equal or null."""
    with small_batches(docs.sparkSession), small_broadcasts(docs.sparkSession):
        return _classes(docs)


def _classes(docs: DataFrame) -> DataFrame:
    sets = stored(with_sets(docs), "sets")
    tokens = stored(shared_tokens(index_rows(docs)), "tokens")
    shared = stored(with_partners(tokens, sets), "shared")
    discard(tokens)
    found = stored(shingle_sets(docs, sets, stored(shared.select("set").distinct(), "wanted")), "shingles")
    open_, hubs, compared, roots = shared.withColumn("root", F.col("set")), None, None, None
    for _ in range(ROUNDS):
        pairs, chosen = hub_pairs(open_, hubs, compared)
        new = stored(links(pairs.select(F.least("v", "hub").alias("u"), F.greatest("v", "hub").alias("v")).distinct(), found), "links")
        hubs = chosen if hubs is None else hubs.unionByName(chosen)
        compared = pairs if compared is None else compared.unionByName(pairs)
        roots = stored(components(new if roots is None else as_edges(roots).unionByName(new)), "roots")
        open_ = mixed_groups(shared, roots)

    opened = stored(open_.select("set").distinct(), "opened")
    own = stored(only(found, opened, "set").select("set", F.explode("found").alias("_s")), "own")
    open_ = stored(without_loners(open_, own), "open")
    opened = stored(open_.select("set").distinct(), "opened")
    off = stored(off_hub(compared, found, opened), "off")
    rest = remaining_pairs(open_, only(own, opened, "set"), off).join(compared.select(F.least("v", "hub").alias("u"), F.greatest("v", "hub").alias("v")), ["u", "v"], "left_anti")
    more = links(stored(rest, "pairs"), found)
    roots = stored(components(as_edges(roots).unionByName(more)), "roots")

    rows = attach(sets, roots.withColumnRenamed("node", "set"), ["set"], "left").withColumn("_c", F.coalesce("root", "set"))
    least = rows.where(F.col("_c").isNotNull()).groupBy("_c").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = attach(rows, stored(least.select("_c", "_least"), "classes"), ["_c"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"), "_h", F.col("_c").alias("_class"))
