"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Items are sorted by size; each enters the bin with the tightest remaining capacity that still holds it, found in a
balanced tree over (remaining capacity, bin).  The capacity is fixed while packing; the smallest one that needs no more
than the wanted number of bins is searched, so all shards come out near equal in bytes.

Scale: bins are packed from a bounded list of items, whatever the number of rows.  A group of at least 1/512 of a shard is
an item of its own, so there are at most 512 per shard.  Smaller groups are bundled by hash into 1,024 bundles per shard,
a whole group in one bundle.  Only a group larger than a shard (all bytes / number of shards) is cut: it becomes items by
hash of doc_id, which are packed in runs of up to half a shard.  Where many groups lie between half a shard and a shard,
whole groups count more than equal shards.  Sizes are summed before any shuffle, the item table is broadcast (its bound is
above), and rows never meet by group: a copied text with a third of all rows moves nothing.

Nulls and other cases: a null text counts as empty and belongs to the group of empty texts; null and repeated doc_ids are
values like others; equal rows get slots next to each other.  With fewer groups than shards some shards stay empty.
Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored, text_key
from riskframe.operators import ordering

SHARDS = 40
ROW_BYTES = 16
BUNDLES_PER_SHARD, ITEMS_PER_SHARD, CUTS = 1024, 512, 4096


def best_fit(items: list[tuple[int, int]], bins: int, capacity: int) -> list[int] | None:
    """Bin of each (size, number) item, given in descending size; None if they don't fit."""
    free = [(capacity, b) for b in range(bins)]  # a sorted list of one entry per bin serves as the tree
    out = []
    for size, _ in items:
        at = bisect_left(free, (size, -1))
        if at == len(free):
            return None
        left, b = free.pop(at)
        insort(free, (left - size, b))
        out.append(b)
    return out


def pack(sizes: dict, bins: int, slack: float = 1e-4) -> dict:
    """Bin of each key, at the least capacity (within ``slack``) that needs no more than ``bins`` bins."""
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    items = [(sizes[k], i) for i, k in enumerate(order)]
    low = max(-(-sum(sizes.values()) // bins), max(sizes.values(), default=0))
    found, high = best_fit(items, bins, low), low
    step = max(1, int(low * slack))
    while found is None:
        low, high = high, high + step
        found, step = best_fit(items, bins, high), step * 2
    while high - low > max(1, int(high * slack)):
        middle = (low + high) // 2
        trial = best_fit(items, bins, middle)
        low, high, found = (middle, high, found) if trial is None else (low, middle, trial)
    return dict(zip(order, found, strict=True))


def runs_of_cuts(cuts: list[tuple[tuple, int]], most: int) -> dict:
    """Put the cuts of one large group into runs of at most ``most`` bytes, in order."""
    out, run, held = {}, 0, 0
    for key, size in cuts:
        if held and held + size > most:
            run, held = run + 1, 0
        out[key] = run
        held += size
    return out


def shard(docs: DataFrame, shards: int = SHARDS, extra: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; ``extra`` names more columns of ``docs`` to carry along."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("_group"), *(extra or []))
    rows = stored(rows, "shard-rows")
    bundles = shards * BUNDLES_PER_SHARD
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("bytes")), "shard-groups")
    whole = groups.agg(F.sum("bytes")).first()[0] or 0
    share = whole / shards
    bundle: Column = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int")
    large = groups.where(F.col("bytes") >= max(1.0, share / ITEMS_PER_SHARD))
    small = groups.where(F.col("bytes") < max(1.0, share / ITEMS_PER_SHARD))
    cut: Column = F.pmod(F.xxhash64("doc_id"), F.lit(CUTS)).cast("int")

    sizes: dict[tuple, int] = {("b", r["b"], 0): r["n"] for r in small.groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("n")).collect()}
    sizes |= {("g", bytes(r["_group"]), 0): r["bytes"] for r in large.where(F.col("bytes") <= share).collect()}
    huge = F.broadcast(large.where(F.col("bytes") > share).select("_group"))  # fewer than there are shards
    cuts: dict[bytes, list] = {}
    for r in rows.join(huge, "_group").groupBy("_group", cut.alias("c")).agg(F.sum("size").alias("n")).orderBy("_group", "c").collect():
        cuts.setdefault(bytes(r["_group"]), []).append(((bytes(r["_group"]), r["c"]), r["n"]))
    run_of: dict[tuple, int] = {}
    for group, parts in cuts.items():
        run_of |= (runs := runs_of_cuts(parts, int(share / 2)))
        for key, size in parts:
            item = ("g", group, runs[key])
            sizes[item] = sizes.get(item, 0) + size
    bins = pack(sizes, shards) if sizes else {}

    spark = docs.sparkSession
    by_bundle = spark.createDataFrame([(k[1], b) for k, b in bins.items() if k[0] == "b"], "_bundle int, _by_bundle int")
    by_group = spark.createDataFrame([(k[1], b) for k, b in bins.items() if k[0] == "g" and k[1] not in cuts], "_group binary, _by_group int")
    by_cut = spark.createDataFrame([(g, c, bins["g", g, run]) for (g, c), run in run_of.items()], "_group binary, _cut int, _by_cut int")
    out = (rows.withColumn("_bundle", bundle).withColumn("_cut", cut)
           .join(F.broadcast(by_group), "_group", "left").join(F.broadcast(by_cut), ["_group", "_cut"], "left")
           .join(F.broadcast(by_bundle), "_bundle", "left")
           .withColumn("shard", F.coalesce("_by_cut", "_by_group", "_by_bundle")))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    out = out.withColumn("_at", order).withColumn("_head", F.substring("_at", 1, ordering.HASH_BUCKET_DIGITS))
    out = ordering.running_totals(out, ["shard"], ["_head"], ["_at", "doc_id", "size"], {"_place": F.lit(1)})
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - 1).cast("long").alias("slot"), *(extra or []))
