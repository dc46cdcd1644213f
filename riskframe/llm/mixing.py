"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream: its documents in seeded hash order, repeated without end and cut into blocks of equally many
words.  The schedule has 2^K slots.  Slot t stands at the van der Corput point of t (its K bits reversed, over 2^K); the
cumulative target shares of the sources cut [0, 1), and the slot belongs to the source whose stretch holds its point.  All
2^K points are spread evenly, so a source gets its share of slots up to one, in every stretch of the schedule almost as
evenly.  A source's slots are ranked in schedule order, and its k-th slot takes its k-th block.

Scale: only (source, document, size) rows move, never texts.  Running positions and slot ranks are taken inside buckets
(hash heads, runs of 65,536 slots) whose totals alone are accumulated; the slots of a source are unfolded in blocks; slots
and document pieces meet on (source, block), keys that a few rows have at most, so a source with a third of all rows is
spread.  The table of sources is broadcast only below a counted bound.

Nulls and other cases: a null text has size 0; a null source is a source of its own, the last; a null doc_id is a value
like others.  Documents without words are returned with ``taken`` 0.  Equal rows take neighbouring places and stay
separate rows.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import attach, globally_ordered, n_words, stored
from riskframe.operators import ordering

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2  # of all words; of a source's words
BLOCK_WORDS = 256
RUN_BITS = 16  # slots are ranked in runs of 2^RUN_BITS


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: number ``src``, ``weight``, ``source_size``, ``target``.

    Targets fill up like water: target = min(most x size, level x weight), at the level where they sum up to share x all
    words.  Capping the sources with the smallest size per weight first gives a bound from below for the level; the largest
    of these bounds is the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = globally_ordered(per, [F.col("source").asc_nulls_last()], {}).withColumn("src", F.col("place") - 1).drop("place")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    caps = per.withColumn("_cap", F.col("source_size") * most)
    filled = globally_ordered(caps, [F.col("_cap") / F.col("weight"), F.col("src")], {"_caps": "_cap", "_weights": "weight"}).drop("place")
    filled = stored(filled, "filled")
    whole = filled.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not whole["n"]:
        return filled.withColumn("target", F.lit(0.0)).drop("_cap", "_caps", "_weights")
    goal = share * whole["n"]
    open_weight = F.lit(whole["w"]) - F.col("_weights")
    level = filled.where(open_weight > 0).agg(F.max((F.lit(goal) - F.col("_caps")) / open_weight).alias("x")).first()["x"]
    level = max(goal / whole["w"], level if level is not None else 0.0)
    return filled.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("weight"))).drop("_cap", "_caps", "_weights")


def schedule(sources: DataFrame, bits: int) -> DataFrame:
    """The mix: one row (slot, src, block) for each of the 2^bits slots."""
    shares = globally_ordered(sources.where("target > 0"), [F.col("src")], {"_end": "target"})
    whole = shares.agg(F.max("_end")).first()[0] or 1.0
    at: Column = lambda c: F.ceil(c / F.lit(whole) * F.lit(float(2**bits))).cast("long")
    runs = shares.select("src", at(F.col("_end") - F.col("target")).alias("_from"), at(F.col("_end")).alias("_to"))
    points = ordering.replicate(runs.withColumn("_n", F.col("_to") - F.col("_from")), "_n", "_i", ["src"])
    point = F.col("_from") + F.col("_i") - 1
    slot = F.conv(F.reverse(F.lpad(F.bin(point), max(bits, 1), "0")), 2, 10).cast("long")
    slots = points.select("src", slot.alias("slot")).withColumn("_run", F.shiftright("slot", RUN_BITS))
    ranked = ordering.running_totals(slots, ["src"], ["_run"], ["slot"], {"_rank": F.lit(1)})
    return ranked.select("slot", "src", (F.col("_rank") - 1).cast("long").alias("block"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
        block_words: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents with their places, the mix).

    The first has doc_id, source, size, source_size, target and the place ``start`` in the source's stream.  The second has
    one row per piece of a document in the mix: slot, src, start, copy (0: first round of the source), words.
    """
    sized = sizes_of(docs)
    sources = stored(source_targets(sized, weights, share, most), "sources")
    total = sources.agg(F.round(F.sum("target"), 3)).first()[0] or 0.0
    bits = max(0, int(max(total / block_words, 1) - 1e-9).bit_length())
    width = total / 2**bits

    merged = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_copies"))
    rows = attach(merged, sources.select("source", "src", "source_size", "target"), ["source"])
    rows = rows.withColumn("_at", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))))
    rows = rows.withColumn("_head", F.substring("_at", 1, ordering.HASH_BUCKET_DIGITS))
    placed = ordering.running_totals(rows, ["src"], ["_head"], ["_at", "doc_id", "size"],
                                     {"_end": F.col("size") * F.col("_copies")}).drop("_end_total", "_at", "_head")
    first = F.col("_end") - F.col("size") * F.col("_copies")
    placed = ordering.replicate(placed.withColumn("_first", first), "_copies", "_copy", ["src", "doc_id"])
    placed = placed.withColumn("start", F.col("_first") + F.col("size") * (F.col("_copy") - 1)).drop("_first", "_end", "_copies")
    placed = stored(placed, "placed")
    if not total:
        return placed, placed.where("false").select(F.lit(0).cast("long").alias("slot"), "src", "start", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("words"))

    rounds = placed.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    begin = F.col("start") + F.col("copy") * F.col("source_size")
    rounds = rounds.withColumn("_p", begin).where(F.col("_p") < F.col("target") + 2 * width)
    stop = F.col("_p") + F.col("size")
    blocks = F.sequence(F.greatest(F.floor(F.col("_p") / width) - 1, F.lit(0).cast("long")), F.floor(stop / width) + 1)
    pieces = rounds.select("src", "start", "copy", "_p", stop.alias("_q"), F.explode(blocks).alias("block"))
    edge: Column = lambda k: F.floor(k * F.lit(width))
    taken = F.least("_q", edge(F.col("block") + 1)) - F.greatest("_p", edge(F.col("block")))
    pieces = pieces.withColumn("words", taken).where("words > 0").select("src", "start", "copy", "block", "words")
    # the schedule comes from a few rows, so Spark takes it for small and would broadcast its 2^bits slots
    mixed = schedule(sources, bits).hint("merge").join(pieces, ["src", "block"])
    return placed, mixed.select("slot", "src", "start", "copy", "words")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and the words that the mix takes of each document, repeats counted."""
    placed, mixed = mix(docs, **options)
    keys = ["src", "start", "doc_id", "size", "_copy"]
    sums = mixed.groupBy("src", "start").agg(F.sum("words").alias("_words"))
    with_words, without = placed.where("size > 0"), placed.where("size = 0")
    out = with_words.join(sums, ["src", "start"], "left").withColumn("taken", F.coalesce("_words", F.lit(0)).cast("long"))
    out = out.unionByName(without.withColumn("taken", F.lit(0).cast("long")), allowMissingColumns=True)
    return out.drop(*[k for k in keys if k.startswith("_")], "_words").select("doc_id", "source", "size", "source_size", "target", "taken")
