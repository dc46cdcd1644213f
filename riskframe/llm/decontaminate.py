"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are runs of WINDOW consecutive words that must be contained whole, so one shingle is a sufficient prefix:
the two neighbouring words of the window that are rarest, by the product of their document counts over all documents.
Documents are scanned for these prefix shingles only; a hit at position i whose shingle stands at offset o in a window is
a candidate that starts at i - o.  The positional bound (start not before the text) and the length bound (window ends
inside it) are applied, then the window's words are compared one by one.

Scale: texts are never shuffled or copied per word: token hits are found inside the row by a hash-set test, and only hits
with the few words around them leave it.  Benchmarks are taken in blocks of about BLOCK windows, so what is broadcast is
bounded whatever the benchmark's size; each block is one pass that counts words and one that looks for windows.

Nulls and other cases: null texts have no words; null and repeated doc_ids are values like others, equal rows get equal
results; items without words have no windows; equal windows of several items count for each item; null item_ids are not
listed.  Empty tables give no hits.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalars import let
from riskframe.llm.common import stored

WINDOW = 10
BLOCK = 20_000
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # fixed value of the query contract: what is in no word, in either case of A-Z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other characters unchanged; plain ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of a text as it stands; cutting between words is several times faster than matching them."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def shingle(first: Column, second: Column) -> Column:
    """Hash of two neighbouring words, or of a word alone; equality of the words is checked later."""
    return F.xxhash64(first, F.coalesce(second, F.lit("")))


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window): all runs of ``width`` words, the whole item if it has fewer."""
    items = benchmark.select("item_id", words_of(lowered(F.col("text"))).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, width))).alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, _h, start, length, item_id) for one block of windows."""
    vocabulary = [r[0] for r in windows.select(F.explode("window").alias("w")).distinct().collect()]  # bounded by the block
    words = docs.select(words_of(lowered(F.col("text"))).alias("_w"))
    seen = words.select(F.explode(F.array_distinct(F.filter("_w", lambda w: w.isin(vocabulary)))).alias("w"))
    counts = windows.sparkSession.createDataFrame([(w, 0) for w in vocabulary], "w string, n long").unionByName(
        seen.groupBy("w").agg(F.count(F.lit(1)).alias("n"))).groupBy("w").agg(F.sum("n").alias("n"))
    placed = windows.select("item_id", "window", F.posexplode("window").alias("offset", "w")).withColumn("w2", F.get("window", F.col("offset") + 1))
    placed = placed.where(F.col("w2").isNotNull() | (F.size("window") == 1))
    second = counts.select(F.col("w").alias("w2"), F.col("n").alias("n2"))
    rare = (F.col("n") * F.coalesce("n2", F.lit(1))).alias("n")
    rarest = (placed.join(F.broadcast(counts), "w").join(F.broadcast(second), "w2", "left").groupBy("item_id", "window")
              .agg(F.min(F.struct(rare, "w", "w2", "offset")).alias("_r"))
              .select("item_id", "window", F.col("_r.w").alias("token"), shingle(F.col("_r.w"), F.col("_r.w2")).alias("shingle"), F.col("_r.offset").alias("offset")))
    rarest = stored(rarest, "windows")
    tokens = [r[0] for r in rarest.select("token").distinct().collect()]
    pairs = [r[0] for r in rarest.select("shingle").distinct().collect()]

    def around(words: Column) -> Column:
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(tokens), i)), lambda i: i.isNotNull())
        both = lambda i: F.array(shingle(F.get(words, i), F.get(words, i + 1)), shingle(F.get(words, i), F.lit(None).cast("string")))
        found = F.filter(F.flatten(F.transform(starts, lambda i: F.transform(both(i), lambda s: F.struct(i.alias("i"), s.alias("shingle"))))), lambda x: x["shingle"].isin(pairs))
        near = lambda i: F.transform(F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.least(i + width, F.size(words)) - 1), lambda j: F.get(words, j))
        return F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["shingle"].alias("shingle"), F.least(x["i"], F.lit(width - 1)).alias("back"), near(x["i"]).alias("near")))

    # the words are bound once per row: as a plain column they would be cut anew for every hit
    hits = F.explode(let(words_of(lowered(F.col("text"))), around))
    near = docs.select("doc_id", F.xxhash64("text").alias("_h"), hits.alias("_a")).select("doc_id", "_h", "_a.*")
    at = F.col("back") - F.col("offset")
    fits = (at >= 0) & (at + F.size("window") <= F.size("near"))
    exact = near.join(F.broadcast(rarest), "shingle").where(fits).where(F.slice("near", F.greatest(at, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    return exact.select("doc_id", "_h", (F.col("i") - F.col("offset")).alias("start"), F.size("window").alias("length"), "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; ``_h`` (hash of the text) tells equal doc_ids apart."""
    windows = stored(item_windows(benchmark, width), "item-windows")
    blocks = max(1, -(-windows.count() // BLOCK))
    parts = [windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, [window_hits(docs, p, width) for p in parts])
    ranges = F.collect_set(F.struct("start", "length"))
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_k")).agg(
        F.size(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    base = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(per, base["doc_id"].eqNullSafe(per["_id"]) & (base["_h"] == per["_k"]), "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "_h")
