"""Corpus pipeline: quality, near duplicates, benchmark passages, source mix, shards.

Each stage takes the documents that its predecessor kept and returns documents with the same columns, the last one a row
per document with its shard.  Decisions travel to the texts as short tables: the rows to drop are broadcast when a count
shows that they are few, else joined.  Equal doc_ids are told apart by a hash of the text; null doc_ids and texts stay
documents like others; empty tables pass through.  Further columns travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, jaccard_join, mixing, quality, sharding
from riskframe.llm.common import attach, bounded, n_words, stored, table


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has, whatever their case."""
    taken = [c.lower() for c in docs.columns]
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def _without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """Documents that are not (``left_semi``: that are) among ``gone`` (doc_id, _h)."""
    key, digest = _fresh(docs, "id", "h")
    gone = stored(gone.select(F.col("doc_id").alias(key), F.col("_h").alias(digest)).distinct(), "gone")
    return docs.join(bounded(gone), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest)), how)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id; documents without words stay."""
    rows = stored(jaccard_join.classes(docs), "near").where("n_shingles > 0")
    id_last = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_h")
    first = rows.groupBy("_class").agg(F.min(id_last).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = stored(first.select("_class", F.col("_first.doc_id").alias("_fid"), F.col("_first._h").alias("_fh")), "firsts")
    later = attach(rows, first, ["_class"]).where(~(F.col("doc_id").eqNullSafe(F.col("_fid")) & (F.col("_h") == F.col("_fh"))))
    kept = _without(docs, later)
    twice = stored(rows.groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "twice")
    if twice.isEmpty():
        return kept
    digest, = _fresh(docs, "digest")
    again = _without(kept, twice, "left_semi").withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest])
    return _without(kept, twice).unionByName(again.drop(digest))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times (0 to 2) as the mix takes its words, to the nearest whole number."""
    keys = ["doc_id", "source", "size"]
    taken = mixing.taken_words(docs).groupBy(*keys).agg((F.sum("taken") / F.sum("size")).alias("_times")).where("size > 0")
    doc_id, source, size, copies, words, copy = _fresh(docs, "doc_id", "source", "size", "copies", "words", "copy")
    times = taken.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.col("size").alias(size),
                         F.floor(F.col("_times") + 0.5).cast("int").alias(copies)).where(F.col(copies) > 0)
    sized = docs.withColumn(words, n_words(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    out = sized.join(times, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document of the mix."""
    return sharding.shard(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
ORACLE_SQL = None  # a trained classifier is no SQL; tests/llm/test_pipeline.py compares the stages with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
