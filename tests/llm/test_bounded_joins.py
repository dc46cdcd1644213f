"""Key tables above the counted bound are joined by a shuffle at any threshold of Spark's own, also when Spark takes them for small."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import common, jaccard_join


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 3, 7).when(F.col("id") % 10 > 3, F.col("id")).alias("k"))
    dimension = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    yield common.stored(rows, "rows"), common.stored(dimension, "dimension")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def joins(df):
    return set(re.findall(r"\w+Join(?= )", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_shuffles_what_unfolds(tables, how):
    rows, dimension = tables
    out = common.attach(rows, dimension, ["k"], how)
    assert joins(out) == {"SortMergeJoin"}
    got = {r["id"]: r["v"] for r in out.collect()}
    keys = {i: 7 if i % 10 < 3 else i if i % 10 > 3 else None for i in range(3000)}
    want = {i: 0 if k is None else 2 * k if 0 < k < 1000 else None for i, k in keys.items()}
    assert got == {i: v for i, v in want.items() if how == "left" or v is not None}


def test_only_shuffles_many_keys(tables):
    rows, dimension = tables
    out = common.only(rows, dimension.select("k"), "k")
    assert joins(out) == {"SortMergeJoin"}
    assert out.count() == 900 + sum(1 for i in range(1000) if i % 10 > 3)


def test_few_keys_need_no_shuffle(tables):
    rows, dimension = tables
    few = common.stored(dimension.where("k < 50"), "few")
    assert joins(common.attach(rows, few, ["k"])) == joins(common.only(rows, few.select("k"), "k")) == {"BroadcastHashJoin"}


@pytest.mark.parametrize(("limit", "inside"), [("10485760b", 2**20), ("10MB", 2**20), ("256k", 2**18), ("-1", -1), ("0", 0)])
def test_spark_guesses_within_a_bound(spark, limit, inside):
    name = common.GUESSES[0]
    spark.conf.set(name, limit)
    try:
        with common.small_broadcasts(spark):
            assert int(spark.conf.get(name).rstrip("b")) == inside
        assert spark.conf.get(name) == limit and spark.conf.get(common.GUESSES[1], None) is None
    finally:
        spark.conf.unset(name)


def test_near_duplicates_run_within_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name, real=jaccard_join.stored: seen.append(spark.conf.get(common.GUESSES[0])) or real(df, name))
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in (1, 1, 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(0, 0), (1, 0), (2, 2)]
    assert {int(x.rstrip("b")) for x in seen} == {common.BROADCAST_BYTES}
    assert spark.conf.get(common.GUESSES[0]) == "10485760b"


@pytest.mark.parametrize(("how", "left"), [("left_anti", 2000), ("left_semi", 1000)])
def test_many_dropped_documents_are_shuffled(tables, spark, how, left):
    docs = common.stored(spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), "docs")
    gone = docs.where("doc_id % 3 = 0").select("doc_id", F.xxhash64("text").alias("_h"))
    out = corpus_pipeline._without(docs, gone, how)
    assert joins(out) == {"SortMergeJoin"} and out.count() == left
