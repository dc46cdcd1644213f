"""The slots of a mix grow with the words, so they meet the documents by a shuffle, however small Spark takes them for."""

import re

from riskframe.llm import mixing


def test_slots_are_not_broadcast(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 50) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    _, mixed = mixing.mix(docs, block_words=8)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[src#\d+L, block#\d+L\]", plan)
    assert joins and set(joins) == {"SortMergeJoin"}
    assert 29_000 <= mixed.agg({"words": "sum"}).first()[0] <= 31_000
