"""Stages of the corpus pipeline against plain Python: nulls, empty texts, repeated rows, copies, empty tables, clashing columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from riskframe.llm import quality

SCHEMA = "doc_id long, text string, source string, _id long, _k string, _h long, _copies int, size_ int, _doc_id string, __id string, Size int"
CLASH = (7, "k", 8, 9, 15, "d", "u", 3)


def words(n, seed, alphabet=500):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(alphabet)}" for _ in range(n))


def edited(text, place):
    parts = text.split()
    return " ".join(parts[:place] + ["changed"] + parts[place + 1:])


BASE, ITEM = words(200, 1), words(30, 2)
ROWS = [(1, BASE, "a"), (2, BASE, "b"), (3, edited(BASE, 60), "a"), (4, words(150, 3), "a"), (4, words(150, 3), "a"), (5, None, None), (6, "", "b"),
        (7, words(90, 4) + " " + ITEM.upper() + " " + words(20, 5), "b"), (8, words(60, 6), None), (None, words(70, 7), "c"), (None, BASE, "c"),
        (9, "two words", "a"), (10, "two words", "b"), (11, words(5000, 8, 100_000), "c"), (12, words(40, 9), "a"), (12, words(45, 10), "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], SCHEMA).persist()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([("i1", ITEM), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def one_of_each(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[top(i)] = top(j)
    kept = {}
    for i, r in enumerate(rows):
        key = top(i) if sets[i] else ("alone", i)
        rank = (r[0] is None, r[0] or 0)
        if key not in kept or rank < kept[key][0]:
            kept[key] = (rank, r)
    return Counter(r for _, r in kept.values())


def plain(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def whole(df):
    """The user's columns come through as they were."""
    assert df.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    rows = df.select(*df.columns[3:]).distinct().collect()
    assert [tuple(r) for r in rows] in ([], [CLASH])
    return plain(df)


def test_one_of_each(spark, docs, folder):
    assert whole(pipeline.keep_one_of_each(spark, docs, folder)) == one_of_each(ROWS)


def test_decontamination(spark, docs, folder):
    assert whole(pipeline.drop_contaminated(spark, docs, folder)) == Counter(r for r in ROWS if r[0] != 7)


def test_mixing(spark, docs, folder):
    """Every document 0 to 2 times; sources come near their targets, by whole documents."""
    many = spark.createDataFrame([(i, words(20 + i % 30, i), "abc"[min(2, i % 5)], *CLASH) for i in range(600)], SCHEMA)
    got = whole(pipeline.mix_sources(spark, many, folder))
    size = Counter()
    for r in many.collect():
        size[r["source"]] += len(r["text"].split())
    taken = Counter()
    for (_, text, source), n in got.items():
        assert n <= 2
        taken[source] += n * len(text.split())
    total = 1.5 * sum(size.values())
    weights, target, full = dict(zip("abc", (3, 1, 2))), {}, set()
    while True:
        left = total - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weights[s] / sum(weights[t] for t in weights if t not in full) for s in weights}
        over = {s for s in weights if target[s] > 2 * size[s]} - full
        if not over:
            break
        full |= over
    for s in weights:
        assert taken[s] == pytest.approx(target[s], rel=0.1)
    mixed = plain(pipeline.mix_sources(spark, docs, folder))
    assert set(mixed) <= set(ROWS) and not any(t is None or not t.split() for _, t, _ in mixed)


def test_sharding(spark, docs, folder):
    out = pipeline.assign_shards(spark, docs, folder)
    assert out.count() == len(ROWS)
    slots = {}
    for r in out.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))


def test_quality_keeps_what_the_score_accepts(spark, docs, folder):
    texts = {0: "buy now cheap pills click here", 1: "the committee published its annual report"}
    rows = [(i, texts[i % 2] + " " + words(10, i), "a", *CLASH) for i in range(400)] + [(900, None, None, *CLASH), (901, "", "a", *CLASH), (901, "", "a", *CLASH)]
    many = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    kept = whole(pipeline.keep_good(spark, many, folder))
    scores = quality.score(many, quality.fit(many, spark.read.parquet(f"{folder}/labels.parquet")))
    good = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    assert kept == Counter((r[0], r[1], r[2]) for r in rows if r[0] in good)
    assert {i for i in range(400) if i % 2} <= good and not any(i % 2 == 0 for i in good if i < 400)


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, none, folder).count() == 0


def test_fresh_names(docs):
    assert not {n.lower() for n in pipeline._fresh(docs, "id", "h")} & {c.lower() for c in docs.columns}
