"""Small fixtures against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from riskframe.llm import components, decontaminate, features, jaccard_join, mixing, quality, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, size string, key string"


def words(n, seed, alphabet=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(alphabet)}" for _ in range(n))


LONG = words(4000, 1)
PASSAGE = words(120, 2)
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG + " end", "a"), (4, None, None), (5, "", "b"), (6, " \n\t ", "c"), (7, "one", "a"), (8, "One", "a"),
    (9, words(80, 3) + " " + PASSAGE + " " + words(90, 4), "a"), (10, PASSAGE + " " + words(60, 5), "b"), (11, words(300, 6), None), (11, words(300, 7), None),
    (12, words(90, 8), "c"), (12, words(90, 8), "c"), (None, words(100, 9), "a"), (None, words(100, 9), "a"), (13, "é" * 900, "b"), (14, "é" * 901, "b"),
    (15, words(4, 10), "a"), (16, words(4, 10).upper(), "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_suffix_array_is_sorted():
    r = random.Random(3)
    for _ in range(300):
        s = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(spark, docs):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, _ in ROWS]
    for _, b in texts:
        seen.update(b[k:k + 400] for k in range(len(b) - 399))
    want = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[(i, len(b), sum(gone), spans, sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    assert got(suffix_dedup.deduplicated(docs)) == want
    assert suffix_dedup.deduplicated(empty(spark)).count() == 0


def test_substring_dedup(spark, docs):
    last, first = 2**63, {}
    lists = [(i, (t or "").encode().split()) for i, t, _ in ROWS]
    for i, ws in lists:
        for k in range(len(ws) - 49):
            name = tuple(ws[k:k + 50])
            first[name] = min(first.get(name, last), last if i is None else i)
    want = Counter()
    for i, ws in lists:
        gone = set()
        for k in range(len(ws) - 49):
            if first[tuple(ws[k:k + 50])] < (last if i is None else i):
                gone.update(range(k, k + 50))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        want[(i, len(ws), len(gone), sha256(b" ".join(kept)).hexdigest())] += 1
    assert got(substring_dedup.deduplicated(docs)) == want
    assert substring_dedup.deduplicated(empty(spark)).count() == 0


def test_jaccard_join(spark, docs):
    sets = []
    for i, t, _ in ROWS:
        ws = (t or "").encode().lower().split()
        sets.append((i, {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    least = [i for i, _ in sets]
    for _ in sets:
        for x, (_, a) in enumerate(sets):
            for y, (_, b) in enumerate(sets):
                if a and b and 4 * len(a & b) >= 3 * len(a | b):
                    least[x] = min((v for v in (least[x], least[y]) if v is not None), default=None)
    want = Counter((i, len(s), c) for (i, s), c in zip(sets, least))
    assert got(jaccard_join.near_duplicates(docs).drop("_h")) == want
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_jaccard_join_near_the_threshold(spark):
    """Near copies whose similarities lie on both sides of 3/4, some sharing their edits, without the text they come from."""
    r, base, texts = random.Random(5), words(130, 21, 10**6).split(), []
    for i in range(90):
        own = list(base if i % 4 or not texts else r.choice(texts))
        for k in r.sample(range(len(own)), r.randint(1, 6)):
            own[k] = f"x{r.randrange(10**6)}"
        texts.append(own[: r.randint(105, 130)])
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    least = list(range(len(sets)))
    linked = [(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets) if x < y and 4 * len(a & b) >= 3 * len(a | b)]
    for _ in sets:
        for x, y in linked:
            least[x] = least[y] = min(least[x], least[y])
    assert 3 < len(set(least)) < 60  # groups and single ones
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(jaccard_join.near_duplicates(df).drop("_h")) == Counter((i, len(s), c) for i, (s, c) in enumerate(zip(sets, least)))


def test_jaccard_join_of_a_large_group(spark):
    """3,000 near copies of one text, most of them around 3/4 from it, some with edits of their own in common."""
    r, base, texts = random.Random(8), words(100, 31, 10**6).split(), []
    for i in range(3000):
        own = list(base)
        for k in r.sample(range(100), r.randint(2, 4)):
            own[k] = f"x{r.randrange(40)}"
        texts.append(own[: 100 - r.choice([0, 0, 0, 1, 5])] + [f"y{r.randrange(30)}"] * r.choice([0, 2]))
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    sizes = has.sum(1)
    linked = 7 * (has @ has.T) >= 3 * (sizes[:, None] + sizes[None, :])
    least, before = np.arange(len(sets)), None
    while before is None or (before != least).any():
        before, least = least, np.where(linked, least[None, :], len(sets)).min(1)
    assert 20 < len(set(least)) < 2500
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(jaccard_join.near_duplicates(df).drop("_h")) == Counter((i, len(s), int(c)) for i, (s, c) in enumerate(zip(sets, least)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45)]
    found = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 1 for i in range(1, 31)}, 40: 40, 45: 40, 50: 40}


def test_decontamination(spark, docs):
    items = [(1, words(30, 2)), (2, "one"), (3, None), (4, ""), (5, PASSAGE.upper()), (6, words(40, 77))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(docs, bench).drop("_h").collect() if r[0] is not None}
    both = sha256(b"1,5").hexdigest()
    assert rows[9] == (290, 120, 2, both, True) and rows[10] == (180, 120, 2, both, True)
    assert rows[7] == rows[8] == (1, 1, 1, sha256(b"2").hexdigest(), True)
    assert rows[4] == (0, 0, 0, sha256(b"").hexdigest(), False) and not rows[1][-1]
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_mixing(spark, docs):
    rows = mixing.taken_words(docs, block_words=8).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 16
        assert own[0]["target"] <= 2 * own[0]["source_size"]
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1
    assert mixing.taken_words(empty(spark)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for shard in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sharding.shard(empty(spark)).count() == 0
    assert sharding.pack({("g", bytes([i]), 0): s for i, s in enumerate([5, 5, 4, 3, 3])}, 2).keys()


def test_sharding_keeps_groups_whole(spark):
    """Groups of half a shard to a whole one, below it and above it; only the last is cut."""
    copies = {"a": 70, "b": 60, "c": 52, "d": 20, "e": 130}
    rows = [(i, key * 84) for i, key in enumerate(k for k, n in copies.items() for _ in range(n))]
    rows += [(1000 + i, words(15, 1000 + i)) for i in range(68)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    texts, groups = dict(rows), {}
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        groups.setdefault(texts[r["doc_id"]], []).append((r["shard"], r["size"]))
    share = sum(r["size"] for r in out) / 4
    for text, own in groups.items():
        assert (len({s for s, _ in own}) == 1) == (sum(n for _, n in own) <= share), text[:1]
    assert {k for k, n in copies.items() if share / 2 < 100 * n <= share} == {"a", "b", "c"}


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = ["  a   b ", "<s> </s> <0x41> ▁x▁", "日本😀é\x00\n\t", "ﬁ Ⅷ", "aaaaaaaaaaaaaaaaaaaa" * 50]
    more = spark.createDataFrame([(100 + i, t, "a", "x", "y") for i, t in enumerate(odd)], SCHEMA)
    want = Counter((i, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096)
                   for i, t in [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(odd)])
    assert got(token_counts.with_token_counts(docs.union(more), model)) == want


def test_quality_rules(spark, docs):
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert rows[4]["n_words"] == rows[5]["n_words"] == 0 and rows[4]["base_failed"] and not rows[4]["kept"]
    text = " ".join(["a b c d e f g h i"] * 3)
    again = spark.createDataFrame([(1, "x\nx\ny\n\n#", "s", "", ""), (2, text, "s", "", "")], SCHEMA)
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(again).collect()}
    assert rows[1]["n_dup_lines"] == 1 and rows[1]["n_symbols"] == 1 and rows[2]["n_repeat_words"] == 27
    assert quality_rules.apply_rules(empty(spark)).count() == 0


def test_quality_features_know_word_order(spark, monkeypatch):
    """Pairs of words are features, scored as trained; shares of the classes come from rows that may teach."""
    assert not np.array_equal(quality.text_features("red fox ran")[0], quality.text_features("fox ran red")[0])
    weights = np.random.default_rng(2).normal(size=2**features.BITS + 1)
    run = quality._scorer(weights)()
    for text in ["", "one", "Red fox  ran ran 12 é", words(300, 4)]:
        at, value = quality.text_features(text)
        margin = max(-30, min(30, float(weights[at] @ value)))
        assert run(text)[0] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)
    labels = spark.range(4000).withColumnRenamed("id", "doc_id")
    labels = labels.withColumn("quality", features.held_out(labels["doc_id"]).cast("int"))
    seen = []
    monkeypatch.setattr(features, "labelled_sample", lambda d, l, label, most: seen.append(most))
    monkeypatch.setattr(features, "featurised", lambda *_: None)
    monkeypatch.setattr(features, "fit", lambda *_: None)
    quality.fit(None, labels, 100)
    assert seen == [{0: 100}]


def test_trained_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in good) >= 0.93 * len(good)
    toxic = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == 0 for r in toxic if r["toxic"] == 0) >= 0.97 * sum(r["toxic"] == 0 for r in toxic)
    assert sum(r["predicted"] == 1 for r in toxic if r["toxic"] == 1) >= 0.6 * sum(r["toxic"] == 1 for r in toxic)
    none = empty(spark)
    assert quality.score(none, quality.fit(none, labels.where("false"))).count() == 0
    assert {r["severity"] for r in toxicity.score(docs.limit(5), toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}


def test_toxic_grades_count_words_of_the_whole_sample(spark):
    """Words of the toxic texts alone, in three texts or more; nulls, empty, repeated and very long texts are rows like others."""
    bad = ["vile", "foul", "nasty", "grim", "rank", "rotten"]
    rows = [(f"plain talk {' '.join(bad[:n])}", 1) for _ in range(3) for n in (1, 2, 3, 5, 6)]
    rows += [("plain talk", 0)] * 40 + [(None, 0), ("", 0), ("rotten", 1), ("rotten", 1), ("once", 1), ("plain " * 50_000, 0)]
    got = toxicity.graded(spark.createDataFrame(rows, "text string, y int").repartition(5)).collect()
    assert len(got) == len(rows)
    grades = [sum(r["y"] == g for r in got) for g in range(4)]
    assert grades == [43, 2 * 3 + 3, 2 * 3, 3]
    assert all(r["at"] for r in got if r["y"] > 1)


def test_trained_scores_on_odd_rows(spark):
    """Equal rows get equal scores, null and empty texts the same one; extra columns with clashing names change nothing."""
    texts = [(i, ("good words here " if i % 2 else "awful vile junk ") * (1 + i % 5)) for i in range(60)]
    odd = [(100, None), (101, ""), (102, " \n"), (103, "good words here " * 20_000), (104, "vile"), (104, "vile"), (None, "vile")]
    docs = spark.createDataFrame([(i, t, 0.5, 1, "z") for i, t in texts + odd], "doc_id long, text string, score double, y int, _shard string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, 7) for i, _ in texts] + [(5, 1, 0, 7), (None, 1, 1, 7), (100, None, None, 7)], "doc_id long, quality int, toxic int, text int")
    for module, column in ((quality, "score"), (toxicity, "severity")):
        out = module.score(docs, module.fit(docs, labels)).collect()
        assert len(out) == len(texts) + len(odd)
        by_id = {}
        for r in out:
            by_id.setdefault(r["doc_id"], set()).add(r[column])
        assert by_id[100] == by_id[101] == by_id[102] and len(by_id[104]) == 1 and by_id[104] == by_id[None]
