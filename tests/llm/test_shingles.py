"""Shingle sets of many texts at once: the sets of plain Python, their cost, and the size of what workers are sent."""

import random
import time

import pyarrow as pa

from riskframe.llm import jaccard_join

ODD_TEXTS = [None, b"", b" \n\t ", b"one", b"One", b"a b c d", b"A b c d e", b"a b c d e f a b c d e", b"a\x0bb\x0cc\xc2\xa0d\xe2\x80\x83e\x1cf", b"x" * 20_001 + b" y",
             b"longer_than_eight longer_than_eighT longer_than_eights", b"12345678 123456789 1234567812345678 12345678\x00", b"\x00 \x00\x00 \x00", b"tail "]


def plain(text):
    words = (text or b"").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sets_of_texts_taken_together():
    r = random.Random(4)
    texts = [*ODD_TEXTS, *[" ".join(f"w{r.randrange(30)}" for _ in range(r.randint(0, 90))).encode() for _ in range(300)], ODD_TEXTS[6].upper()]
    sets = [{int(h) for h in s} for s in jaccard_join.sets_of(pa.array(texts, pa.binary()))]
    names = {}
    for text, found in zip(texts, sets, strict=True):
        want = plain(text)
        assert len(found) == len(want)
        assert names.setdefault(frozenset(want), found) == found
    assert len({frozenset(s) for s in sets}) == len(names)
    for x, y in zip(range(len(texts)), range(1, len(texts))):
        assert len(sets[x] & sets[y]) == len(plain(texts[x]) & plain(texts[y]))


def test_sets_of_rare_words_cost_little_more_than_cutting_words():
    """A table of word hashes took nine times the cutting."""
    r = random.Random(6)
    texts = [" ".join(f"{r.randrange(10**12):x}" for _ in range(500)).encode() for _ in range(3000)]
    column = pa.array(texts, pa.binary())

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    cutting = min(seconds(lambda: [t.lower().split() for t in texts]) for _ in range(3))
    assert min(seconds(lambda: list(jaccard_join.sets_of(column))) for _ in range(3)) < 5 * cutting


def test_workers_get_texts_in_small_pieces(spark):
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 2000) AS text")
    before = spark.conf.get(jaccard_join.BATCH_LIMIT, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with jaccard_join.small_batches(spark):
        most = max(r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect())
    assert 100 < most < 1500 and spark.conf.get(jaccard_join.BATCH_LIMIT, None) == before
