"""What a task of the quality classifier holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from riskframe.llm import features, quality

WEIGHTS = np.random.default_rng(1).normal(size=2**features.BITS + 1)


def by_hand(text):
    at, value = quality.text_features(text)
    margin = float(WEIGHTS[at] @ value)
    return 1 / (1 + np.exp(-max(-30.0, min(30.0, margin))))


def test_scores_of_odd_words():
    score = quality._scorer(WEIGHTS)()
    for text in ("", "one", "A AB aB ß ǅ İ", "½ ²a ªB Ⅷ ٣٤ 一二 _ a_b a--b -- A1", "x x y x x", "\ud800 \udc00a", "Word word WORD wo-rd 12 1a2 " * 3):
        assert abs(score(text)[0] - by_hand(text)) < 1e-4


def test_rare_words_are_not_all_kept():
    """500,000 words, 132 MB on 0.016 GB of texts, stayed with each worker."""
    score = quality._scorer(WEIGHTS)()
    score("warm up")
    tracemalloc.start()
    for i in range(400):
        score(" ".join(f"{(i * 1000 + j) * 7919:x}" for j in range(1000)))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 45e6


def test_kept_rows_leave_in_small_batches():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1300)), "text": [None if i % 5 == 0 else f"t{i}" for i in range(1300)]})

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            return list(run(iter([batch, batch.slice(0, 0)])))

    out = features.passing(Docs(), lambda: lambda text: (0.9 if text.endswith("7") or not text else 0.1,), 0.7)
    assert [x for b in out for x in b.column(0).to_pylist()] == [i for i in range(1300) if i % 5 == 0 or i % 10 == 7]
    assert max(b.num_rows for b in out) <= features.PASSED_ROWS
