"""Runs of windows: several texts in line give the runs of each text alone, and each text is cut once."""

import random

import numpy as np
import pytest

from riskframe.llm import anchors, substring_dedup, suffix_dedup

CASES = [(substring_dedup.word_grams, substring_dedup.WINDOW, substring_dedup.GRAM), (suffix_dedup.byte_grams, suffix_dedup.WINDOW, 2**suffix_dedup.GRAM_BITS)]


def alone(text, make, width, gram):
    """Runs found window by window in one text."""
    values, cuts = make([text])
    out, values = [], values.tolist()
    for w in range(cuts[-1] - width + 1):
        at = min(range(w, w + width - gram + 1), key=lambda i: (values[i] >> 24, i))
        if out and out[-1][1] == at:
            out[-1][3] = w
        else:
            out.append([np.uint64(values[at]).astype(np.int64), at, w, w])
    return [tuple(map(int, r)) for r in out]


@pytest.mark.parametrize("make, width, gram", CASES)
def test_runs_of_texts_in_line(make, width, gram, monkeypatch):
    r = random.Random(3)
    line = " ".join(f"w{r.randrange(9)}" for _ in range(300))
    texts = [t.encode() for t in ("", " \n", "one", line, "", line[:150], line[:420], "x " * 200, f" {line}\t", "ü" * 400, line[7:])]
    want = [[(i, *run) for run in alone(t, make, width, gram)] for i, t in enumerate(texts)]
    for piece in (anchors.PIECE, 37):
        monkeypatch.setattr(anchors, "PIECE", piece)
        found = list(zip(*[c.tolist() for c in anchors.runs(*make(texts), width - gram + 1, width)]))
        assert found == [run for runs in want for run in runs]
    for few in ([], [b""], texts[:3]):
        assert not len(anchors.runs(*make(few), width - gram + 1, width)[0])


def test_every_text_is_cut_once(spark):
    """Both the count of anchors and the runs themselves made the workers cut every text anew."""
    cut = spark.sparkContext.accumulator(0)

    def grams(texts):
        cut.add(len(texts))
        return substring_dedup.word_grams(texts)

    r = random.Random(5)
    body = [" ".join(f"w{r.randrange(99)}" for _ in range(120)) for _ in range(20)]
    rows = [(bytes([i]), f"{t} {body[0]}".encode(), i) for i, t in enumerate(body)]
    texts = spark.createDataFrame(rows, "key binary, text binary, owner long")
    width = substring_dedup.WINDOW
    held, spans = anchors.repeats(texts, grams, width - substring_dedup.GRAM + 1, width, substring_dedup.cut_words, substring_dedup.earlier_windows, earlier=True)
    assert spans.count() == 19 and held.count() == 20
    assert cut.value == 20
