"""Chat formatting, periodic runs and collocations against plain Python, with nulls, ties, repeats, empty tables and odd texts."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from riskframe.llm import chat_format, collocations, periodic_runs

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
CHATS = "conv_id long, turn long, role string, text string, seq string, segments string"


def fold(events):
    """Final messages by replaying the log event by event."""
    rank = lambda e: (e[1] is not None, e[1] or 0, e[3] == "delta", e[3] or "message", e[4] is not None, e[4] or "", e[5] or "")
    state = defaultdict(dict)
    for conv, _, turn, kind, role, text in sorted(events, key=rank):
        m = state[conv].setdefault(turn, {"role": "", "text": "", "there": False})
        kind, text = kind or "message", text or ""
        if kind in ("message", "edit", "delta", "regenerate", "delete"):
            m["role"] = m["role"] if role is None else role
            m["text"] = {"delta": m["text"] + text, "message": text, "edit": text}.get(kind, "")
            m["there"] = kind != "delete"
    return {(c, t, m["role"], m["text"]) for c, turns in state.items() for t, m in turns.items() if m["there"]}


def test_folding_of_event_logs(spark):
    r = random.Random(3)
    kinds = ["message", "edit", "delta", "delta", "delta", "regenerate", "delete", None, "seen"]
    events = [(r.choice([1, 2, None]), r.choice([None, *range(12)]), r.choice([None, 0, 1, 2, 3]), r.choice(kinds), r.choice([None, None, "user", "assistant"]),
               r.choice([None, "", "a", "b<s>", "long " * 9])) for _ in range(400)]
    events += events[:30]
    df = spark.createDataFrame(events, EVENTS)
    rows = [tuple(x) for x in chat_format.folded(df).select("conv_id", "turn", "role", "text").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == fold(events)
    assert chat_format.format_conversations(df.where("false")).count() == 0


ODD = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] \\", "<|turn|>user<|text|>x<|end|>", "<<s>> [[INST] <|<s>|> <INST] [/s>", "<", "<\\", "end<|", "\n\n", "", None,
       "日本😀é <|im_start|>", "x" * 9000 + "</s>", "$1 \\1 \\"]


def test_formatting_can_be_undone(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<s>", "a\nb"]), r.choice(ODD), "x", "y") for c in (0, 1, 2, None) for t in (0, 1, 1, 2, None, 3)]
    rows += [rows[0], (7, 0, "assistant", None, "x", "y"), (8, 0, "user", "only a user", "x", "y")]
    df = spark.createDataFrame(rows, CHATS)
    shown = {x["conv_id"]: x for x in chat_format.format_conversations(chat_format.as_events(df), chat_format.MESSAGE).collect()}
    got = {x["conv_id"]: tuple(x)[1:] for x in chat_format.digests(df).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (low(x[1]), x[2] is not None, x[2] or "", x[3] or ""))
        told = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert got[conv] == (len(own), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(shown[conv]["formatted"]))
        for segment in shown[conv]["segments"]:
            if segment["text"] not in (chat_format.END,) and not segment["text"].startswith(chat_format.TURN):
                assert not re.search(r"</?s>|\[/?INST\]|<\|[a-z_]+\|>", segment["text"])
        assert shown[conv]["formatted"].count(chat_format.TURN) == len(own)
    assert chat_format.digests(df.where("false")).count() == 0


def slow_runs(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and all(any(words[k] != words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q, q))
            i = max(j, i + 1)
    return found


def periodic_words(r):
    n = r.choice([0, 1, 23, 24, 25, 70, 150, 260])
    words = [b"%d" % r.randrange(r.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n > 9 else 0):
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 3))
        for i in range(a, r.randint(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("cells", [64, 2**20])
def test_runs_of_words(monkeypatch, cells):
    monkeypatch.setattr(periodic_runs, "CELLS", cells)
    r = random.Random(cells)
    for _ in range(40):
        texts = [periodic_words(r) for _ in range(r.choice([1, 4, 12]))]
        assert [sorted(x) for x in periodic_runs.texts_runs(texts)] == [sorted(slow_runs(t)) for t in texts]


def test_zeros_that_are_no_match(monkeypatch):
    """With every place reported as an occurrence, the comparison word by word still finds the runs and nothing else."""
    monkeypatch.setattr(periodic_runs, "occurrences", lambda blocks, windows: np.ones(blocks.shape, bool))
    r = random.Random(9)
    for _ in range(25):
        words = periodic_words(r)
        assert sorted(periodic_runs.texts_runs([words])[0]) == sorted(slow_runs(words))


def test_transform_finds_occurrences():
    r = np.random.default_rng(1)
    for b in (1, 2, 4, 16, 64):
        blocks, windows = r.integers(0, 3, (5, b)).astype(np.uint64), r.integers(0, 3, (5, 2 * b)).astype(np.uint64)
        windows[0, b - 1:2 * b - 1] = blocks[0]
        want = [[(windows[i, s:s + b] == blocks[i]).all() for s in range(b)] for i in range(5)]
        assert (periodic_runs.occurrences(blocks, windows) == np.array(want)).all()


def test_periodic_runs(spark):
    r = random.Random(2)
    rows = [(i, b" ".join(periodic_words(r)).decode(), "x", "y") for i in range(60)]
    rows += [(None, "a " * 30, "x", "y"), (3, "\t\n ", "x", "y"), (4, None, "x", "y"), (4, "", "x", "y"), (61, "é é " * 4000, "x", "y"), (61, "é é " * 4000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start string")
    want = Counter()
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        if i is not None:
            words = periodic_runs.rewritten(words, periodic_runs.crc32(str(i).encode()))
        runs = sorted(((s, e - s, q) for s, e, q in (slow_runs(words) if len(words) < 1000 else [(0, len(words), 1)])), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[(i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(told.encode()).hexdigest(), sha256(kept).hexdigest())] += 1
    assert Counter(tuple(x) for x in periodic_runs.periodic_runs(df, rewrite=True).drop("runs").collect()) == want
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0


def test_rewriting_by_the_rule():
    for h in (0, 7, 10, 250, 123450):
        words = [str(i) for i in range(37)]
        g = h // 10
        a, p = g % 37, 1 + (37 - g % 37) // (3 + g % 8)
        want = [words[a + (i - a) % p] if h % 10 == 0 and i >= a else words[i] for i in range(37)]
        assert periodic_runs.rewritten(words, h) == want and periodic_runs.rewritten([], h) == []


def slow_phrases(rows, least, longest, kept):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            counts[lang or "und"].update(tuple(ws[i:i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = sum(v for w, v in f.items() if len(w) == 1), []
        many = [p for p, a in f.items() if len(p) > 1 and a >= least]
        covered = {p[i:j] for p in many for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * f[p] >= 50 * f[p[i:j]]}
        for p in many:
            a = f[p]
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in covered:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, ph.decode(), -a, left, right, n, -s) for i, (s, a, ph, left, right) in enumerate(sorted(found)[:kept])]
    return Counter(out)


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_collocations(spark, monkeypatch, longest):
    monkeypatch.setattr(collocations, "CHUNK", 50 * longest)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 3 * longest)
    r = random.Random(longest)
    vocabulary = ["a", "B", "c", "é", "É", "日本", "x y", "w" * 50]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "!", "\r\n"]) for _ in range(n))
    rows = [(r.choice(["en", "fr", None, "und"]), text(r.choice([0, 1, 30, 200]))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("en", " \t "), ("en", text(9000))]
    rows += rows[:6] + [("de", "one two three four five six")] * 12
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "lang string, text string, place int, word string")
    got = Counter(tuple(x) for x in collocations.best_phrases(df, 10, longest, 40).collect())
    assert got == slow_phrases(rows, 10, longest, 40)
    assert collocations.best_phrases(df.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    """Counts of 10^12: the product of two and a million passes 64 bits, the score is exact."""
    words = spark.createDataFrame([(0, "en", ["a"], 10**12 + 39), (1, "en", ["b"], 10**12 + 61)], "id long, lang string, words array<string>, a long")
    pairs = spark.createDataFrame([(0, "en", ["a", "b"], 10**12 - 11)], "id long, lang string, words array<string>, a long")
    row = collocations.scored([words, pairs]).first()
    assert row["score"] == 10**6 * (10**12 - 11) ** 2 // ((10**12 + 39) * (10**12 + 61))
