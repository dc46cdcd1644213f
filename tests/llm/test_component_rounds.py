"""Connected components against union-find, and no round for edges that already point at the smallest node."""

import random

import pytest

from riskframe.llm import components


def roots_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [p for p in ((r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(70 + 10 * seed)) if p[0] != p[1]]
    pairs += [(1000 + i, 1001 + i) for i in range(17)]  # a chain
    found = components.components(edges(spark, pairs))
    rows = found.collect()
    assert {x["node"]: x["root"] for x in rows} == roots_of(pairs) and len(rows) == len(roots_of(pairs))
    again = components.components(components.as_edges(found).unionByName(edges(spark, [(1000, -500)])))
    assert {x["node"]: x["root"] for x in again.collect()} == roots_of([*pairs, (1000, -500)])


@pytest.mark.parametrize("pairs", [[], [(2, 1), (1, 3), (5, 4), (4, 4), (2, 1)]])
def test_settled_edges_take_no_round(spark, monkeypatch, pairs):
    written = []
    monkeypatch.setattr(components, "stored", lambda df, name, real=components.stored: written.append(name) or real(df, name))
    rows = components.components(edges(spark, pairs)).collect()
    assert {x["node"]: x["root"] for x in rows} == roots_of([p for p in pairs if p[0] != p[1]])
    assert len(written) == 1
