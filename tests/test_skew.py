from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import components, skew
from pagewright.operators.components import connected_components


@pytest.mark.parametrize("plain", [0, skew.PLAIN])
def test_lookup_is_a_left_join(spark, monkeypatch, plain):
    monkeypatch.setattr(skew, "PLAIN", plain)
    rows = spark.createDataFrame([(i, 7 if i < 3000 else i % 50 if i < 4900 else None) for i in range(5000)], "id int, k int").persist()
    table = spark.createDataFrame([(i, f"v{i}") for i in range(0, 40)], "k int, v string")
    got = {r["id"]: r["v"] for r in skew.lookup(rows, "k", table, rows.count()).collect()}
    assert got == {r["id"]: f"v{r['k']}" if r["k"] is not None and r["k"] < 40 else None for r in rows.collect()}
    assert skew.lookup(rows, "k", table.limit(0), 5000).count() == 5000
    assert skew.lookup(rows.limit(0), "k", table, 0).count() == 0


def test_components_with_hubs_and_paths_by_either_join(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 800)] + [(5000, i) for i in range(900, 1500)] + [(i, i + 1) for i in range(2000, 2300)] + [(rng.randint(6000, 6400), rng.randint(6000, 6400)) for _ in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    expected = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    for plain in (0, skew.PLAIN):
        monkeypatch.setattr(skew, "PLAIN", plain)
        monkeypatch.setattr(components, "PLAIN", plain)
        assert {r["node"]: r["component"] for r in connected_components(df.select(F.col("a"), F.col("b"))).collect()} == expected


@pytest.mark.parametrize("kind", ["long", "string"])
def test_leaves_are_set_aside_before_the_rounds(spark, monkeypatch, kind):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1000, 1300)] + [(5000 + i, 9000 + i) for i in range(20)] + [(6000, i) for i in range(100, 130)]  # stars, pairs
    edges += [(i, i + 1) for i in range(200, 260)] + [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(40)] + [(255, 2000), (310, 7), (310, 2001)]
    name = (lambda x: x) if kind == "long" else str
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(name(x), name(x))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        one, other = root(name(a)), root(name(b))
        parent[max(one, other)] = min(one, other)
    want = {x: root(x) for a, b in edges if a != b for x in (name(a), name(b))}
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
    seen = []
    stats = components._stats
    monkeypatch.setattr(components, "_stats", lambda e: seen.append(stats(e)) or seen[-1])
    for few, at_first in ((components.IN_A_TASK, 1), (0, 2)):
        monkeypatch.setattr(components, "IN_A_TASK", few)
        seen.clear()
        got = connected_components(df).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
        assert len(seen) >= at_first and (few or seen[1][0] < 130 < 400 < seen[0][0])
        assert not few or len(seen) == 1  # no rounds
