import random

import pytest

from docloom.llm.components import components


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def ours(spark, edges):
    groups = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        groups.setdefault(r.label, set()).add(r.node)
    return sorted(map(sorted, groups.values()))


def test_path_star_and_random(spark):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 60)
    path = list(zip(names, names[1:]))
    star = [(20_000 + k, 30_000) for k in range(50)]
    noise = [(rng.randrange(40_000, 40_200), rng.randrange(40_000, 40_200)) for _ in range(120)]
    edges = path + star + [(a, b) for a, b in noise if a != b]
    assert ours(spark, edges) == brute(edges)


def test_rising_path(spark):
    edges = [(k, k + 1) for k in range(1000)]
    assert ours(spark, edges) == [list(range(1001))]


def test_edges_left_are_an_error(spark):
    edges = [(k, k + 1) for k in range(1000)]
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)


def test_no_edges(spark):
    assert ours(spark, []) == []
