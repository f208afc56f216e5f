"""Components of random graphs against union-find."""

import random

import pytest

from loomgraph.llm.components import components


@pytest.mark.parametrize("shape", ["path", "random", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(7)
    pairs = {
        "path": [(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60), (60, 61)],
        "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)],
        "star": [(9, i) for i in range(40)] + [(100 + i, 200) for i in range(9)],
        "empty": [],
    }[shape]
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = [tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in nodes)
