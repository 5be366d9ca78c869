import random

import pytest

from quire.llm.components import components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(7)
    if kind == "chain":
        order = rng.sample(range(1000), 120)
        links = list(zip(order, order[1:]))
    elif kind == "star":
        links = [(5, k) for k in range(6, 60)] + [(3, 59), (3, 3)]
    elif kind == "random":
        links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    else:
        links = []
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        head[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
