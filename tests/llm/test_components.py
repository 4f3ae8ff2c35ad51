import random

import pytest

from delimkit.llm import components as C
from delimkit.llm.components import components


@pytest.mark.parametrize("one_task", [0, 40, 1_000_000])
def test_components_equal_plain(spark, monkeypatch, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(120)]
    edges += [(900, i) for i in range(880, 930)] + [(7, 7), (3, None)]
    r.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
