import random
from collections import defaultdict

import pytest

from weftline.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return find, parent


@pytest.mark.parametrize("shape", ["random", "path", "star", "circle"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)], "path": [(i, i + 1) for i in range(150)],
        "star": [(0, i) for i in range(1, 2500)], "circle": [(i, (i + 1) % 40) for i in range(40)],
    }[shape]
    df = spark.createDataFrame([*edges, edges[0], (None, 5), (7, 7)], "a BIGINT, b BIGINT")
    got = {r.node: r.component for r in connected_components(spark, df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    find, nodes = union_find(real)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    assert set(got) == set(nodes)
    for g in groups.values():
        assert len({got[n] for n in g}) == 1
    assert len(set(got.values())) == len(groups)


def test_components_of_nothing(spark):
    assert connected_components(spark, spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0
