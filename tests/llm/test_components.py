import random

import pytest

from siftmesh.llm.components import components
from siftmesh.session import Scratch


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def run(spark, edges):
    rows = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "c")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["group_id"] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(None, 3), (4, None), (7, 7)]
    edges += edges[:20]
    assert run(spark, edges) == brute(edges)


def test_chain_star_and_circle(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    star = [(5000, x) for x in range(1000, 1200)]
    circle = [(x, x + 1) for x in range(7000, 7050)] + [(7050, 7000)]
    assert run(spark, chain + star + circle) == brute(chain + star + circle)


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1), (None, None)]) == {}
