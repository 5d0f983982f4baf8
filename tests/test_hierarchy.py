import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from siftmesh.operators.hierarchy import descendants, hierarchy
from siftmesh.plans import general_catalog
from siftmesh.session import Scratch


def brute(parent: dict[int, int | None]) -> dict[int, tuple]:
    out = {}
    for x in parent:
        path, at = [x], x
        while True:
            up = parent[at]
            if up in (None, 0):
                out[x] = ("root", len(path) - 1, at, path[::-1])
                break
            if up not in parent:
                out[x] = ("broken", None, None, path[::-1])
                break
            if up in path:
                out[x] = ("cycle" if up == x else "below_cycle" if x not in path[path.index(up):] else "cycle", None, None, None)
                break
            path.append(up)
            at = up
    return out


def run(spark, parent, task_nodes):
    df = spark.createDataFrame(list(parent.items()), "id long, parent long")
    return {r["id"]: (r["kind"], r["depth"], r["root"], r["path"]) for r in hierarchy(df, Scratch(spark, "t"), task_nodes=task_nodes).collect()}


@pytest.mark.parametrize("seed, task_nodes", [(1, 10**6), (1, 25), (2, 40), (3, 60)])
def test_random_graphs(spark, seed, task_nodes):
    rng = random.Random(seed)
    ids = rng.sample(range(1, 2000), 300)
    parent = {x: rng.choice([None, 0, 5000, *rng.sample(ids, 12)]) for x in ids}
    assert run(spark, parent, task_nodes) == brute(parent)


def test_long_chain_over_ranges(spark):
    ids = list(range(1, 1200))
    random.Random(4).shuffle(ids)
    parent = {a: b for a, b in zip(ids, ids[1:])} | {ids[-1]: None}
    assert run(spark, parent, 100) == brute(parent)


class Counted(Scratch):
    """Remembers the most nodes that a task had, and how many nodes each level had."""

    def __init__(self, *args):
        super().__init__(*args)
        self.most, self.levels = 0, []

    def write(self, df, tag, partition_by=None):
        out = super().write(df, tag, partition_by)
        if tag.startswith("fragments"):
            parts = [r["count"] for r in out.groupBy("part").count().collect()]
            self.most, self.levels = max([self.most, *parts]), [*self.levels, sum(parts)]
        return out


def test_scattered_chain_never_grows_a_task(spark):
    """A chain whose ids have no order: no range shortens it, yet each level halves and no task gets more nodes."""
    n = 30_000
    ids = np.random.default_rng(6).permutation(np.arange(1, n + 1) * 7)
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "parent": np.append(ids[1:], 0)}))
    scratch = Counted(spark, "t")
    out = hierarchy(df, scratch, with_paths=False, task_nodes=3_000).toPandas().set_index("id")
    assert (out.loc[ids, "depth"].to_numpy() == np.arange(n - 1, -1, -1)).all() and set(out["root"]) == {ids[-1]} and set(out["kind"]) == {"root"}
    assert scratch.most <= 2 * 3_000
    assert all(2 * b <= a for a, b in zip(scratch.levels, scratch.levels[1:]))


@pytest.mark.parametrize("seed", range(2))
def test_scattered_circles_and_paths(spark, seed):
    """Circles of all lengths, chains into them, broken ends and trees, all over the ranges."""
    rng = random.Random(seed)
    ids = rng.sample(range(1, 10_000), 160)
    parent, rest = {}, list(ids)
    for length in (1, 2, 3, 5, 40):
        ring, rest = rest[:length], rest[length:]
        parent |= dict(zip(ring, [*ring[1:], ring[0]]))
    while rest:
        length = rng.choice([1, 2, 30])
        chain, rest = rest[:length], rest[length:]
        parent |= dict(zip(chain, [*chain[1:], rng.choice([None, 0, 20_000, *list(parent)[-40:], *list(parent)[:20]])]))
    assert run(spark, parent, 25) == brute(parent)


def test_paths_of_a_deep_chain_with_little_held(spark, monkeypatch):
    from siftmesh.operators import hierarchy as h

    order = np.arange(60)
    inner, at, seg = order > 0, np.maximum(order - 1, 0), [[i, -i] for i in range(60)]
    want = {i: [x for k in range(i + 1) for x in (k, -k)] for i in range(60)}
    for limit in (1, 50, 10**6):
        monkeypatch.setattr(h, "TASK_IDS", limit)
        parts = list(h._chains(order, at, inner, seg))
        assert {i: c for chosen, chains in parts for i, c in zip(chosen, chains)} == want
        assert all(sum(map(len, chains)) <= limit + 120 for _, chains in parts)


def test_circles_over_ranges_and_self(spark):
    parent = {1: 500, 500: 900, 900: 1, 2: 1, 3: 3, 4: 3, 501: 500, 7: None}
    assert run(spark, parent, 2) == brute(parent)


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "id long, parent long")
    rows = descendants(hierarchy(df, Scratch(spark, "t"))).collect()
    assert sorted((r["id"], r["descendant"], r["distance"]) for r in rows) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


def test_descendant_pairs_with_circles(spark, folder):
    parent = {1: None, 2: 1, 3: 2, 4: 77, 5: 4, 10: 12, 11: 10, 12: 11, 13: 11, 14: 13, 20: 20, 21: 20, 22: 21}
    want = []
    for x in parent:
        seen, at = [x], parent[x]
        while at in parent and at not in seen:
            want.append((at, x, len(seen)))
            seen.append(at)
            at = parent[at]
    schema = pa.schema([("url_id", pa.int64()), ("referrer", pa.int64()), ("hops", pa.int32()), ("seen_at", pa.timestamp("us"))])
    d = folder(urlword=([{"url_id": u, "referrer": p, "hops": None, "seen_at": None} for u, p in parent.items()], schema))
    got = [tuple(r) for r in general_catalog.QUERIES["p5_descendant_pairs"](spark, d).select("url_id", "descendant_id", "distance").collect()]
    assert sorted(got) == sorted(want)
