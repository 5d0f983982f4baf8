"""Parent-child rows to full hierarchies: path, depth, root, descendants and circles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.operators.skewed_keys import split_join
from siftmesh.session import Scratch
from siftmesh.sources.tables import read, urls_once

#: Nodes that one task contracts, and ids in the paths that it holds at a time, whatever the depth; the memory of a task is bounded by them.
TASK_NODES, TASK_IDS = 250_000, 2_000_000
#: ``open``: the chain ends at a parent that has no row. ``exit`` is used inside a partition only.
ROOT, OPEN, CYCLE, BELOW, EXIT = "root", "open", "cycle", "below_cycle", "exit"
_FRAGMENT = "part int, id long, parent long, top long, dist long, kind string, chain array<long>"


def _contract(with_paths: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The chains inside a partition, by pointer jumping over arrays.

    ``top`` is the root, or the parent outside the partition that the chain leaves to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values("id", ignore_index=True)
        ids, n = rows["id"].to_numpy(np.int64), len(rows)
        has, parent, step = (rows[c].to_numpy(t) for c, t in (("has_parent", bool), ("parent", np.int64), ("step", np.int64)))
        at = np.minimum(np.searchsorted(ids, parent), n - 1)
        inner = has & (ids[at] == parent)
        up = np.where(inner, at, np.arange(n))
        dist = np.where(inner, step, 0)
        for _ in range(n.bit_length()):
            dist = dist + dist[up]
            up = up[up]
        turning = inner[up]  # still moving after n steps; then the node it came to is on a circle
        on = np.zeros(n, bool)
        on[up[turning]] = True
        leaves = has[up] & ~turning
        kind = np.select([on, turning, leaves], [CYCLE, BELOW, EXIT], ROOT)
        out = pd.DataFrame({
            "part": TaskContext.get().partitionId(), "id": ids, "parent": parent,
            "top": np.where(leaves, parent[up], ids[up]), "dist": np.where(leaves, dist + step[up], dist), "kind": kind,
        })
        if not with_paths:
            yield out.assign(chain=None)
            return
        seg = rows["seg"].tolist()
        order = np.argsort(dist, kind="stable")
        for chosen, chains in _chains(order[~turning[order]], at, inner, seg):
            yield out.iloc[chosen].assign(chain=chains)
        if turning.any():
            yield out[turning].assign(chain=None)

    return run


def _chains(order: np.ndarray, at: np.ndarray, inner: np.ndarray, seg: list) -> Iterator[tuple[list[int], list[list[int]]]]:
    """Paths of the nodes in ``order`` (parents first), some at a time.

    A path is its parent's and the node's own segment. Paths that are held for children have a bound; beyond it they are
    forgotten but for the last one, and a child walks up to the next held one.
    """
    held: dict[int, list[int]] = {}
    n_held = n_out = 0
    chosen: list[int] = []
    chains: list[list[int]] = []
    for i in order.tolist():
        above, j = [i], i
        while inner[j] and at[j] not in held:
            j = at[j]
            above.append(j)
        path = list(held[at[j]]) if inner[j] else []
        for k in reversed(above):
            path.extend(seg[k])
        if n_held > TASK_IDS:
            held, n_held = {}, 0
        held[i] = path
        n_held += len(path)
        chosen.append(i)
        chains.append(path)
        n_out += len(path)
        if n_out > TASK_IDS:
            yield chosen, chains
            chosen, chains, n_out = [], [], 0
    if chosen:
        yield chosen, chains


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: the nodes between an entry on a global circle and the exit of its fragment."""
    rows = rows.sort_values("id")
    ids, on = rows["id"].to_numpy(np.int64), rows["entry"].to_numpy(bool)
    parent = rows["parent"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
    inner = ids[at] == parent
    front = np.flatnonzero(on)
    while len(front):
        front = np.unique(at[front[inner[front]]])
        front = front[~on[front]]
        on[front] = True
    return pd.DataFrame({"id": ids, "on": on})


def solve(nodes: DataFrame, scratch: Scratch, with_paths: bool = False, task_nodes: int = TASK_NODES, level: int = 0) -> DataFrame:
    """Resolve a forest (or any graph with one parent a node) of unknown depth.

    ``nodes``: id (unique), parent, has_parent, step (edges up to the parent), seg (ids below the parent, if with_paths).
    Result: id, kind (root, open, cycle, below_cycle), top, dist (edges up to top), chain (ids from the top,
    with paths, null with circles). With ``open``, top is the parent without row, which isn't in the chain.

    Each task contracts the chains in its own range of ids, so a node keeps one pointer, to the exit of its
    fragment. The nodes that exits name form the smaller quotient forest, solved in the same way, and its
    results are joined back once. Where ranges hardly shorten the chains, as the ids of neighbours lie apart, chains are spliced
    by coins before the next level, so each level has at most half of the nodes and a task never more than ``task_nodes``. No step
    collects a subtree; a parent with very many children is one row in the quotient. Circles inside a range and circles over ranges are both found.
    """
    size = nodes.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("seg"), F.lit(0)))).first()
    count = size[0]
    parts = max(1, -(-count // task_nodes), -(-(size[1] or 0) // (4 * TASK_IDS)))
    spread = nodes.repartitionByRange(parts, "id") if parts > 1 else nodes.coalesce(1)
    local = scratch.write(spread.mapInPandas(_contract(with_paths), _FRAGMENT), f"fragments{level}")
    leaving = local.where(F.col("kind") == EXIT)
    exits = leaving.select(F.col("top").alias("id")).distinct()
    entered = scratch.write(exits.join(local.select("id", "kind", "top", "dist", "chain"), "id", "left"), f"exits{level}")
    nothing = F.array().cast("array<long>") if with_paths else F.lit(None).cast("array<long>")
    ends = entered.where(F.col("kind").isNull() | (F.col("kind") != EXIT)).select(
        "id", F.coalesce("kind", F.lit(OPEN)).alias("kind"), F.coalesce("top", "id").alias("top"),
        F.coalesce("dist", F.lit(0).cast("long")).alias("dist"), F.when(F.col("kind").isNull(), nothing).otherwise(F.col("chain")).alias("chain"),
    )
    quotient = entered.where(F.col("kind") == EXIT).select(
        "id", F.col("top").alias("parent"), F.lit(True).alias("has_parent"), F.col("dist").alias("step"), F.col("chain").alias("seg")
    )
    waiting = quotient.count()
    if waiting:
        quotient, spliced = _spliced(quotient, waiting, count // 2 if count > task_nodes else waiting, scratch, level)
        above = solve(quotient, scratch, with_paths, task_nodes, level + 1)
        for taken in reversed(spliced):
            above = _joined(above, *taken, waiting, scratch, level)
        ends = scratch.write(ends.unionByName(_over(above, ends, waiting)), f"ends{level}")
    out = local.where(F.col("kind") != EXIT).select("id", "kind", "top", "dist", "chain").unionByName(
        _over(leaving.select("id", F.lit(OPEN).alias("kind"), "top", "dist", "chain"), ends, count)
    )
    if waiting and not (circle := ends.where(F.col("kind") == CYCLE).select(F.col("id"))).isEmpty():
        # Whoever leaves to a node on a global circle is on it only if the circle enters at or below it.
        at = leaving.join(circle.select(F.col("id").alias("top")), "top", "left_semi").select("part", "id", "parent")
        marked = at.join(circle.withColumn("entry", F.lit(True)), "id", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
        on = marked.groupBy("part").applyInPandas(_mark, "id long, on boolean").where("on")
        out = out.join(on, "id", "left").withColumn("kind", F.when(F.col("on"), CYCLE).otherwise(F.col("kind"))).drop("on")
    return out


def _coin(node, salt: int):
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(2)) == 1


def _spliced(nodes: DataFrame, count: int, most: int, scratch: Scratch, level: int) -> tuple[DataFrame, list[tuple[DataFrame, ...]]]:
    """``nodes`` without some, so that at most ``most`` are left, and per round those that were taken out.

    A node whose coin shows 1 and whose parent's shows 0 is taken out; its children get its parent. No two neighbours are
    taken out at once, and whatever the ids, a quarter of the nodes goes each round. Nodes that have come to point to themselves
    are circles and go at once.
    """
    taken: list[tuple[DataFrame, ...]] = []
    while count > most:
        salt = level * 1_000 + len(taken)
        loops = nodes.where(F.col("id") == F.col("parent"))
        coined = nodes.where(F.col("id") != F.col("parent")).withColumn("out", _coin(F.col("id"), salt) & ~_coin(F.col("parent"), salt))
        cut = coined.where("out").drop("out")
        up = cut.select(F.col("id").alias("parent"), F.col("parent").alias("upper"), F.col("step").alias("more"), F.col("seg").alias("before"))
        over = F.col("upper").isNotNull()
        moved = scratch.write(coined.where(~F.col("out")).join(up, "parent", "left").select(
            "id", F.coalesce("upper", "parent").alias("parent"), "has_parent", (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"),
            F.when(over, F.concat("before", "seg")).otherwise(F.col("seg")).alias("seg"), F.when(over, F.col("parent")).alias("through"),
        ), f"spliced{salt}")
        taken.append((loops, cut, moved.where(F.col("through").isNotNull()).select(F.col("through").alias("over"), F.col("id").alias("child"))))
        nodes = moved.drop("through")
        count = nodes.count()
    return nodes, taken


def _joined(above: DataFrame, loops: DataFrame, cut: DataFrame, through: DataFrame, rows: int, scratch: Scratch, level: int) -> DataFrame:
    """The results ``above`` with those of the nodes that one round took out."""
    opened = lambda t: t.select("id", F.lit(OPEN).alias("kind"), F.col("parent").alias("top"), F.col("step").alias("dist"), F.col("seg").alias("chain"))
    turning = loops.select("id", F.lit(CYCLE).alias("kind"), F.col("id").alias("top"), F.lit(0).cast("long").alias("dist"), F.lit(None).cast("array<long>").alias("chain"))
    if not loops.isEmpty():
        above = scratch.write(_over(above, turning, rows).unionByName(turning), f"loops{level}")
    own = _over(opened(cut), above, rows)
    circle = above.where(F.col("kind") == CYCLE).select(F.col("id").alias("child"))
    if not circle.isEmpty():
        # What a node on a circle was led past is on the circle.
        on = through.join(circle, "child", "left_semi").select(F.col("over").alias("id"), F.lit(True).alias("on")).distinct()
        own = own.join(on, "id", "left").withColumn("kind", F.when(F.col("on"), CYCLE).otherwise(F.col("kind"))).drop("on")
    return scratch.write(above.unionByName(own), f"joined{level}")


def _over(lower: DataFrame, upper: DataFrame, rows: int) -> DataFrame:
    """``lower`` (of at most so many rows) continued where its chain is open, at ``upper``; what has no row there stays open."""
    u = upper.select(F.col("id").alias("top"), F.col("kind").alias("ukind"), F.col("top").alias("utop"), F.col("dist").alias("udist"), F.col("chain").alias("uchain"))
    ends = (F.col("kind") == OPEN) & F.col("ukind").isNotNull()
    return split_join(lower, u, "top", rows=rows).select(
        "id",
        F.when(~ends, F.col("kind")).when(F.col("ukind") == CYCLE, BELOW).otherwise(F.col("ukind")).alias("kind"),
        F.when(ends, F.col("utop")).otherwise(F.col("top")).alias("top"),
        (F.col("dist") + F.when(ends, F.col("udist")).otherwise(F.lit(0))).alias("dist"),
        F.when(ends, F.concat("uchain", "chain")).otherwise(F.col("chain")).alias("chain"),
    )


def hierarchy(rows: DataFrame, scratch: Scratch, with_paths: bool = True, task_nodes: int = TASK_NODES) -> DataFrame:
    """``rows``: id, parent (null or 0: a root), one row per id. Result: id, kind, depth, root, path.

    kind is ``root`` (the chain ends at a root), ``broken`` (it ends at a parent without row), ``cycle`` or
    ``below_cycle``. depth and root are null unless the chain ends at a root; path has the ids from the top
    down to the node and is null with circles. An empty table gives an empty result.
    """
    has = F.col("parent").isNotNull() & (F.col("parent") != 0)
    nodes = rows.select("id", F.coalesce("parent", F.lit(0).cast("long")).alias("parent"), has.alias("has_parent"), F.lit(1).cast("long").alias("step"),
                        (F.array("id") if with_paths else F.lit(None)).cast("array<long>").alias("seg"))
    rooted = F.col("kind") == ROOT
    return solve(nodes, scratch, with_paths, task_nodes).select(
        "id", F.when(F.col("kind") == OPEN, "broken").otherwise(F.col("kind")).alias("kind"),
        F.when(rooted, F.col("dist")).alias("depth"), F.when(rooted, F.col("top")).alias("root"), F.col("chain").alias("path"),
    )


def _links(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    return scratch.write(urls_once(read(spark, folder, "urlword"), "referrer", "hops"), "urls")


def link_faults(spark: SparkSession, folder: str) -> DataFrame:
    """url_id, kind of the URLs whose chain fails or whose hops isn't their depth."""
    scratch = Scratch(spark, "links")
    urls = _links(spark, folder, scratch)
    tree = hierarchy(urls.select(F.col("url_id").alias("id"), F.col("referrer").cast("long").alias("parent")), scratch, with_paths=False)
    joined = tree.join(urls.select(F.col("url_id").alias("id"), "hops"), "id")
    wrong = (F.col("kind") == ROOT) & F.col("hops").isNotNull() & (F.col("hops") != F.col("depth"))
    return joined.select(F.col("id").alias("url_id"), F.when(wrong, "wrong_hops").when(F.col("kind") != ROOT, F.col("kind")).alias("kind")).where(F.col("kind").isNotNull())


def link_paths(spark: SparkSession, folder: str) -> DataFrame:
    """url_id, kind, depth, root, path (ids from the top, joined by '/')."""
    scratch = Scratch(spark, "paths")
    tree = hierarchy(_links(spark, folder, scratch).select(F.col("url_id").alias("id"), F.col("referrer").cast("long").alias("parent")), scratch)
    return tree.select(F.col("id").alias("url_id"), "kind", "depth", "root", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def descendants(tree: DataFrame) -> DataFrame:
    """id, descendant, distance: a row per pair of a node and a node below it, from the paths of :func:`hierarchy`.

    The pairs come from each descendant's own path, so no subtree is ever gathered.
    """
    size = F.size("path")
    return tree.where(F.col("path").isNotNull()).select(F.col("id").alias("descendant"), size.alias("n"), F.posexplode("path").alias("at", "above")).where(
        F.col("at") < F.col("n") - 1
    ).select(F.col("above").alias("id"), "descendant", (F.col("n") - 1 - F.col("at")).cast("long").alias("distance"))


def link_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """url_id, n_descendants, deepest (the distance of the lowest one) for every URL whose chain has no circle."""
    scratch = Scratch(spark, "descendants")
    tree = hierarchy(_links(spark, folder, scratch).select(F.col("url_id").alias("id"), F.col("referrer").cast("long").alias("parent")), scratch)
    tree = scratch.write(tree.where(F.col("path").isNotNull()).select("id", "path"), "tree")
    below = descendants(tree).groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("deepest"))
    zero = F.lit(0).cast("long")
    return tree.select("id").join(below, "id", "left").select(
        F.col("id").alias("url_id"), F.coalesce("n_descendants", zero).alias("n_descendants"), F.coalesce("deepest", zero).alias("deepest")
    )


def _rings(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links``: id, parent of the nodes on circles. Result: id, ring (the smallest id of the circle), up (edges up to it).

    Each round doubles the stretch that a node has seen; without any change, all have seen their whole circle.
    """
    seen = scratch.write(links.select("id", F.col("parent").alias("jump"), F.struct(F.col("id").alias("ring"), F.lit(0).cast("long").alias("up")).alias("m")), "rings0")
    step = 1
    while True:
        ahead = seen.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.struct(F.col("m.ring").alias("ring"), (F.col("m.up") + step).alias("up")).alias("far"))
        moved = scratch.write(seen.join(ahead, "jump").select("id", F.col("next").alias("jump"), F.least("m", "far").alias("m"), (F.col("far") < F.col("m")).alias("new")), f"rings{step}")
        if moved.where("new").isEmpty():
            return moved.select("id", "m.ring", "m.up")
        seen, step = moved.drop("new"), 2 * step


def link_descendant_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """url_id, descendant_id, distance: a row for every URL and every other one whose chain of referrers leads to it.

    On a circle, each URL has the others of the circle and all trees below the circle as descendants.
    """
    scratch = Scratch(spark, "pairs")
    rows = _links(spark, folder, scratch).select(F.col("url_id").alias("id"), F.col("referrer").cast("long").alias("parent"))
    tree = scratch.write(hierarchy(rows, scratch).select("id", "kind", "path"), "tree")
    pairs = descendants(tree)
    turning = tree.where(F.col("path").isNull()).select("id", "kind")
    if not turning.isEmpty():
        # The circles' nodes as roots give the trees below; their other nodes lie above the node that a tree hangs on.
        cut = rows.join(turning, "id").withColumn("up", F.when(F.col("kind") != CYCLE, F.col("parent")))
        below = scratch.write(hierarchy(cut.select("id", F.col("up").alias("parent")), scratch).select("id", "depth", "root", "path"), "below")
        ring = scratch.write(_rings(cut.where(F.col("kind") == CYCLE).select("id", "parent"), scratch), "ring")
        size = ring.groupBy("ring").agg(F.count(F.lit(1)).alias("size"))
        entry = ring.join(size, "ring").select("ring", F.col("id").alias("root"), F.col("up").alias("from"), "size")
        above = entry.join(ring.select("ring", F.col("id").alias("over"), F.col("up").alias("to")), "ring").where(F.col("root") != F.col("over")).select(
            "root", "over", F.pmod(F.col("from") - F.col("to"), F.col("size")).alias("round")
        )
        around = below.join(above, "root").select(F.col("over").alias("id"), F.col("id").alias("descendant"), (F.col("depth") + F.col("round")).alias("distance"))
        pairs = pairs.unionByName(descendants(below)).unionByName(around)
    return pairs.select(F.col("id").alias("url_id"), F.col("descendant").alias("descendant_id"), "distance")
