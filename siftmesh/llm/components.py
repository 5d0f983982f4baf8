"""Pairwise matches to groups: minimum labels, pointer jumping, a checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.operators.skewed_keys import split_join
from siftmesh.session import Scratch
from siftmesh.sources.tables import read, urls_once


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges``: a, b (longs). Result: node, group_id (smallest node connected to it), for every node of an edge.

    Each round propagates the smallest label over the edges between groups: every label hooks to the smallest of
    its neighbours if that is smaller. Pointer jumping then takes each label to the end of its chain of hooks, in as
    many doublings as the logarithm of the chain. Edges and labels are renamed, and edges inside a group go. A label
    that doesn't hook is a local minimum; as it has a neighbour that does, at least half of the labels that have
    edges go each round, so rounds grow as the logarithm of the largest group. Each round's labels and edges are tables
    in the shared folder, so that no lineage grows and a lost executor costs only tasks of the round.

    Self edges and edges with a null end are dropped, repeated edges count once. Minima are combined before the
    shuffle, so a node with very many edges is one partial row a task; where such a node or a very large group meets its
    new label, its rows are split into parts of bounded size.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    live = scratch.write(both.distinct(), "edges")
    label = scratch.write(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("group_id", F.col("node")), "labels")
    nodes = label.count()
    while links := live.count():
        # a < b, so a label hooks only as the larger end.
        hook = scratch.write(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "hooks")
        while True:
            on = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = scratch.write(hook.join(on, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "jumped")
            moved = not jumped.where("moved").isEmpty()
            scratch.drop(hook)
            hook = jumped.select("node", "to")
            hook._siftmesh_path = jumped._siftmesh_path
            if not moved:
                break
        to = hook.select(F.col("node").alias("group_id"), "to")
        renamed = scratch.write(split_join(label, to, "group_id", rows=nodes).select("node", F.coalesce("to", "group_id").alias("group_id")), "labels")
        ends = live
        for end in ("a", "b"):
            ends = split_join(ends, hook.select(F.col("node").alias(end), "to"), end, rows=links).withColumn(end, F.coalesce("to", end)).drop("to")
        ends = ends.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = scratch.write(ends.distinct(), "edges")
        scratch.drop(live, label, hook)
        live, label = rest, renamed
    return label


def redirect_groups(spark: SparkSession, folder: str) -> DataFrame:
    """group_id, url_id of every URL that is tied by redir to another, in either direction."""
    scratch = Scratch(spark, "redirects")
    urls = scratch.write(urls_once(read(spark, folder, "urlword"), "redir").select("url_id", F.col("redir").cast("long").alias("redir")), "urls")
    tied = urls.where(F.col("redir").isNotNull() & (F.col("redir") != 0) & (F.col("redir") != F.col("url_id")))
    edges = tied.join(urls.select(F.col("url_id").alias("redir")), "redir", "left_semi").select(F.col("url_id").alias("a"), F.col("redir").alias("b"))
    return components(edges, scratch).select("group_id", F.col("node").alias("url_id"))
