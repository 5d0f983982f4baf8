"""The link graph: redirects, distinct links, degrees, citations and link rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmesh.operators.hierarchy import CYCLE, BELOW, solve
from siftmesh.session import Scratch

DAMPING = 0.85
#: Rounds of link rank in one plan, before its ranks are written.
TOGETHER = 2


def resolved_redirects(redirects: DataFrame, scratch: Scratch) -> DataFrame:
    """from_id, to_id: where a chain of redirects ends; a URL whose chain comes back to itself stays as it is.

    ``redirects``: from_id (unique), to_id. Chains are contracted like those of a hierarchy, so their length doesn't matter.
    """
    nodes = redirects.select(F.col("from_id").alias("id"), F.col("to_id").alias("parent"), F.lit(True).alias("has_parent"), F.lit(1).cast("long").alias("step"), F.lit(None).cast("array<long>").alias("seg"))
    turning = F.col("kind").isin(CYCLE, BELOW)
    return solve(nodes, scratch).select(F.col("id").alias("from_id"), F.when(turning, F.col("id")).otherwise(F.col("top")).alias("to_id"))


def limited_redirects(redirects: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """from_id, to_id, n: where chains of at most ``most`` redirects end; longer ones and those that come back to themselves aren't followed."""
    nodes = redirects.select(F.col("from_id").alias("id"), F.col("to_id").alias("parent"), F.lit(True).alias("has_parent"), F.lit(1).cast("long").alias("step"), F.lit(None).cast("array<long>").alias("seg"))
    ends = solve(nodes, scratch).where(~F.col("kind").isin(CYCLE, BELOW) & (F.col("dist") <= most))
    return ends.select(F.col("id").alias("from_id"), F.col("top").alias("to_id"), F.col("dist").alias("n"))


def distinct_links(links: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """from_id, to_id once each, after the redirects of the targets, without self links."""
    if redirects is not None:
        r = redirects.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("final"))
        links = links.join(r, "to_id", "left").select("from_id", F.coalesce("final", "to_id").alias("to_id"))
    return links.where(F.col("from_id") != F.col("to_id")).select("from_id", "to_id").distinct()


def degrees(links: DataFrame) -> DataFrame:
    """url_id, n_in, n_out."""
    ends = links.select(F.col("from_id").alias("url_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("to_id").alias("url_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("url_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def cited_by(links: DataFrame, urls: DataFrame) -> DataFrame:
    """to_id, site_id (of the sources), n_sources: counts of the reverse index :func:`citations`."""
    source = urls.select(F.col("url_id").alias("from_id"), "site_id")
    return links.join(source, "from_id").groupBy("to_id", "site_id").agg(F.count(F.lit(1)).alias("n_sources"))


def citations(links: DataFrame, urls: DataFrame) -> DataFrame:
    """to_id, site_id (of the source), from_id: the reverse index as rows, so a page that all others cite is no group."""
    return links.join(urls.select(F.col("url_id").alias("from_id"), "site_id"), "from_id").select("to_id", "site_id", "from_id")


def _outgoing(links: DataFrame, scratch: Scratch) -> DataFrame:
    out = links.groupBy("from_id").agg(F.count(F.lit(1)).alias("n_out"))
    return scratch.write(links.join(out, "from_id"), "outgoing")


def link_rank(links: DataFrame, scratch: Scratch, rounds: int = 10, saved: DataFrame | None = None) -> DataFrame:
    """url_id, rank after so many rounds from 1 (or the saved ranks).

    Only pages with links to them change, the weight of pages without outgoing links is lost, and nothing is normalised. A
    round is one join with the ranks and one combined sum; every second round's ranks are a table in the shared folder.
    """
    edges = _outgoing(links, scratch)
    pages = links.select(F.explode(F.array("from_id", "to_id")).alias("url_id")).distinct()
    one = F.lit(1.0)
    start = pages.withColumn("rank", one) if saved is None else pages.join(saved.select("url_id", F.col("rank").alias("r")), "url_id", "left").select("url_id", F.coalesce("r", one).alias("rank"))
    ranks = scratch.write(start, "ranks")
    written = ranks
    for k in range(1, rounds + 1):
        got = edges.join(ranks.withColumnRenamed("url_id", "from_id"), "from_id").groupBy(F.col("to_id").alias("url_id")).agg((DAMPING * F.sum(F.col("rank") / F.col("n_out")) + (1 - DAMPING)).alias("new"))
        ranks = ranks.join(got, "url_id", "left").select("url_id", F.coalesce("new", "rank").alias("rank"))
        if k % TOGETHER == 0 or k == rounds:
            ranks = scratch.write(ranks, "ranks")
            scratch.drop(written)
            written = ranks
    return ranks


def link_rank_incremental(links: DataFrame, ids: DataFrame, scratch: Scratch, rounds: int = 10, saved: DataFrame | None = None) -> DataFrame:
    """url_id, rank of all ids from a warm start: a source gives the mean of its last two ranks, and every id is updated."""
    edges = _outgoing(links, scratch)
    one = F.lit(1.0)
    start = ids.select("url_id", one.alias("rank")) if saved is None else ids.join(saved.select("url_id", F.col("rank").alias("r")), "url_id", "left").select("url_id", F.coalesce("r", one).alias("rank"))
    ranks = scratch.write(start.withColumn("prior", F.col("rank")), "ranks")
    written = ranks
    for k in range(1, rounds + 1):
        give = ranks.select(F.col("url_id").alias("from_id"), ((F.col("rank") + F.col("prior")) / 2).alias("mean"))
        got = edges.join(give, "from_id").groupBy(F.col("to_id").alias("url_id")).agg(F.sum(F.col("mean") / F.col("n_out")).alias("s"))
        new = (DAMPING * F.coalesce("s", F.lit(0.0)) + (1 - DAMPING)).alias("rank")
        ranks = ranks.join(got, "url_id", "left").select("url_id", new, F.col("rank").alias("prior"))
        if k % TOGETHER == 0 or k == rounds:
            ranks = scratch.write(ranks, "ranks")
            scratch.drop(written)
            written = ranks
    return ranks.select("url_id", "rank")
