"""The public interface: search a store with a query and its parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmesh.operators import results
from siftmesh.plans.compile import Store, evaluate
from siftmesh.plans.query_language import Parsed, Vocabulary, normal, parse


@dataclass
class Parameters:
    """What a search may ask for besides its words."""

    sort: str = results.RATE
    group: bool = True
    number: int = 0
    size: int = 20
    site: int | None = None
    spaces: tuple[int, ...] = ()
    site_masks: tuple[str, ...] = ()
    subsets: tuple[str, ...] = ()
    since: int | None = None
    until: int | None = None
    first_only: bool = False
    distances: bool = True


@dataclass
class Side:
    """Tables beside the index. ranks: url_id, rank. lastmod: url_id, hour. spaces: space_id, site_id. site_weights: site_id, weight.
    sites: site_id, site. subsets: subset_id, mask. subset_urls: subset_id, url_id. copies: url_id, page."""

    ranks: DataFrame | None = None
    lastmod: DataFrame | None = None
    spaces: DataFrame | None = None
    site_weights: DataFrame | None = None
    sites: DataFrame | None = None
    subsets: DataFrame | None = None
    subset_urls: DataFrame | None = None
    copies: DataFrame | None = None


@dataclass
class Found:
    rows: DataFrame
    totals: DataFrame
    parsed: Parsed
    key: str = field(default="")


def filtered(hits: DataFrame, p: Parameters, side: Side) -> DataFrame:
    """Restrict hits to a site, to web spaces, to masks of sites, to subsets and to a time window.

    A subset is named by its mask, or as ``site/#N`` by its number; a hit must be in one of those that are named. What isn't known has no
    hits.
    """
    if p.site is not None:
        hits = hits.where(F.col("site_id") == p.site)
    if p.spaces:
        hits = hits.join(side.spaces.where(F.col("space_id").isin(list(p.spaces))).select("site_id").distinct(), "site_id", "left_semi")
    if p.site_masks:
        like = reduce(lambda a, b: a | b, [F.col("site").like(mask) for mask in p.site_masks])
        hits = hits.join(side.sites.where(like).select("site_id"), "site_id", "left_semi")
    if p.subsets:
        numbers = [int(n) for s in p.subsets if (n := s.rpartition("/#")[2]).isdigit() and "/#" in s]
        named = side.subsets.where(F.col("mask").isin(list(p.subsets)) | F.col("subset_id").isin(numbers)).select("subset_id")
        hits = hits.join(side.subset_urls.join(named, "subset_id", "left_semi").select("url_id"), "url_id", "left_semi")
    if p.since is not None or p.until is not None:
        hour = F.col("hour")
        inside = hour.between(p.since or 1, 0xFFFF if p.until is None else p.until) & (hour != 0)
        hits = hits.join(side.lastmod.where(inside).select("url_id"), "url_id", "left_semi")
    return hits


def placed(masks: list[str], subsets: DataFrame | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Masks of a form, told apart: those that are no subset restrict sites, the others are subsets."""
    known = {r["mask"] for r in subsets.where(F.col("mask").isin(masks)).select("mask").toLocalIterator()} if subsets is not None and masks else set()
    return tuple(m for m in masks if m not in known and "/#" not in m), tuple(m for m in masks if m in known or "/#" in m)


def search(store: Store, query: str, parameters: Parameters | None = None, vocabulary: Vocabulary | None = None, side: Side | None = None) -> Found:
    """Parse, evaluate, filter, weigh, group and page.

    Grouped results have the best two documents of each site. If exactly one site matches, grouping goes off and all its
    documents are listed. Nothing runs before the result is read, but for that one count.
    """
    p, side = parameters or Parameters(), side or Side()
    parsed = parse(query, vocabulary)
    hits = filtered(evaluate(parsed.tree, store, p.distances), p, side)
    rows = results.weighted(hits, side.ranks, side.site_weights, side.lastmod, p.sort)
    totals = results.result_totals(rows, p.size)
    if p.group and p.site is None and len(rows.select("site_id").distinct().take(2)) != 1:
        rows = results.by_site(rows)
    shown = results.top(rows, 1) if p.first_only else results.page(rows, p.number, p.size)
    return Found(shown, totals, parsed, normal(parsed.tree))
