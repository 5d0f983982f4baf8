"""The crawl's records: states, schedule, quotas, rules, copies and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmesh.functions.urls import prefixes
from siftmesh.operators.skewed_keys import numbered
from siftmesh.session import Scratch


def status_stats(urls: DataFrame, now, total: bool = False) -> DataFrame:
    """status, n_expired (due at ``now``), n_urls of URLs that aren't deleted; with ``total`` a row with null status for all."""
    live = urls.where(F.col("deleted") == 0)
    grouped = live.rollup("status") if total else live.groupBy("status")
    due = F.coalesce((F.col("next_index_time") <= F.lit(now)).cast("long"), F.lit(0).cast("long"))
    return grouped.agg(F.coalesce(F.sum(due), F.lit(0).cast("long")).alias("n_expired"), F.count(F.lit(1)).alias("n_urls"))


def site_url_counts(urls: DataFrame) -> DataFrame:
    """site_id, n_urls of URLs that were ever fetched."""
    return urls.where(F.col("status") != 0).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_urls"))


def next_documents(urls: DataFrame, now, limit: int, by_hops: bool = False) -> DataFrame:
    """The URLs that are fetched next: due, not deleted, oldest (or with fewest hops) first."""
    due = urls.where((F.col("deleted") == 0) & (F.col("next_index_time") <= F.lit(now)))
    order = [F.asc_nulls_last("hops"), "next_index_time", "url_id"] if by_hops else ["next_index_time", "url_id"]
    return due.orderBy(*order).limit(limit)


def site_quota(urls: DataFrame, most: int) -> DataFrame:
    """No more than ``most`` URLs of a site, the first due. Spark limits each site before the shuffle, so a huge site is ``most`` rows a task."""
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.asc_nulls_last("next_index_time"), "url_id"))
    return urls.withColumn("place", place).where(F.col("place") <= most).drop("place")


def round_robin(urls: DataFrame, at_once: int, scratch: Scratch) -> DataFrame:
    """url_id, site_id, round: rounds over the sites that take ``at_once`` URLs of each."""
    rows = urls.select("site_id", "url_id", F.coalesce("next_index_time", F.lit("9999-01-01").cast("timestamp_ntz")).alias("due"))
    return numbered(rows, "site_id", ["due", "url_id"], scratch).select("url_id", "site_id", F.floor((F.col("place") - 1) / at_once).alias("round"))


def first_rule(url: Column, rules: list[tuple[str, str, bool]], default: str | None = "Allow", extensions: dict[str, str] | None = None) -> Column:
    """Action of a URL: by its extension, else of the first rule (action, regex, negated) that it meets; case doesn't matter.

    The extension is what follows the last dot of the path's last part.
    """
    if extensions:
        named = F.lower(F.regexp_extract(url, r"^[^?#]*/[^/?#]*\.([^./?#]+)(?:[?#]|$)", 1))
        by_name = F.lit(None).cast("string")
        for extension, action in extensions.items():
            by_name = F.when(named == extension.lower(), action).otherwise(by_name)
        return F.coalesce(by_name, first_rule(url, rules, default))
    out = F.lit(default)
    for action, regex, negated in reversed(rules):
        hit = url.rlike(f"(?i){regex}")
        out = F.when(~hit if negated else hit, action).otherwise(out)
    return out


def mime_type(url: Column, rules: list[tuple[str, str]]) -> Column:
    """MIME type of the first rule (type, regex) that a URL meets, null without any; case doesn't matter."""
    return first_rule(url, [(kind, regex, False) for kind, regex in rules], None)


def scheduled(urls: DataFrame, at_once: int, delay: float, length: float, failed: DataFrame, ring: int, scratch: Scratch) -> DataFrame:
    """url_id, site_id, round, starts: when each URL is fetched, in seconds, if a fetch takes ``length``.

    Rounds over the sites take ``at_once`` URLs of each, one after another; a site rests ``delay`` seconds between its fetches.
    A site in ``failed`` (site_id, n_failed) waits in a ring for as many rounds as it has failed, ``ring`` at most.
    """
    rows = urls.select("site_id", "url_id", F.coalesce("next_index_time", F.lit("9999-01-01").cast("timestamp_ntz")).alias("due"))
    placed = numbered(rows, "site_id", ["due", "url_id"], scratch)
    waits = failed.where(F.col("site_id").isNotNull()).groupBy("site_id").agg(F.least(F.max("n_failed"), F.lit(ring)).cast("long").alias("waits"))
    placed = placed.join(waits, "site_id", "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long")))
    turn = F.floor((F.col("place") - 1) / at_once) + F.col("waits")
    starts = (F.col("place") - 1 + F.col("waits") * at_once) * max(delay, length)
    return placed.select("url_id", "site_id", turn.alias("round"), F.round(starts.cast("double"), 6).alias("starts"))


def replaced(url: Column, rules: list[tuple[str, str]]) -> Column:
    """All rules (regex, replacement with ``$1``) one after another, each everywhere in the URL."""
    return reduce(lambda u, r: F.regexp_replace(u, *r), rules, url)


def robots_allowed(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """``urls`` (url_id, site_id, path) with allowed. A rule (site_id, path) forbids the paths that begin with it.

    The reference forbids paths that contain the rule anywhere, which looks like an oversight.
    """
    hit = urls.join(robots.select("site_id", F.col("path").alias("rule")), "site_id").where(F.startswith("path", "rule") & (F.col("rule") != ""))
    return urls.join(hit.select("url_id").distinct().withColumn("hit", F.lit(True)), "url_id", "left").select(*urls.columns, F.col("hit").isNull().alias("allowed"))


def server_config(urls: DataFrame, configs: DataFrame) -> DataFrame:
    """``urls`` (url_id, url) with the columns of the longest matching prefix of ``configs`` (prefix, ...), null without any.

    Every URL probes with its own site and directories, so this is an equi-join whatever the number of configs.
    """
    rest = [c for c in configs.columns if c != "prefix"]
    probes = urls.select("url_id", F.explode(prefixes(F.col("url"))).alias("prefix"))
    best = probes.join(configs, "prefix").groupBy("url_id").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", *rest)).alias("c"))
    return urls.join(best, "url_id", "left").select(*urls.columns, F.col("c.prefix").alias("prefix"), *[F.col(f"c.{c}").alias(c) for c in rest])


def origins(urls: DataFrame, per_site: bool = True) -> DataFrame:
    """url_id, origin_id, n_copies of fetched URLs: the smallest url_id with the same content (and site) is the origin.

    A combined aggregate and a join; no window holds all copies of a content.
    """
    live = urls.where((F.col("status") == 200) & (F.col("deleted") == 0) & F.col("crc").isNotNull() & (F.col("crc") != ""))
    keys = ["crc", "site_id"] if per_site else ["crc"]
    live = live.where(F.col("site_id").isNotNull()) if per_site else live
    first = live.groupBy(*keys).agg(F.min("url_id").alias("origin_id"), F.count(F.lit(1)).alias("n_copies"))
    return live.join(first, keys).select("url_id", "origin_id", "n_copies")


def copies(urls: DataFrame, most: int = 10) -> DataFrame:
    """origin_id, url_id, place of up to ``most`` copies to show beside each origin."""
    rows = origins(urls).where(F.col("url_id") != F.col("origin_id"))
    place = F.row_number().over(Window.partitionBy("origin_id").orderBy("url_id")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= most).select("origin_id", "url_id", "place")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, state (same, changed, added, removed) of two snapshots with a digest."""
    both = old.select(key, F.col("digest").alias("a")).join(new.select(key, F.col("digest").alias("b")), key, "full")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(key, state.alias("state"))


def change_bits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, changed (digest differs), words, size, links (whether each differs) of records in both snapshots.

    Both have digest, wordcount, docsize and hrefs. What differs says what must be written again; order and repeats of links don't count.
    """
    fields = ("digest", "wordcount", "docsize", "hrefs")
    both = old.select(key, *[F.col(c).alias(f"_{c}") for c in fields]).join(new.select(key, *fields), key)
    links = lambda c: F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<long>"))))
    return both.select(
        key, (~F.col("_digest").eqNullSafe(F.col("digest"))).alias("changed"), (~F.col("_wordcount").eqNullSafe(F.col("wordcount"))).alias("words"),
        (~F.col("_docsize").eqNullSafe(F.col("docsize"))).alias("size"), (links("_hrefs") != links("hrefs")).alias("links"),
    )


def removed_words(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, word that an old version has and the new one lacks: the tombstones of an update."""
    pairs = [key, "word"]
    return old.select(*pairs).distinct().join(new.select(*pairs).distinct(), pairs, "left_anti")


def integrity(postings: DataFrame, urls: DataFrame) -> DataFrame:
    """fault, n_urls, n_entries of index entries (url_id) whose URL is missing, deleted, not fetched or a copy."""
    entries = postings.groupBy("url_id").agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.col("status").isNull(), "missing").when(F.col("deleted") != 0, "deleted").when(F.col("status") != 200, "status").when(F.col("origin") == 0, "copy")
    joined = entries.join(urls.select("url_id", "status", "deleted", "origin"), "url_id", "left").withColumn("fault", fault)
    return joined.where(F.col("fault").isNotNull()).groupBy("fault").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_entries"))


def upserted(urls: DataFrame, found: DataFrame, next_id: int, scratch: Scratch) -> DataFrame:
    """``urls`` (url_id, url, deleted) after finding ``found`` (url): known ones revive, new ones follow on ``next_id`` by name."""
    names = found.where(F.col("url").isNotNull()).select("url").distinct()
    revived = urls.join(names.withColumn("hit", F.lit(True)), "url", "left").withColumn("deleted", F.when(F.col("hit"), 0).otherwise(F.col("deleted"))).select("url_id", "url", "deleted")
    new = numbered(names.join(urls.select("url"), "url", "left_anti").withColumn("all", F.lit(0)), "all", ["url"], scratch)
    return revived.unionByName(new.select((F.col("place") - 1 + next_id).alias("url_id"), "url", F.lit(0).alias("deleted")))


def admitted_links(links: DataFrame, urls: DataFrame, max_hops: int) -> DataFrame:
    """from_id, to_id of links that a crawl follows: no self links, within the hops, on the same site or a known one."""
    a = urls.select(F.col("url_id").alias("from_id"), F.col("site_id").alias("from_site"), F.col("hops").alias("from_hops"))
    b = urls.select(F.col("url_id").alias("to_id"), F.col("site_id").alias("to_site"), F.col("known_site"))
    rows = links.where(F.col("from_id") != F.col("to_id")).join(a, "from_id").join(b, "to_id")
    return rows.where((F.col("from_hops") + 1 <= max_hops) & ((F.col("from_site") == F.col("to_site")) | F.col("known_site"))).select("from_id", "to_id")
