"""From weighted hits to ordered, grouped and paged results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, DATE = "rate", "date"
#: Pages that a query may ask for in all.
MOST = 1_000_000


def quantized_rank(rank: Column) -> Column:
    """Link rank in 16 bits: 0 for none, else floor(ln(10 r) * 2000), cut to 16 bits."""
    q = F.floor(F.log(rank * 10) * 2000).bitwiseAND(F.lit(0xFFFF))
    return F.when(rank.isNull() | (rank <= 0), F.lit(0)).otherwise(q).cast("long")


def final_weight(wp: Column, rank: Column) -> Column:
    """Word weight and quantized rank in 32 bits; hits in the body keep five bits of the former."""
    wp = wp.cast("long")
    strong = F.shiftleft(wp, 16) + rank
    weak = F.shiftleft(wp.bitwiseAND(F.lit(0xF800)), 16) + F.shiftleft(rank, 11)
    return F.when(wp.bitwiseAND(F.lit(0x6000)) != 0, strong).otherwise(weak).bitwiseAND(F.lit(0xFFFFFFFF))


def rating(weight: Column) -> Column:
    """The weight as it is shown: a part of the largest one, with five digits."""
    return F.format_string("%7.5f", weight / 4294967296)


def weighted(hits: DataFrame, ranks: DataFrame | None = None, site_weights: DataFrame | None = None, lastmod: DataFrame | None = None, sort: str = RATE) -> DataFrame:
    """hits with weight (by rate or by date), within (the order inside a site) and site_weight.

    ranks: url_id, rank. lastmod: url_id, hour. site_weights: site_id, weight; sites that aren't listed weigh 0.
    """
    out = hits.withColumn("wp", F.col("wp").cast("long"))
    if sort == RATE:
        out = out.join(ranks.select("url_id", quantized_rank(F.col("rank")).alias("q")), "url_id", "left") if ranks is not None else out.withColumn("q", F.lit(0).cast("long"))
        q = F.coalesce("q", F.lit(0).cast("long"))
        out = out.withColumn("weight", final_weight(F.col("wp"), q)).withColumn("within", F.shiftleft("wp", 16) + q).drop("q")
    else:
        out = out.join(lastmod.select("url_id", F.col("hour").cast("long").alias("weight")), "url_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long"))).withColumn("within", F.col("weight"))
    if site_weights is None:
        return out.withColumn("site_weight", F.lit(0).cast("long"))
    sw = site_weights.select("site_id", F.col("weight").cast("long").alias("site_weight"))
    return out.join(sw, "site_id", "left").withColumn("site_weight", F.coalesce("site_weight", F.lit(0).cast("long")))



def _order() -> list[Column]:
    return [F.desc("site_weight"), F.desc("weight"), F.asc("url_id")]


def top(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in result order (site weight, weight, url_id): a partial sort in each task, then a merge of n rows each."""
    return rows.orderBy(*_order()).limit(min(n, MOST))


def by_site(rows: DataFrame) -> DataFrame:
    """site_id, url_id, weight, second_url, second_weight, n_urls, site_weight: the best two documents of each site.

    The two best and the count are one aggregate with map-side combine, so a site with very many hits is a few rows a
    task. Ties go to the smaller url_id. If a single site matches at all, use :func:`top` instead, as a search does.
    """
    def first(skip: int) -> Column:
        return F.struct((-F.col("within")).alias("o"), "url_id", "weight")

    best = rows.groupBy("site_id").agg(F.min(first(0)).alias("b"), F.count(F.lit(1)).alias("n_urls"), F.max("site_weight").alias("site_weight"))
    second = rows.join(best.select("site_id", F.col("b.url_id").alias("best_url")), "site_id").where(F.col("url_id") != F.col("best_url"))
    second = second.groupBy("site_id").agg(F.min(first(1)).alias("s"))
    return best.join(second, "site_id", "left").select(
        "site_id", F.col("b.url_id").alias("url_id"), F.col("b.weight").alias("weight"), F.col("s.url_id").alias("second_url"),
        F.col("s.weight").alias("second_weight"), "n_urls", "site_weight",
    )


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of one result page, numbered from ``number * size + 1`` in ``place``."""
    rows = top(rows, (number + 1) * size)
    place = F.row_number().over(Window.orderBy(*_order())).cast("long")  # over at most (number + 1) * size rows
    return rows.withColumn("place", place).where(F.col("place") > number * size)


def result_totals(rows: DataFrame, size: int = 20) -> DataFrame:
    """n_sites, n_urls, n_pages (of results grouped by site)."""
    out = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_sites"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_urls"))
    return out.withColumn("n_pages", F.ceil(F.col("n_sites") / size).cast("long"))


def both_stores(main: DataFrame, fresh: DataFrame) -> DataFrame:
    """Hits of the main and the real-time store; of a URL in both the main one counts."""
    rows = main.withColumn("store", F.lit(0)).unionByName(fresh.withColumn("store", F.lit(1)))
    rest = [c for c in main.columns if c != "url_id"]
    return rows.groupBy("url_id").agg(F.min(F.struct("store", *rest)).alias("r")).select("url_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def both_grouped(main: DataFrame, fresh: DataFrame) -> DataFrame:
    """As :func:`by_site` over weighted rows of the main and the real-time store.

    A URL in both is the main store's. Where the main store has a hit of a site, its best one is shown; the real-time
    store then only gives a runner-up and a higher site weight.
    """
    rows = both_stores(main, fresh).join(main.select("url_id", F.lit(0).alias("late")).distinct(), "url_id", "left").withColumn("late", F.coalesce("late", F.lit(1)))
    order = F.struct((-F.col("within")).alias("o"), "url_id", "weight")
    first = rows.groupBy("site_id").agg(F.min(F.struct("late", order.alias("r"))).alias("b"), F.count(F.lit(1)).alias("n_urls"), F.max("site_weight").alias("site_weight"))
    second = rows.join(first.select("site_id", F.col("b.r.url_id").alias("best_url")), "site_id").where(F.col("url_id") != F.col("best_url")).groupBy("site_id").agg(F.min(order).alias("s"))
    return first.join(second, "site_id", "left").select(
        "site_id", F.col("b.r.url_id").alias("url_id"), F.col("b.r.weight").alias("weight"), F.col("s.url_id").alias("second_url"),
        F.col("s.weight").alias("second_weight"), "n_urls", "site_weight",
    )


def federated_totals(totals: list[DataFrame]) -> DataFrame:
    """n_sites, n_urls (summed; a site counts once a server) and complex (whether any server had to do much) of several servers.

    Each has n_sites, n_urls and complex.
    """
    zero = F.lit(0).cast("long")
    return reduce(DataFrame.unionByName, [t.select("n_sites", "n_urls", "complex") for t in totals]).agg(
        F.coalesce(F.sum("n_sites"), zero).alias("n_sites"), F.coalesce(F.sum("n_urls"), zero).alias("n_urls"), F.coalesce(F.bool_or("complex"), F.lit(False)).alias("complex")
    )


def federated_words(statistics: list[DataFrame]) -> DataFrame:
    """word, urlcount, totalcount summed over several servers."""
    return reduce(DataFrame.unionByName, statistics).groupBy("word").agg(F.sum("urlcount").alias("urlcount"), F.sum("totalcount").alias("totalcount"))


def federated(shards: list[DataFrame], n: int) -> DataFrame:
    """The best n of several servers: each sends its own best n, with its number as shard; a site competes once a server."""
    each = [top(s, n).withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    return reduce(DataFrame.unionByName, each).orderBy(*_order(), F.asc("shard")).limit(n)


def word_statistics(dictionary: DataFrame, words: list[str]) -> DataFrame:
    """word, urlcount, totalcount of the query's words, from the dictionary; words that it hasn't have zeros."""
    asked = dictionary.sparkSession.createDataFrame([(w,) for w in words], "word string")
    zero = F.lit(0).cast("long")
    return asked.join(dictionary.where(F.col("word").isin(words)), "word", "left").select("word", F.coalesce("urlcount", zero).alias("urlcount"), F.coalesce("totalcount", zero).alias("totalcount"))
