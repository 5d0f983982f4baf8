"""Queries on what is kept and on responses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmesh.functions import charsets as B
from siftmesh.functions import http as H
from siftmesh.operators import links as L
from siftmesh.operators import postings as P
from siftmesh.operators import storage as K
from siftmesh.plans import crawl_catalog, to_sql
from siftmesh.plans.compile import url_is
from siftmesh.session import Scratch
from siftmesh.sources.files import robots_rules
from siftmesh.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
_W = "WITH " + to_sql.URLS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("save_content", f"{_W}, o AS (SELECT url_id, title FROM page WHERE url_id % 3 <> 0), n AS (SELECT url_id, keywords AS title FROM page WHERE url_id % 2 = 0) SELECT url_id, title FROM n UNION ALL SELECT url_id, title FROM o WHERE url_id NOT IN (SELECT url_id FROM n)")
def save_content(spark, d):
    rows = P.pages(spark, d, "title", "keywords")
    return K.saved(rows.where(F.col("url_id") % 3 != 0).select("url_id", "title"), rows.where(F.col("url_id") % 2 == 0).select("url_id", F.col("keywords").alias("title")), "url_id")


@query("clear_by_mask", f"{_W} SELECT url_id FROM u WHERE NOT coalesce((url LIKE '%/garden/%' OR url LIKE '%.php%') AND (status = 200 OR status = 404), false)")
def clear_by_mask(spark, d):
    return K.cleared(crawl_catalog.urls(spark, d), {"url": ["%/garden/%", "%.php%"], "status": [200, 404]}).select("url_id")


@query("word_ids", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\p{L}0-9]+')) AS word FROM urlwords), k AS (SELECT lower(trim(word, ' ' || chr(9))) AS word, min(word_id) AS word_id FROM wordurlu WHERE lower(trim(word, ' ' || chr(9))) <> '' GROUP BY 1)
SELECT word, word_id FROM k UNION ALL SELECT word, row_number() OVER (ORDER BY encode(word)) + (SELECT max(word_id) FROM k) FROM w WHERE word NOT IN (SELECT word FROM k)""")
def word_ids(spark, d):
    from siftmesh.functions.text import words
    from siftmesh.sources.tables import word_key

    known = read(spark, d, "wordurlu").select(word_key().alias("word"), "word_id").where(F.col("word").isNotNull()).groupBy("word").agg(F.min("word_id").alias("word_id"))
    return K.word_ids(read(spark, d, "urlwords").select(F.explode(words("title")).alias("word")), known, Scratch(spark, "ids"))


@query("subset_urls", f"{_W} SELECT 1 AS subset_id, url_id FROM u WHERE url LIKE 'https://%' UNION ALL SELECT 2, url_id FROM u WHERE url LIKE '%/member/%' UNION ALL SELECT 3, url_id FROM u WHERE url LIKE '%.html'")
def subset_urls(spark, d):
    subsets = spark.createDataFrame([(1, "https://%"), (2, "%/member/%"), (3, "%.html")], "subset_id int, mask string")
    return K.subset_urls(crawl_catalog.urls(spark, d), subsets)


@query("space_sites", "WITH s AS (SELECT DISTINCT site_id % 4 AS space_id, site_id FROM sites UNION SELECT 9, site_id FROM sites WHERE site_id % 6 = 0) SELECT space_id, count(*) AS n_sites FROM s WHERE NOT (space_id = 1 AND site_id % 5 = 0) GROUP BY space_id")
def space_sites(spark, d):
    sites = read(spark, d, "sites")
    spaces = sites.select((F.col("site_id") % 4).alias("space_id"), "site_id")
    add = sites.where(F.col("site_id") % 6 == 0).select(F.lit(9).cast("long").alias("space_id"), "site_id")
    remove = sites.where(F.col("site_id") % 5 == 0).select(F.lit(1).cast("long").alias("space_id"), "site_id")
    return K.changed_spaces(spaces, add, remove).groupBy("space_id").agg(F.count(F.lit(1)).alias("n_sites"))


@query("url_lookup", f"WITH RECURSIVE {to_sql.URLS}, {crawl_catalog._REDIR}, t AS (SELECT * FROM u WHERE redir <> 0 AND url LIKE 'http://%' ORDER BY url_id LIMIT 1) SELECT coalesce(fin.to_id, t.url_id) AS url_id FROM t LEFT JOIN fin ON fin.from_id = t.url_id")
def url_lookup(spark, d):
    """The URL named without its scheme, after its redirects."""
    u = crawl_catalog.urls(spark, d)
    row = u.where((F.col("redir") != 0) & F.col("url").like("http://%")).orderBy("url_id").first()
    name = row["url"][len("http://") :] if row else "none"
    r = crawl_catalog.redirects(spark, d, Scratch(spark, "lookup")).select(F.col("from_id").alias("url_id"), "to_id")
    return u.where(url_is(F.col("url"), name)).select("url_id").join(r, "url_id", "left").select(F.coalesce("to_id", "url_id").alias("url_id"))


@query("status_classes", f"{_W} SELECT CASE WHEN status = 200 THEN 'ok' WHEN status IN (301, 302) THEN 'redirect' WHEN status = 304 THEN 'unchanged' WHEN status IN (404, 410) THEN 'delete' WHEN status = 503 THEN 'retry' ELSE 'unknown' END AS class, count(*) AS n FROM u GROUP BY ALL")
def status_classes(spark, d):
    return crawl_catalog.urls(spark, d).groupBy(H.status_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("content_types", f"{_W} SELECT nullif(lower(trim(regexp_extract(content_type, '^([^;]*)', 1))), '') AS kind, nullif(lower(regexp_extract(content_type, 'charset\\s*=\\s*[\"'']?([\\w.:-]+)', 1, 'i')), '') AS given, count(*) AS n FROM page GROUP BY ALL")
def content_types(spark, d):
    rows = read(spark, d, "urlwords").where("url_id is not null").groupBy("url_id").agg(F.min("content_type").alias("t"))
    return rows.groupBy(H.content_type(F.col("t")).alias("kind"), H.charset(F.col("t")).alias("given")).agg(F.count(F.lit(1)).alias("n"))


@query("response_headers", f"{_W} SELECT url_id, 'text/plain' AS kind, 'a' || url_id AS tag, CASE WHEN seconds > 1736294400 THEN seconds ELSE 1736294400 END AS due FROM (SELECT url_id, {crawl_catalog._HTTP} AS seconds FROM (SELECT url_id, trim(last_modified) AS m FROM u))")
def response_headers(spark, d):
    """url_id, kind, tag, due of a response put together from each URL's fields."""
    u = crawl_catalog.urls(spark, d)
    text = F.concat(F.lit("HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=x\r\nX: 1\r\nContent-type : text/plain\r\nETag: a"), F.col("url_id").cast("string"), F.lit("\r\nExpires: "), F.coalesce("last_modified", F.lit("")), F.lit("\r\n"))
    h = u.select("url_id", H.headers(text).alias("h"))
    return h.select("url_id", F.col("h")["content-type"].alias("kind"), F.col("h")["etag"].alias("tag"), H.next_visit(F.lit(1735689600), 604800, F.col("h")["expires"]).alias("due"))


@query("robots_parse", "SELECT DISTINCT site_id, '/a' AS path FROM sites UNION ALL SELECT DISTINCT site_id, '/' || site_id FROM sites")
def robots_parse(spark, d):
    body = F.concat(F.lit("# all\nUser-agent: other\nDisallow: /never\n\nUser-agent: x\nUser-agent: *\nDisallow: /a # why\nDisallow:\nDisallow: /"), F.col("site_id").cast("string"), F.lit("\r\nAllow: /b\nUser-agent: last\nDisallow: /c"))
    return robots_rules(read(spark, d, "sites").where("site_id is not null").select("site_id", body.alias("body")).distinct(), "siftmesh")


@query("total_urls", f"{_W} SELECT count(*) AS n FROM u WHERE deleted = 0 AND status = 200")
def total_urls(spark, d):
    return crawl_catalog.urls(spark, d).where("deleted = 0 and status = 200").agg(F.count(F.lit(1)).alias("n"))


@query("link_totals", f"{crawl_catalog._WR}, {crawl_catalog._ED} SELECT count(*) AS n_links, count(DISTINCT from_id) AS n_from, count(DISTINCT to_id) AS n_to FROM e")
def link_totals(spark, d):
    deg = L.degrees(crawl_catalog.edges(spark, d, Scratch(spark, "links")))
    n = lambda c: F.coalesce(F.sum((F.col(c) > 0).cast("long")), F.lit(0).cast("long"))
    return deg.agg(F.coalesce(F.sum("n_out"), F.lit(0).cast("long")).alias("n_links"), n("n_out").alias("n_from"), n("n_in").alias("n_to"))


@query("delta_append", "SELECT coalesce(word_id % 100, -1) AS part, count(*) AS n, count(DISTINCT block_id) AS n_blocks FROM (SELECT word_id, block_id FROM wordurlu UNION ALL SELECT word_id, block_id FROM wordurlu WHERE block_id % 3 = 0) GROUP BY ALL")
def delta_append(spark, d):
    """The index's blocks appended to a log by part, a third of them twice, and read back."""
    path = Scratch(spark, "log").path("log")
    rows = read(spark, d, "wordurlu").select("word_id", "block_id")
    K.append_changes(rows, path)
    K.append_changes(rows.where(F.col("block_id") % 3 == 0), path)
    schema = "word_id long, block_id long, part int"
    part = F.coalesce(F.col("part").cast("long"), F.lit(-1).cast("long")).alias("part")
    return K.logged_changes(spark, path, schema=schema).groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block_id").alias("n_blocks"))


@query("purge_deleted", f"WITH {to_sql.postings()} SELECT word, count(*) AS n FROM postings JOIN u USING (url_id) WHERE status = 200 GROUP BY word")
def purge_deleted(spark, d):
    """Postings that are left by word when all URLs but those fetched well have been deleted."""
    flagged = crawl_catalog.urls(spark, d).withColumn("deleted", F.when(F.col("status") == 200, 0).otherwise(1))
    left = K.purged(P.served(spark, d).index, flagged)
    return left.groupBy("word").agg(F.sum("cnt").alias("n"))


@query("base64_text", f"{_W} SELECT url_id, base64(encode(title)) AS coded, title FROM doc WHERE title IS NOT NULL")
def base64_text(spark, d):
    coded64 = P.located(spark, d, "title").where(F.col("title").isNotNull()).select("url_id", F.regexp_replace(F.base64(F.encode("title", "UTF-8")), r"[\r\n]", "").alias("coded"))
    return coded64.select("url_id", "coded", F.decode(F.unbase64("coded"), "UTF-8").alias("title"))


CHARSETS = ("UTF-8", "ISO-8859-1", "UTF-16LE")


def coded(text, charset: str):
    """Bytes of a text; what Latin 1 doesn't have is a question mark."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?") if charset == "ISO-8859-1" else text, charset)


@query("charset_guess")
def charset_guess(spark, d):
    """url_id, guess (language and charset) of the crawl's titles and texts as bytes, by profiles of all documents of each language in each charset."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    texts = read(spark, d, "documents").where(lang.isin("en", "fr", "de", "es") & (F.length("text") > 0)).select(lang.alias("lang"), "text")
    named = F.explode(F.array(*[F.struct(F.concat_ws(" ", "lang", F.lit(c)).alias("name"), coded("text", c).alias("data")) for c in CHARSETS])).alias("r")
    profiles = B.learned(texts.select(named).select("r.name", "r.data"))
    both = F.concat_ws(" ", "title", "txt")
    data = F.when(F.col("url_id") % 3 == 0, coded(both, CHARSETS[0])).when(F.col("url_id") % 3 == 1, coded(both, CHARSETS[1])).otherwise(coded(both, CHARSETS[2]))
    rows = P.pages(spark, d, "title", "txt").where(F.length(both) > 0).select("url_id", data.alias("data"))
    return B.guessed(rows, profiles, "url_id", "data")
