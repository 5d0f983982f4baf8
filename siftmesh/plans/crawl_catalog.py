"""Queries on the crawl, its URLs, dates, links, countries and change logs with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmesh.functions import dates as D
from siftmesh.functions import urls as U
from siftmesh.operators import crawl as C
from siftmesh.operators import geo as G
from siftmesh.operators import links as L
from siftmesh.operators import postings as P
from siftmesh.plans import to_sql
from siftmesh.session import Scratch
from siftmesh.sources.tables import read, urls_once
from siftmesh.streaming import deltas as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2025-06-01 00:00:00"
_NOW_S = 1748736000
_W = "WITH " + to_sql.URLS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def urls(spark, d):
    return urls_once(read(spark, d, "urlword"), "site_id", "url", "status", "deleted", "crc", "origin", "redir", "referrer", "hops", "tag", "next_index_time", "last_index_time", "last_modified")


def sited(spark, d):
    return urls(spark, d).withColumn("site_id", F.coalesce("site_id", F.lit(0).cast("long")))


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# States and schedule

_DUE = f"coalesce(sum(CASE WHEN next_index_time <= TIMESTAMP '{NOW}' THEN 1 ELSE 0 END), 0)::BIGINT AS n_expired, count(*) AS n_urls"


@query("status_stats", f"{_W} SELECT status, {_DUE} FROM u WHERE deleted = 0 GROUP BY status")
def status_stats(spark, d):
    return C.status_stats(urls(spark, d), now())


@query("status_stats_total", f"{_W} SELECT status, {_DUE} FROM u WHERE deleted = 0 GROUP BY ROLLUP (status)")
def status_stats_total(spark, d):
    return C.status_stats(urls(spark, d), now(), total=True)


@query("site_url_counts", f"{_W} SELECT site_id, count(*) AS n_urls FROM u WHERE status <> 0 GROUP BY site_id")
def site_url_counts(spark, d):
    return C.site_url_counts(sited(spark, d))


@query("next_documents", f"{_W} SELECT url_id, next_index_time FROM u WHERE deleted = 0 AND next_index_time <= TIMESTAMP '{NOW}' ORDER BY next_index_time, url_id LIMIT 1000")
def next_documents(spark, d):
    return C.next_documents(urls(spark, d), now(), 1000).select("url_id", "next_index_time")


@query("next_documents_by_hops", f"{_W} SELECT url_id, hops FROM u WHERE deleted = 0 AND next_index_time <= TIMESTAMP '{NOW}' ORDER BY hops NULLS LAST, next_index_time, url_id LIMIT 1000")
def next_documents_by_hops(spark, d):
    return C.next_documents(urls(spark, d), now(), 1000, by_hops=True).select("url_id", "hops")


@query("site_quota", f"{_W} SELECT url_id, site_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY next_index_time NULLS LAST, url_id) AS rn FROM u) WHERE rn <= 3")
def site_quota(spark, d):
    return C.site_quota(sited(spark, d), 3).select("url_id", "site_id")


@query("round_robin_schedule", f"{_W} SELECT url_id, site_id, (row_number() OVER (PARTITION BY site_id ORDER BY coalesce(next_index_time, TIMESTAMP '9999-01-01'), url_id) - 1) // 4 AS round FROM u")
def round_robin_schedule(spark, d):
    return C.round_robin(sited(spark, d), 4, Scratch(spark, "rounds"))


@query("max_ids", f"{_W} SELECT max(url_id) AS max_url, max(hops) AS max_hops, count(*) AS n_urls FROM u")
def max_ids(spark, d):
    return urls(spark, d).agg(F.max("url_id").alias("max_url"), F.max("hops").alias("max_hops"), F.count(F.lit(1)).alias("n_urls"))


@query("urls_by_mask", f"{_W} SELECT url_id FROM u WHERE status = 200 AND deleted = 0 AND (url LIKE '%/garden/%' OR url LIKE '%.html')")
def urls_by_mask(spark, d):
    return urls(spark, d).where((F.col("status") == 200) & (F.col("deleted") == 0) & (F.col("url").like("%/garden/%") | F.col("url").like("%.html"))).select("url_id")


@query("dictionary_like", f"WITH {to_sql.postings()} SELECT count(DISTINCT word) AS n FROM postings WHERE word LIKE 'describ%'")
def dictionary_like(spark, d):
    return P.served(spark, d).dictionary.where(F.col("word").like("describ%")).agg(F.count("word").alias("n"))


@query("words_by_part", f"WITH {to_sql.URLS} SELECT word_id % 100 AS part, count(DISTINCT word_id) AS n FROM wordurlu GROUP BY ALL")
def words_by_part(spark, d):
    return read(spark, d, "wordurlu").select("word_id").distinct().groupBy(F.pmod("word_id", F.lit(100)).alias("part")).agg(F.count("word_id").alias("n"))


# Rules

_RULES = [("Allow", r"/garden/", False), ("Disallow", r"\.(php|cgi)(\?|$)", False), ("CheckOnly", r"\?", False), ("Disallow", r"^https?://", True), ("CheckOnly", r"/~", False)]
_REPLACE = [(r"^https://", "http://"), (r"\?([a-z]+)=([^&]*)", "/$1/$2"), (r"//www\.", "//")]


@query("url_filter_chain", f"{_W} SELECT url_id, CASE WHEN regexp_matches(url, '/garden/', 'i') THEN 'Allow' WHEN regexp_matches(url, '\\.(php|cgi)(\\?|$)', 'i') THEN 'Disallow' "
       "WHEN regexp_matches(url, '\\?', 'i') THEN 'CheckOnly' WHEN NOT regexp_matches(url, '^https?://', 'i') THEN 'Disallow' WHEN regexp_matches(url, '/~', 'i') THEN 'CheckOnly' ELSE 'Allow' END AS action FROM u")
def url_filter_chain(spark, d):
    return urls(spark, d).select("url_id", C.first_rule(F.col("url"), _RULES).alias("action"))


_EXTENSION = r"lower(regexp_extract(url, '^[^?#]*/[^/?#]*\.([^./?#]+)(?:[?#]|$)', 1))"


@query("extension_rules", f"{_W} SELECT url_id, CASE WHEN {_EXTENSION} = 'html' THEN 'CheckOnly' WHEN {_EXTENSION} = 'php' THEN 'Allow' WHEN regexp_matches(url, '/garden/', 'i') THEN 'Disallow' ELSE 'Allow' END AS action FROM u")
def extension_rules(spark, d):
    return urls(spark, d).select("url_id", C.first_rule(F.col("url"), [("Disallow", "/garden/", False)], extensions={"html": "CheckOnly", "PHP": "Allow"}).alias("action"))


@query("mime_by_url", f"{_W} SELECT url_id, CASE WHEN regexp_matches(url, '\\.html?(\\?|$)', 'i') THEN 'text/html' WHEN regexp_matches(url, '\\.php', 'i') THEN 'application/x-php' WHEN regexp_matches(url, '/$', 'i') THEN 'text/html' END AS mime FROM u")
def mime_by_url(spark, d):
    return urls(spark, d).select("url_id", C.mime_type(F.col("url"), [("text/html", r"\.html?(\?|$)"), ("application/x-php", r"\.php"), ("text/html", "/$")]).alias("mime"))


_TURN = f"""{_W}, o AS (SELECT url_id, coalesce(site_id, 0) AS site_id, row_number() OVER (PARTITION BY coalesce(site_id, 0) ORDER BY coalesce(next_index_time, TIMESTAMP '9999-01-01'), url_id) - 1 AS p, CASE WHEN coalesce(site_id, 0) % 4 = 1 THEN least(coalesce(site_id, 0) % 20, 10) ELSE 0 END AS w FROM u)
SELECT url_id, site_id, p // 5 + w AS round, (p + w * 5) * 1.5 AS starts FROM o"""


@query("schedule_with_delays", _TURN)
def schedule_with_delays(spark, d):
    """Five URLs of a site a round, 1.5 seconds apart; sites that failed wait in a ring of ten."""
    u = sited(spark, d)
    failed = u.where(F.col("site_id") % 4 == 1).select("site_id", (F.col("site_id") % 20).alias("n_failed"))
    return C.scheduled(u, 5, 1.5, 1.0, failed, 10, Scratch(spark, "schedule"))


@query("url_replace", f"{_W} SELECT url_id, regexp_replace(regexp_replace(regexp_replace(url, '^https://', 'http://', 'g'), '\\?([a-z]+)=([^&]*)', '/\\1/\\2', 'g'), '//www\\.', '//', 'g') AS url FROM u")
def url_replace(spark, d):
    return urls(spark, d).select("url_id", C.replaced(F.col("url"), _REPLACE).alias("url"))


_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^#]*)', 1)"


@query("robots_filter", f"{_W}, r AS (SELECT DISTINCT site_id, CASE site_id % 3 WHEN 0 THEN '/garden' WHEN 1 THEN '/cgi/' ELSE '' END AS rule FROM sites) "
       f"SELECT url_id, NOT EXISTS (SELECT 1 FROM r WHERE r.site_id = u.site_id AND rule <> '' AND starts_with({_PATH}, rule)) AS allowed FROM u")
def robots_filter(spark, d):
    robots = read(spark, d, "sites").select("site_id", F.when(F.col("site_id") % 3 == 0, "/garden").when(F.col("site_id") % 3 == 1, "/cgi/").otherwise("").alias("path")).distinct()
    rows = sited(spark, d).select("url_id", "site_id", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+(/[^#]*)", 1).alias("path"))
    return C.robots_allowed(rows, robots).select("url_id", "allowed")


@query("server_longest_prefix", f"{_W}, c AS (SELECT site AS prefix, 10 AS max_hops FROM (SELECT DISTINCT site FROM sites) UNION ALL SELECT DISTINCT regexp_extract(url, '^([A-Za-z]+://[^/?#]+/[^/?#]+/)', 1), 3 FROM u WHERE url LIKE '%/garden/%' OR url LIKE '%/cgi/%') "
       "SELECT url_id, prefix, max_hops FROM (SELECT url_id, prefix, max_hops, row_number() OVER (PARTITION BY url_id ORDER BY length(prefix) DESC, max_hops DESC) AS rn FROM u LEFT JOIN (SELECT prefix, max(max_hops) AS max_hops FROM c WHERE prefix <> '' GROUP BY prefix) c ON starts_with(url, prefix)) WHERE rn = 1")
def server_longest_prefix(spark, d):
    u = urls(spark, d)
    own = u.where(F.col("url").like("%/garden/%") | F.col("url").like("%/cgi/%")).select(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+/[^/?#]+/)", 1).alias("prefix"), F.lit(3).alias("max_hops"))
    configs = read(spark, d, "sites").select(F.col("site").alias("prefix"), F.lit(10).alias("max_hops")).unionByName(own).where(F.col("prefix") != "").groupBy("prefix").agg(F.max("max_hops").alias("max_hops"))
    return C.server_config(u.select("url_id", "url"), configs).select("url_id", "prefix", "max_hops")


# Copies and changes

_LIVE = "live AS (SELECT * FROM page_u WHERE status = 200 AND deleted = 0 AND crc <> '' AND sid IS NOT NULL)"
_PU = "page_u AS (SELECT url_id, min(site_id) AS sid, min(status) AS status, max(deleted) AS deleted, min(crc) AS crc FROM urlword GROUP BY url_id)"


@query("clone_origins", f"WITH {_PU}, {_LIVE} SELECT url_id, min(url_id) OVER (PARTITION BY crc, sid) AS origin_id, count(*) OVER (PARTITION BY crc, sid) AS n_copies FROM live")
def clone_origins(spark, d):
    return C.origins(urls(spark, d))


@query("clone_list", f"WITH {_PU}, {_LIVE}, o AS (SELECT url_id, min(url_id) OVER (PARTITION BY crc, sid) AS origin_id FROM live) SELECT * FROM (SELECT origin_id, url_id, row_number() OVER (PARTITION BY origin_id ORDER BY url_id) AS place FROM o WHERE url_id <> origin_id) WHERE place <= 10")
def clone_list(spark, d):
    return C.copies(urls(spark, d))


_OLD_NEW = "old AS (SELECT url_id, coalesce(title, '') AS text FROM page WHERE url_id % 11 <> 0), new AS (SELECT url_id, CASE WHEN url_id % 5 = 0 THEN coalesce(keywords, '') ELSE coalesce(title, '') END AS text FROM page WHERE url_id % 7 <> 0)"


def _versions(spark, d):
    rows = P.pages(spark, d, "title", "keywords")
    old = rows.where(F.col("url_id") % 11 != 0).select("url_id", F.coalesce("title", F.lit("")).alias("text"))
    new = rows.where(F.col("url_id") % 7 != 0).select("url_id", F.when(F.col("url_id") % 5 == 0, F.coalesce("keywords", F.lit(""))).otherwise(F.coalesce("title", F.lit(""))).alias("text"))
    return old, new


@query("change_detect", f"{_W}, {_OLD_NEW} SELECT url_id, CASE WHEN old.text IS NULL THEN 'added' WHEN new.text IS NULL THEN 'removed' WHEN md5(old.text) = md5(new.text) THEN 'same' ELSE 'changed' END AS state FROM old FULL JOIN new USING (url_id)")
def change_detect(spark, d):
    old, new = (t.select("url_id", F.md5("text").alias("digest")) for t in _versions(spark, d))
    return C.changes(old, new, "url_id")


_BITS = "old AS (SELECT url_id, md5(coalesce(txt, '')) AS digest, wordcount, docsize, hrefs FROM page), new AS (SELECT url_id, md5(coalesce(CASE WHEN url_id % 5 = 0 THEN title ELSE txt END, '')) AS digest, CASE WHEN url_id % 3 = 0 THEN wordcount + 1 ELSE wordcount END AS wordcount, docsize, CASE WHEN url_id % 7 = 0 THEN hrefs[1:1] ELSE list_reverse(hrefs) END AS hrefs FROM page)"
_SET = "list_sort(list_distinct(coalesce({0}.hrefs, [])))"


@query("change_bits", f"{_W}, {_BITS} SELECT url_id, old.digest <> new.digest AS changed, old.wordcount IS DISTINCT FROM new.wordcount AS words, old.docsize IS DISTINCT FROM new.docsize AS size, {_SET.format('old')} <> {_SET.format('new')} AS links FROM old JOIN new USING (url_id)")
def change_bits(spark, d):
    rows = P.pages(spark, d, "txt", "title", "wordcount", "docsize", "hrefs")
    text = F.when(F.col("url_id") % 5 == 0, F.col("title")).otherwise(F.col("txt"))
    old = rows.select("url_id", F.md5(F.coalesce("txt", F.lit(""))).alias("digest"), "wordcount", "docsize", "hrefs")
    count = F.when(F.col("url_id") % 3 == 0, F.col("wordcount") + 1).otherwise(F.col("wordcount"))
    hrefs = F.when(F.col("url_id") % 7 == 0, F.slice("hrefs", 1, 1)).otherwise(F.reverse("hrefs"))
    new = rows.select("url_id", F.md5(F.coalesce(text, F.lit(""))).alias("digest"), count.alias("wordcount"), "docsize", hrefs.alias("hrefs"))
    return C.change_bits(old, new, "url_id")


@query("removed_words", f"{_W}, {_OLD_NEW}, a AS (SELECT DISTINCT url_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}0-9]+')) AS word FROM old), b AS (SELECT DISTINCT url_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}0-9]+')) AS word FROM new) SELECT * FROM a EXCEPT SELECT * FROM b")
def removed_words(spark, d):
    from siftmesh.functions.text import words

    old, new = (t.select("url_id", F.explode(words("text")).alias("word")) for t in _versions(spark, d))
    return C.removed_words(old, new, "url_id")


@query("integrity_check", """WITH e AS (SELECT u AS url_id, count(*) AS n FROM (SELECT unnest(urls) AS u FROM wordurlu) WHERE u IS NOT NULL GROUP BY u),
s AS (SELECT url_id, min(status) AS status, max(deleted) AS deleted, min(origin) AS origin FROM urlword GROUP BY url_id),
f AS (SELECT n, CASE WHEN status IS NULL THEN 'missing' WHEN deleted <> 0 THEN 'deleted' WHEN status <> 200 THEN 'status' WHEN origin = 0 THEN 'copy' END AS fault FROM e LEFT JOIN s USING (url_id))
SELECT fault, count(*) AS n_urls, sum(n)::BIGINT AS n_entries FROM f WHERE fault IS NOT NULL GROUP BY fault""")
def integrity_check(spark, d):
    entries = read(spark, d, "wordurlu").select(F.explode("urls").alias("url_id")).where(F.col("url_id").isNotNull())
    return C.integrity(entries, urls(spark, d))


@query("url_upsert", f"{_W}, f AS (SELECT DISTINCT CASE WHEN url_id % 9 = 0 THEN url || '#new' ELSE url END AS url FROM u WHERE url_id % 3 = 0), n AS (SELECT url FROM f WHERE url NOT IN (SELECT url FROM u)) "
       "SELECT url_id, url, CASE WHEN url IN (SELECT url FROM f) THEN 0 ELSE deleted END AS deleted FROM u UNION ALL SELECT 9999999 + row_number() OVER (ORDER BY url), url, 0 FROM n")
def url_upsert(spark, d):
    u = urls(spark, d)
    found = u.where(F.col("url_id") % 3 == 0).select(F.when(F.col("url_id") % 9 == 0, F.concat("url", F.lit("#new"))).otherwise(F.col("url")).alias("url"))
    return C.upserted(u.select("url_id", "url", "deleted"), found, 10_000_000, Scratch(spark, "upsert"))


# URLs

_DEC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/?#]*)(?::(\d+))?)?([^?#]*?)([^/?#]*)(\?[^#]*)?(?:#.*)?$"


@query("url_decompose", f"{_W} SELECT url_id, lower(regexp_extract(url, '{_DEC}', 1)) AS scheme, lower(regexp_extract(url, '{_DEC}', 4)) AS host, regexp_extract(url, '{_DEC}', 6) AS path, regexp_extract(url, '{_DEC}', 7) AS file, regexp_extract(url, '{_DEC}', 8) AS query FROM u WHERE url IS NOT NULL")
def url_decompose(spark, d):
    p = urls(spark, d).where(F.col("url").isNotNull()).select("url_id", U.decompose(F.col("url")).alias("p"))
    return p.select("url_id", *[F.col(f"p.{c}").alias(c) for c in ("scheme", "host", "path", "file", "query")])


_BASED = """b AS (SELECT url_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS root, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme,
coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*/)', 1), ''), '/') AS dir FROM u)"""


@query("url_resolve", f"{_W}, {_BASED} SELECT url_id, root || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END || 'a/b.html?x' AS up, root || '/s/' AS root, lower(scheme) || '://other.test/' AS other, root || dir || 'c' AS beside FROM b")
def url_resolve(spark, d):
    """Every URL with the links ``../a/./b.html?x``, ``/r/../s/``, ``//other.test/`` and ``c`` resolved against it."""
    return urls(spark, d).select("url_id", *[U.resolve(F.col("url"), F.lit(x)).alias(n) for n, x in (("up", "../a/./b.html?x"), ("root", "/r/../s/"), ("other", "//other.test/"), ("beside", "c#f"))])


@query("url_escape", f"{_W} SELECT url_id, url_encode(url) AS escaped FROM u")
def url_escape(spark, d):
    return urls(spark, d).select("url_id", U.escaped(F.col("url")).alias("escaped"))


@query("url_unescape", f"{_W} SELECT url_id, url AS plain FROM u")
def url_unescape(spark, d):
    return urls(spark, d).select("url_id", U.unescaped(U.escaped(F.col("url"))).alias("plain"))


@query("sites_extract", f"{_W} SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || '/' AS site, count(*) AS n_urls, count(DISTINCT nullif(site_id, 0)) AS n_ids FROM u WHERE url IS NOT NULL GROUP BY ALL")
def sites_extract(spark, d):
    return urls(spark, d).where(F.col("url").isNotNull()).groupBy(U.site_of(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n_urls"), F.countDistinct("site_id").alias("n_ids"))


@query("site_labels", "WITH s AS (SELECT DISTINCT site_id, string_split(lower(regexp_extract(site, '^[a-zA-Z]+://([^/:]+)', 1)), '.') AS l FROM sites) "
       "SELECT site_id, unnest(l) AS label, unnest(range(len(l)))::BIGINT AS from_left, (len(l) - 1 - unnest(range(len(l))))::BIGINT AS from_right FROM s")
def site_labels(spark, d):
    rows = read(spark, d, "sites").select("site_id", "site").distinct().select("site_id", F.explode(U.labels(F.col("site"))).alias("l"))
    return rows.select("site_id", "l.label", "l.from_left", "l.from_right")


# Dates

_MON = "(position(regexp_extract(m, '{0}', {1}) IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3"
_A, _B, _CC = r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d\d:\d\d:\d\d)", r"^\w+, (\d{1,2})-(\w{3})-(\d{2}) (\d\d:\d\d:\d\d)", r"^\w{3} (\w{3}) +(\d{1,2}) (\d\d:\d\d:\d\d) (\d{4})"


def _stamp(p: str, day: int, month: int, year: str, time: int) -> str:
    return f"epoch(CAST(printf('%04d-%02d-%02d %s', ({year})::INT, {_MON.format(p, month)}, regexp_extract(m, '{p}', {day})::INT, regexp_extract(m, '{p}', {time})) AS TIMESTAMP))::BIGINT"


_HTTP = (f"CASE WHEN regexp_matches(m, '{_A}') THEN {_stamp(_A, 1, 2, f'''regexp_extract(m, '{_A}', 3)''', 4)} "
         f"WHEN regexp_matches(m, '{_B}') THEN {_stamp(_B, 1, 2, f'''CASE WHEN regexp_extract(m, '{_B}', 3)::INT < 70 THEN 2000 ELSE 1900 END + regexp_extract(m, '{_B}', 3)::INT''', 4)} "
         f"WHEN regexp_matches(m, '{_CC}') THEN {_stamp(_CC, 2, 1, f'''regexp_extract(m, '{_CC}', 4)''', 3)} END")
_MOD = f"mod AS (SELECT url_id, {_HTTP} AS seconds FROM (SELECT url_id, last_modified AS m FROM u))"


@query("http_date_parse", f"{_W}, {_MOD} SELECT * FROM mod")
def http_date_parse(spark, d):
    return urls(spark, d).select("url_id", D.http_date("last_modified").alias("seconds"))


@query("duration_parse", f"{_W} SELECT url_id, CASE WHEN url_id % 7 = 0 THEN url_id WHEN url_id % 7 = 1 THEN NULL ELSE (url_id % 5) * 31536000 + (url_id % 11) * 2592000 - (url_id % 31) * 86400 + (url_id % 24) * 3600 + (url_id % 60) * 60 + url_id % 59 END AS seconds FROM u")
def duration_parse(spark, d):
    part = lambda n, unit, sign="": F.concat(F.lit(sign), (F.col("url_id") % n).cast("string"), F.lit(unit))
    text = F.concat(part(5, "y"), part(11, "m"), part(31, "d", "-"), part(24, "h"), part(60, "M"), part(59, "s"))
    text = F.when(F.col("url_id") % 7 == 0, F.col("url_id").cast("string")).when(F.col("url_id") % 7 == 1, F.concat(text, F.lit("x"))).otherwise(text)
    return urls(spark, d).select("url_id", D.duration(text).alias("seconds"))


@query("dmy_parse", "SELECT event_id, epoch(date_trunc('day', ts))::BIGINT AS seconds FROM events")
def dmy_parse(spark, d):
    return read(spark, d, "events").select("event_id", D.day_first(F.date_format("ts", "dd/MM/yyyy")).alias("seconds"))


_HOURS = f"""h AS (SELECT url_id, CASE WHEN seconds IS NULL THEN 0 WHEN least(seconds, {_NOW_S} + 86400) <= o + 3600 THEN 1 ELSE least((least(seconds, {_NOW_S} + 86400) - o) // 3600, 65535) END AS hour
FROM mod, (SELECT (max(seconds) // 3600 + 1) * 3600 - 65535 * 3600 AS o FROM mod))"""


def hours(spark, d):
    rows = urls(spark, d).select("url_id", D.http_date("last_modified").alias("seconds"))
    newest = rows.agg(F.max("seconds")).first()[0] or 0
    return rows.select("url_id", D.last_change_hour(F.col("seconds"), D.hour_origin(newest), _NOW_S).alias("hour"))


@query("lastmod_hours", f"{_W}, {_MOD}, {_HOURS} SELECT * FROM h")
def lastmod_hours(spark, d):
    return hours(spark, d)


@query("time_filter_range", f"{_W}, {_MOD}, {_HOURS} SELECT url_id FROM h WHERE hour <> 0 AND hour BETWEEN 60000 AND 63000")
def time_filter_range(spark, d):
    from siftmesh.search import Parameters, Side, filtered

    h = hours(spark, d)
    return filtered(h.select("url_id"), Parameters(since=60000, until=63000), Side(lastmod=h))


@query("topk_date", f"{_W}, {_MOD}, {_HOURS} SELECT url_id, hour AS weight FROM h JOIN page USING (url_id) ORDER BY weight DESC, url_id LIMIT 30")
def topk_date(spark, d):
    from siftmesh.operators import results as R

    hits = P.pages(spark, d, "docsize").select("url_id", F.lit(0).cast("long").alias("site_id"), F.lit(0).alias("wp"))
    return R.top(R.weighted(hits, lastmod=hours(spark, d), sort=R.DATE), 30).select("url_id", "weight")


@query("bandwidth_schedule", "SELECT event_id, CASE WHEN s >= 79200 OR s <= 21600 THEN 500 WHEN s BETWEEN 28800 AND 64800 THEN 50 ELSE 100 END AS rate FROM (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::INT AS s FROM events)")
def bandwidth_schedule(spark, d):
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return read(spark, d, "events").select("event_id", D.schedule_value(s, [(28800, 64800, 50), (79200, 21600, 500)], 100).alias("rate"))


# Links

def links(spark, d):
    return P.pages(spark, d, "hrefs").select(F.col("url_id").alias("from_id"), F.explode("hrefs").alias("to_id")).where(F.col("to_id").isNotNull()).distinct()


def redirects(spark, d, scratch):
    tied = urls(spark, d).where(F.col("redir").isNotNull() & (F.col("redir") != 0)).select(F.col("url_id").alias("from_id"), F.col("redir").alias("to_id"))
    return L.resolved_redirects(tied, scratch)


_REDIR = """red AS (SELECT url_id AS f, redir AS t FROM u WHERE redir <> 0),
chase AS (SELECT f, t, [f] AS seen FROM red UNION ALL SELECT chase.f, red.t, list_append(seen, red.f) FROM chase JOIN red ON red.f = chase.t WHERE NOT list_contains(seen, chase.t)),
fin AS (SELECT f AS from_id, CASE WHEN list_contains(seen, t) THEN f ELSE t END AS to_id FROM chase WHERE list_contains(seen, t) OR t NOT IN (SELECT f FROM red))"""
_WR = "WITH RECURSIVE " + to_sql.URLS
_ED = f"{to_sql.LINKS}, {_REDIR}, e AS (SELECT DISTINCT from_id, to_id FROM (SELECT links.from_id, coalesce(fin.to_id, links.to_id) AS to_id FROM links LEFT JOIN fin ON fin.from_id = links.to_id) WHERE to_id IS NOT NULL AND from_id <> to_id)"


def edges(spark, d, scratch):
    return scratch.write(L.distinct_links(links(spark, d), redirects(spark, d, scratch)), "links")


@query("redirect_resolve", f"{_WR}, {_REDIR} SELECT * FROM fin")
def redirect_resolve(spark, d):
    return redirects(spark, d, Scratch(spark, "redirects"))


@query("redirect_limited", f"{_WR}, {_REDIR.replace('[f] AS seen', '[f] AS seen').replace('CASE WHEN list_contains(seen, t) THEN f ELSE t END AS to_id FROM chase', 't AS to_id, len(seen) AS n FROM chase').replace('list_contains(seen, t) OR t NOT IN', 't NOT IN')} SELECT from_id, to_id, n FROM fin WHERE n <= 2")
def redirect_limited(spark, d):
    s = Scratch(spark, "redirects")
    rows = urls(spark, d).where((F.col("redir") != 0) & F.col("redir").isNotNull()).select(F.col("url_id").alias("from_id"), F.col("redir").alias("to_id"))
    return L.limited_redirects(rows, s, 2)


@query("links_dedup", f"{_WR}, {_ED} SELECT * FROM e")
def links_dedup(spark, d):
    return edges(spark, d, Scratch(spark, "links"))


@query("in_out_degree", f"{_WR}, {_ED} SELECT url_id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT from_id AS url_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT to_id, 1, 0 FROM e) GROUP BY url_id")
def in_out_degree(spark, d):
    return L.degrees(edges(spark, d, Scratch(spark, "links")))


@query("cited_by", f"{_WR}, {_ED} SELECT to_id, site_id, count(*) AS n_sources FROM e JOIN u ON u.url_id = from_id GROUP BY ALL")
def cited_by(spark, d):
    return L.cited_by(edges(spark, d, Scratch(spark, "links")), sited(spark, d))


@query("citations", f"{_WR}, {_ED} SELECT to_id, site_id, from_id FROM e JOIN u ON u.url_id = from_id")
def citations(spark, d):
    return L.citations(edges(spark, d, Scratch(spark, "links")), sited(spark, d))


@query("link_admission", f"{_W}, {to_sql.LINKS} SELECT from_id, to_id FROM links JOIN u a ON a.url_id = from_id JOIN u b ON b.url_id = to_id WHERE from_id <> to_id AND a.hops + 1 <= 6 AND (a.site_id = b.site_id OR b.site_id IN (SELECT site_id FROM sites WHERE site_id % 2 = 0))")
def link_admission(spark, d):
    known = read(spark, d, "sites").where(F.col("site_id") % 2 == 0).select("site_id").distinct().withColumn("k", F.lit(True))
    u = sited(spark, d).join(known, "site_id", "left").withColumn("known_site", F.coalesce("k", F.lit(False)))
    return C.admitted_links(links(spark, d), u, 6)


def _full_sql(rounds: int) -> str:
    out = [f"{_WR}, {_ED}, o AS (SELECT from_id, count(*) AS n FROM e GROUP BY from_id), r0 AS (SELECT url_id, 1.0::DOUBLE AS rank FROM (SELECT from_id AS url_id FROM e UNION SELECT to_id FROM e))"]
    for i in range(1, rounds + 1):
        out.append(f"g{i} AS (SELECT to_id AS url_id, 0.85 * sum(rank / n) + 0.15 AS rank FROM e JOIN o USING (from_id) JOIN r{i - 1} ON r{i - 1}.url_id = from_id GROUP BY to_id), "
                   f"r{i} AS MATERIALIZED (SELECT r{i - 1}.url_id, coalesce(g{i}.rank, r{i - 1}.rank) AS rank FROM r{i - 1} LEFT JOIN g{i} USING (url_id))")
    return ", ".join(out)


def _incremental_sql(rounds: int) -> str:
    out = [f"{_WR}, {_ED}, o AS (SELECT from_id, count(*) AS n FROM e GROUP BY from_id), r0 AS (SELECT url_id, (1 + url_id % 3)::DOUBLE AS rank, (1 + url_id % 3)::DOUBLE AS prior FROM u)"]
    for i in range(1, rounds + 1):
        out.append(f"g{i} AS (SELECT to_id AS url_id, sum((rank + prior) / 2 / n) AS s FROM e JOIN o USING (from_id) JOIN r{i - 1} ON r{i - 1}.url_id = from_id GROUP BY to_id), "
                   f"r{i} AS MATERIALIZED (SELECT r{i - 1}.url_id, 0.85 * coalesce(s, 0) + 0.15 AS rank, r{i - 1}.rank AS prior FROM r{i - 1} LEFT JOIN g{i} USING (url_id))")
    return ", ".join(out)


@query("pagerank_full", f"{_full_sql(10)} SELECT url_id, round(rank, 9) AS rank FROM r10")
def pagerank_full(spark, d):
    s = Scratch(spark, "rank")
    return L.link_rank(edges(spark, d, s), s).select("url_id", F.round("rank", 9).alias("rank"))


@query("rank_top", f"{_full_sql(10)} SELECT url_id, round(rank, 9) AS rank FROM r10 ORDER BY rank DESC, url_id LIMIT 25")
def rank_top(spark, d):
    s = Scratch(spark, "rank")
    return L.link_rank(edges(spark, d, s), s).select("url_id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "url_id").limit(25)


@query("rank_lowest", f"{_full_sql(10)} SELECT url_id, round(rank, 9) AS rank FROM r10 ORDER BY round(rank, 9), url_id LIMIT 25")
def rank_lowest(spark, d):
    s = Scratch(spark, "rank")
    return L.link_rank(edges(spark, d, s), s).select("url_id", F.round("rank", 9).alias("rank")).orderBy("rank", "url_id").limit(25)


@query("pagerank_incremental", f"{_incremental_sql(10)} SELECT url_id, round(rank, 9) AS rank FROM r10")
def pagerank_incremental(spark, d):
    s = Scratch(spark, "rank")
    ids = urls(spark, d).select("url_id")
    saved = ids.withColumn("rank", (1 + F.col("url_id") % 3).cast("double"))
    return L.link_rank_incremental(edges(spark, d, s), ids, s, saved=saved).select("url_id", F.round("rank", 9).alias("rank"))


# Countries

def _addresses(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 16001 % 25_000_000).cast("long").alias("ip"))


def _ranges(spark, d):
    start = (F.col("n_nationkey") * 1_000_000).cast("long")
    return read(spark, d, "nation").select(start.alias("start"), (start + 999_999).alias("end"), F.col("n_name").alias("country"))


_IP = "SELECT c_custkey AS id, (c_custkey * 16001 % 25000000)::BIGINT AS ip, n_name AS country FROM customer LEFT JOIN nation ON c_custkey * 16001 % 25000000 BETWEEN n_nationkey * 1000000 AND n_nationkey * 1000000 + 999999"


@query("geo_lookup", _IP)
def geo_lookup(spark, d):
    return G.lookup(_addresses(spark, d), _ranges(spark, d))


@query("geo_filter", f"SELECT id FROM ({_IP}) WHERE country IN ('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7')")
def geo_filter(spark, d):
    return G.lookup(_addresses(spark, d), _ranges(spark, d)).where(F.col("country").isin("FRANCE", "GERMANY", "NATION_3", "NATION_7")).select("id")


_BLOCKS = """WITH RECURSIVE a AS (SELECT (n_nationkey * 1000000)::BIGINT AS s, (n_nationkey * 1000000 + 999999)::BIGINT AS e, n_name AS country FROM nation),
b AS (SELECT country, s, e, least(CASE WHEN s = 0 THEN 4294967296 ELSE s & -s END, 2 ** floor(log2(e - s + 1)))::BIGINT AS size FROM a
UNION ALL SELECT country, s + size, e, least((s + size) & -(s + size), 2 ** floor(log2(e - s - size + 1)))::BIGINT FROM b WHERE s + size <= e)
SELECT s AS network, (32 - log2(size))::BIGINT AS bits, country FROM b"""


@query("geo_blocks", _BLOCKS)
def geo_blocks(spark, d):
    return G.blocks(_ranges(spark, d))


# Change logs

_BASE = r"""t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}0-9]+') AS w FROM documents)),
base AS (SELECT doc_id, word, string_agg(p, ',' ORDER BY p) AS positions FROM t GROUP BY ALL)"""


def _base(spark, d):
    return P.text_tokens(spark, d).groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _delta(base):
    moved = base.where(F.col("doc_id") % 5 == 0).select(F.lit(1).cast("long").alias("seq"), "doc_id", "word", F.transform("positions", lambda p: p + 100).alias("positions"))
    gone = base.where(F.col("doc_id") % 11 == 0).select(F.lit(2).cast("long").alias("seq"), "doc_id", "word", F.array().cast("array<long>").alias("positions"))
    new = base.where(F.col("doc_id") % 7 == 0).select(F.lit(3).cast("long").alias("seq"), "doc_id", F.concat(F.lit("new"), "word").alias("word"), "positions")
    return moved.unionByName(gone).unionByName(new)


_MERGED = f"""WITH {_BASE}, kept AS (SELECT doc_id, word, CASE WHEN doc_id % 5 = 0 THEN (SELECT string_agg(p + 100, ',' ORDER BY p) FROM t WHERE t.doc_id = base.doc_id AND t.word = base.word) ELSE positions END AS positions FROM base WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id, 'new' || word, positions FROM base WHERE doc_id % 7 = 0)"""


def _text(rows):
    return rows.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("delta_merge", f"{_MERGED} SELECT * FROM kept")
def delta_merge(spark, d):
    base = Scratch(spark, "merge").write(_base(spark, d), "index")
    return _text(S.merge(base, _delta(base), ["doc_id", "word"], "positions"))


@query("delta_tombstone", f"WITH {_BASE} SELECT doc_id, count(*) AS n_words FROM base WHERE doc_id % 11 <> 0 GROUP BY doc_id")
def delta_tombstone(spark, d):
    base = Scratch(spark, "merge").write(_base(spark, d), "index")
    return S.merge(base, _delta(base).where(F.col("seq") == 2), ["doc_id", "word"], "positions").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


@query("stream_delta_merge", f"{_MERGED} SELECT * FROM kept")
def stream_delta_merge(spark, d):
    s = Scratch(spark, "stream")
    base = s.write(_base(spark, d), "base")
    delta = s.write(_delta(base).repartition(4, "doc_id", "word"), "delta")
    return _text(S.stream_merge(spark, delta._siftmesh_path, "seq long, doc_id long, word string, positions array<long>", base, ["doc_id", "word"], "positions", s))


@query("recent_store", f"{_MERGED} SELECT * FROM kept")
def recent_store(spark, d):
    """The same changes as new versions of whole documents: some are folded in, the last ones are read beside the index."""
    s = Scratch(spark, "recent")
    base = s.write(_base(spark, d), "base")
    after = s.write(S.merge(base, _delta(base), ["doc_id", "word"], "positions"), "after")
    changed = F.col("doc_id").isNotNull() & ((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 0))
    gone = base.where(F.col("doc_id") % 11 == 0).select("doc_id", F.lit("").alias("word"), F.array().cast("array<long>").alias("positions")).distinct()
    store = S.RecentStore(S.FoldedIndex(base, ["doc_id", "word"], "positions", s), "doc_id", most=10**9)
    store.put(after.where(changed).select(F.lit(1).cast("long").alias("seq"), "*"))
    store.fold()
    left = after.where(F.col("doc_id") % 11 == 0).select("doc_id").distinct()
    store.put(gone.join(left, "doc_id", "left_anti").select(F.lit(2).cast("long").alias("seq"), "*").unionByName(after.where(F.col("doc_id") % 11 == 0).select(F.lit(2).cast("long").alias("seq"), "*")))
    return _text(store.rows())


_SLIDE = "WITH w AS (SELECT value, time_bucket(INTERVAL '2 minutes', ts) - i * INTERVAL '2 minutes' AS starts FROM events, range(5) r(i)) SELECT starts, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY starts"


@query("bandwidth_sliding", _SLIDE)
def bandwidth_sliding(spark, d):
    return S.sliding_sums(read(spark, d, "events"), "ts", "value", "10 minutes", "2 minutes")


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS starts, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return S.tumbling(read(spark, d, "events"), "ts", "event_type", "1 hour")


@query("events_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), "
       "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS starts, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, d):
    return S.sessions(read(spark, d, "events"), "ts", "user_id", "30 minutes")


@query("status_rollup", f"{_W} SELECT status, tag, count(*) AS n FROM u GROUP BY ROLLUP (status, tag)")
def status_rollup(spark, d):
    return urls(spark, d).rollup("status", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("approx_vocab")
def approx_vocab(spark, d):
    return P.text_tokens(spark, d).agg(F.approx_count_distinct("word", 0.02).alias("n_words"))
