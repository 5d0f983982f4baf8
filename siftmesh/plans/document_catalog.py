"""Queries on HTML, languages, word forms and excerpts with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmesh.functions import forms as W
from siftmesh.functions import html as H
from siftmesh.functions import urls as U
from siftmesh.operators import excerpts as X
from siftmesh.operators import postings as P
from siftmesh.operators import results as R
from siftmesh.plans import search_catalog, to_sql
from siftmesh.plans.compile import evaluate
from siftmesh.plans.query_language import parse
from siftmesh.session import Scratch
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


def html_pages(spark, d):
    """Pages of the crawl as HTML: their fields with escapes, a script, a comment that isn't indexed, and their links."""
    rows = P.located(spark, d)
    e = lambda c: U.html_escaped(F.coalesce(c, F.lit("")))
    links = F.array_join(F.transform(F.coalesce("hrefs", F.array().cast("array<long>")), lambda h: F.concat(F.lit("<a href='/p/../u/"), h.cast("string"), F.lit("#x'>-</a>"))), "")
    robots = F.when(F.col("url_id") % 13 == 0, "<META NAME=robots CONTENT='NOINDEX,follow'>").when(F.col("url_id") % 17 == 0, '<meta name="robots" content="nofollow">').otherwise("")
    page = F.concat(
        F.lit("<html><head><TITLE>"), e("title"), F.lit("</TITLE>"), robots, F.lit('<meta name=keywords content="'), e("keywords"), F.lit('"><meta name="description" content="'), e("description"),
        F.lit('"><script>if (a<b) { x("</b>") }</script></head><body bgcolor=white><!--noindex--> menu <!--/noindex-->'), e("txt"), links, F.lit("<style>p {}</style></body></html>"))
    return rows.select("url_id", F.col("url"), page.alias("html"))


def _clean(c: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({c}, ''), '''', '`'), '\\s+', ' ', 'g'))"


@query("html_title", f"{_W} SELECT url_id, CASE WHEN url_id % 13 = 0 THEN '' ELSE {_clean('title')} END AS title FROM doc")
def html_title(spark, d):
    return H.parsed(html_pages(spark, d)).select("url_id", "title")


@query("html_text", f"{_W} SELECT url_id, CASE WHEN url_id % 13 = 0 THEN '' ELSE trim({_clean('txt')} || repeat(' -', coalesce(len(hrefs), 0)::INT)) END AS body FROM doc")
def html_text(spark, d):
    return H.parsed(html_pages(spark, d)).select("url_id", "body")


@query("meta_robots", f"{_W} SELECT url_id, url_id % 13 <> 0 AS indexed, url_id % 13 = 0 OR url_id % 17 <> 0 AS followed FROM doc")
def meta_robots(spark, d):
    return H.parsed(html_pages(spark, d)).select("url_id", F.col("index").alias("indexed"), F.col("follow").alias("followed"))


@query("link_extract", f"{_W}, l AS (SELECT DISTINCT url_id, unnest(hrefs) AS h FROM doc WHERE url_id % 13 = 0 OR url_id % 17 <> 0) SELECT url_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || '/u/' || h AS link FROM l JOIN doc USING (url_id) WHERE h IS NOT NULL AND url IS NOT NULL")
def link_extract(spark, d):
    return H.parsed(html_pages(spark, d)).select("url_id", F.explode("links").alias("link"))


@query("entity_decode", f"{_W} SELECT url_id, coalesce(title, '') || ' ' || chr(169) || ' ' || chr(223) || ' A &unknown; <' AS text FROM doc")
def entity_decode(spark, d):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(s):
        return s.map(H.entities)

    return P.located(spark, d, "title", url_columns=()).select("url_id", decode(F.concat(U.html_escaped(F.coalesce("title", F.lit(""))), F.lit(" &copy; &szlig &#65; &unknown; &lt"))).alias("text"))


_LANG = "CASE WHEN lower(lang) IN ('en', 'eng') THEN 'en' WHEN lower(lang) IN ('de', 'deu', 'ger') THEN 'de' WHEN lower(lang) IN ('fr', 'fra') THEN 'fr' WHEN lower(lang) IN ('es', 'spa') THEN 'es' END"
_GRAMS = r"""w AS (SELECT doc_id, LANG AS lang, unnest(regexp_extract_all(lower(text), '[\p{L}0-9]+')) AS word FROM documents),
g AS (SELECT doc_id, lang, substr(word, i::INT, 3) AS gram FROM (SELECT *, unnest(range(1, length(word) - 1)) AS i FROM w WHERE length(word) >= 3)),
profile AS (SELECT lang, gram FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rn FROM g WHERE lang IS NOT NULL GROUP BY lang, gram) WHERE rn <= 100),
hits AS (SELECT doc_id, p.lang, count(*) AS hits FROM (SELECT doc_id, gram FROM g) x JOIN profile p USING (gram) GROUP BY ALL)""".replace("LANG", _LANG)


@query("lang_by_ngrams", f"WITH {_GRAMS} SELECT DISTINCT ON (doc_id) doc_id, lang, hits FROM hits ORDER BY doc_id, hits DESC, lang")
def lang_by_ngrams(spark, d):
    from pyspark.sql import Window

    from siftmesh.functions.text import ngrams

    low = F.lower("lang")
    lang = F.when(low.isin("en", "eng"), "en").when(low.isin("de", "deu", "ger"), "de").when(low.isin("fr", "fra"), "fr").when(low.isin("es", "spa"), "es")
    grams = read(spark, d, "documents").select("doc_id", lang.alias("lang"), F.explode(ngrams("text", 3)).alias("gram"))
    per_doc = grams.groupBy("doc_id", "lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profile = per_doc.where(F.col("lang").isNotNull()).groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rn", place).where(F.col("rn") <= 100)
    # A profile has 100 grams a language, so it can be broadcast.
    hits = per_doc.select("doc_id", "gram", "n").join(F.broadcast(profile.select("lang", "gram")), "gram").groupBy("doc_id", "lang").agg(F.sum("n").alias("hits"))
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.col("hits")).alias("h"), "lang")).alias("b"))
    return best.select("doc_id", F.col("b.lang").alias("lang"), (-F.col("b.h")).alias("hits"))


_SUFFIXES = [W.Suffix("S", "[^sxzhy]", "", "s"), W.Suffix("S", "[sxzh]", "", "es"), W.Suffix("S", "y", "y", "ies"), W.Suffix("D", "e", "", "d"), W.Suffix("D", "[^ey]", "", "ed")]


@query("word_forms", r"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\p{L}0-9]+')) AS word FROM urlwords),
f AS (SELECT word AS root, word AS form FROM d UNION SELECT word, CASE WHEN word LIKE '%y' THEN left(word, length(word) - 1) || 'ies' WHEN regexp_matches(word, '[sxzh]$') THEN word || 'es' ELSE word || 's' END FROM d
UNION SELECT word, CASE WHEN word LIKE '%e' THEN word || 'd' ELSE word || 'ed' END FROM d WHERE word NOT LIKE '%y') SELECT * FROM f""")
def word_forms(spark, d):
    from siftmesh.functions.text import words

    roots = read(spark, d, "urlwords").select(F.explode(words("title")).alias("word")).distinct().withColumn("flags", F.lit("SD"))
    return W.expand(roots, _SUFFIXES)


def _shown(spark, d):
    tree = parse("garden OR library OR describes", search_catalog.VOCABULARY).tree
    rows = R.top(R.weighted(evaluate(tree, search_catalog.store(spark, d))), 40).select("url_id")
    return X.shown(rows.join(P.pages(spark, d), "url_id"), tree, {"title_shown": "title", "description_shown": "description"})


@query("excerpts")
def excerpts(spark, d):
    return _shown(spark, d).select("url_id", "excerpts")


_MARK = r"regexp_replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)\b(gardens?|library|describes|described|describe)\b', '<B>\1</B>', 'g')"


@query("highlight", to_sql.query_sql(parse("garden OR library OR describes", search_catalog.VOCABULARY).tree,
       f"SELECT url_id, {_MARK.format('title')} AS title_shown, {_MARK.format('description')} AS description_shown FROM (SELECT url_id, CASE WHEN wp & 24576 <> 0 THEN wp * 65536 ELSE (wp & 63488) * 65536 END AS weight FROM (SELECT url_id, wp::BIGINT AS wp FROM hits)) JOIN page USING (url_id) ORDER BY weight DESC, url_id LIMIT 40", search_catalog.STOP))
def highlight(spark, d):
    return _shown(spark, d).select("url_id", "title_shown", "description_shown")


@query("stored_fields", f"{_W} SELECT url_id, left(repeat(coalesce(title, '') || '.', 3), 128) AS title, left(repeat(coalesce(txt, '') || '.', 3), 255) AS txt, left(repeat(coalesce(keywords, '') || '.', 3), 255) AS keywords, left(repeat(coalesce(description, '') || '.', 3), 100) AS description FROM doc")
def stored_fields(spark, d):
    """Fields of any length as an index keeps them."""
    rows = P.located(spark, d, "title", "txt", "keywords", "description")
    longer = [F.repeat(F.concat(F.coalesce(c, F.lit("")), F.lit(".")), F.lit(3)).alias(c) for c in ("title", "txt", "keywords", "description")]
    return H.stored(rows.select("url_id", *longer))


@query("colored_copy", f"{_W} SELECT url_id, '<p title=garden>' || regexp_replace(title, '(?i)(\\bgarden\\b)', '<span style=\"background:#ffff66\">\\1</span>', 'g') || '</p>' AS page FROM doc WHERE regexp_matches(title, '(?i)\\bgarden\\b')")
def colored_copy(spark, d):
    from siftmesh.functions.cgi import copy

    rows = P.located(spark, d, "title").where(F.col("title").rlike(r"(?i)\bgarden\b"))
    return copy(rows.select("url_id", F.concat(F.lit("<p title=garden>"), "title", F.lit("</p>")).alias("page")), parse("garden").tree)


@query("document_fetch", f"{_W} SELECT url_id, url, title, crc FROM doc")
def document_fetch(spark, d):
    return P.located(spark, d, "title").select("url_id", "url", "title", "crc")


@query("html_large", f"{_W} SELECT url_id, CASE WHEN url_id % 13 = 0 THEN '' ELSE {_clean('title')} END AS large FROM doc")
def html_large(spark, d):
    """Titles set as headings in front of the page's text."""
    page = F.concat(F.lit("<body>small <h2>"), U.html_escaped(F.coalesce("title", F.lit(""))), F.lit("</h2><font size=-1>tiny</font> text"), F.when(F.col("url_id") % 13 == 0, "<meta name=robots content=none>").otherwise(""))
    rows = P.located(spark, d, "title").select("url_id", "url", page.alias("html"))
    return H.parsed(rows).select("url_id", "large")


@query("cached_copy", f"{_W} SELECT url_id, url, coalesce(nullif(lower(trim(regexp_extract(content_type, '^([^;]*)', 1))), ''), 'unknown') AS kind, txt FROM (SELECT DISTINCT ON (url_id) url_id, content_type, txt FROM urlwords) JOIN u USING (url_id) WHERE deleted = 0")
def cached_copy(spark, d):
    from siftmesh.functions.http import content_type

    return P.located(spark, d, "content_type", "txt").select("url_id", "url", F.coalesce(content_type(F.col("content_type")), F.lit("unknown")).alias("kind"), "txt")


@query("stored_index", f"WITH {to_sql.postings()} SELECT word, url_id, pos FROM postings WHERE word IN ('describes', 'garden')")
def stored_index(spark, d):
    """Write the index, clustered by word, and read the postings of two words back."""
    path = Scratch(spark, "index").path("index")
    P.write_index(P.page_postings(spark, d), path, 8)
    return P.read_index(spark, path).where(F.col("word").isin("describes", "garden")).select("word", "url_id", F.col("pos").cast("long").alias("pos"))
