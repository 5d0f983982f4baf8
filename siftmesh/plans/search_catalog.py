"""Queries on text, search, ranking and results with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.functions import text as T
from siftmesh.operators import postings as P
from siftmesh.operators import results as R
from siftmesh.plans import to_sql
from siftmesh.plans.compile import Store, evaluate
from siftmesh.plans.query_language import Vocabulary, parse
from siftmesh.sources.tables import read, urls_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STOP = T.stopwords("en")
VOCABULARY = Vocabulary(stop=set(STOP), forms={"describes": ("describe", "described"), "garden": ("gardens",), "pictures": ("picture",)})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Text

_TOK = r"""tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w)))::BIGINT AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}0-9]+') AS w FROM documents))"""
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query("tokenize_docs", f"WITH {_TOK} SELECT * FROM tok")
def tokenize_docs(spark, d):
    return P.text_tokens(spark, d)


@query("word_totals", f"WITH {_TOK} SELECT word, count(DISTINCT doc_id) AS urlcount, count(*) AS totalcount FROM tok GROUP BY word")
def word_totals(spark, d):
    return P.totals(P.text_tokens(spark, d), "doc_id")


@query("doc_word_counts", f"WITH {_TOK} SELECT doc_id, count(DISTINCT word) AS wordcount, count(*) AS totalcount FROM tok GROUP BY doc_id")
def doc_word_counts(spark, d):
    return P.document_counts(P.text_tokens(spark, d), "doc_id")


@query("dictionary_top", f"WITH {_TOK} SELECT word, count(DISTINCT doc_id) AS urlcount, count(*) AS totalcount FROM tok GROUP BY word ORDER BY totalcount DESC, word LIMIT 50")
def dictionary_top(spark, d):
    return P.totals(P.text_tokens(spark, d), "doc_id").orderBy(F.desc("totalcount"), "word").limit(50)


@query("stopword_filter", f"WITH {_TOK} SELECT doc_id, count(*) AS kept, max(pos) AS last_pos FROM tok WHERE word NOT IN ({_STOP_SQL}) GROUP BY doc_id")
def stopword_filter(spark, d):
    return T.indexable(P.text_tokens(spark, d), STOP, longest=10**6).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("pos").alias("last_pos"))


@query("word_length_filter", f"WITH {_TOK} SELECT word, count(*) AS n FROM tok WHERE length(word) BETWEEN 3 AND 32 GROUP BY word")
def word_length_filter(spark, d):
    return T.indexable(P.text_tokens(spark, d), shortest=3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_LANGS = " UNION ALL ".join(f"SELECT '{lang}' AS lang, unnest(['" + "', '".join(ws.split()) + "']) AS word" for lang, ws in T.STOPWORDS.items())


@query("lang_by_stopwords", f"WITH {_TOK}, known AS ({_LANGS}), hits AS (SELECT doc_id, lang, count(*) AS hits FROM tok JOIN known USING (word) GROUP BY ALL) "
       "SELECT DISTINCT ON (doc_id) doc_id, lang, hits FROM hits ORDER BY doc_id, hits DESC, lang")
def lang_by_stopwords(spark, d):
    return T.languages(P.text_tokens(spark, d), "doc_id")


@query("ngram_profile", f"WITH {_TOK}, g AS (SELECT doc_id, substr(word, i::INT, 3) AS gram FROM (SELECT doc_id, word, unnest(range(1, length(word) - 1)) AS i FROM tok WHERE length(word) >= 3)) "
       "SELECT gram, count(DISTINCT doc_id) AS n_docs, count(*) AS total FROM g GROUP BY gram")
def ngram_profile(spark, d):
    return T.letter_ngrams(read(spark, d, "documents"), "doc_id", "text", 3)


@query("content_md5", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_md5(spark, d):
    return read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("digest"))


@query("query_crc32")
def query_crc32(spark, d):
    return P.pages(spark, d, "title").select("url_id", F.crc32(F.coalesce("title", F.lit(""))).alias("key"))


# Postings

@query("postings_build", f"WITH {to_sql.postings()} SELECT word, site_id, url_id, string_agg(pos, ',' ORDER BY pos) AS positions, count(*) AS cnt FROM postings GROUP BY ALL")
def postings_build(spark, d):
    return P.grouped(P.page_postings(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("section_postings", f"WITH {to_sql.postings()} SELECT section, word, count(*) AS n, count(DISTINCT url_id) AS n_urls FROM postings GROUP BY ALL")
def section_postings(spark, d):
    per = P.page_postings(spark, d).groupBy("section", "word", "url_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("section", "word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_urls"))


@query("word_info", f"WITH {to_sql.postings()} SELECT word, count(DISTINCT url_id) AS urlcount, count(*) AS totalcount FROM postings WHERE word IN ('describes', 'garden', 'pictures') GROUP BY word")
def word_info(spark, d):
    return R.word_statistics(P.served(spark, d).dictionary, ["describes", "garden", "pictures"])


# Query language

def store(spark: SparkSession, d: str) -> Store:
    """What searches read: the stored index, written once, and the tables beside it."""
    own = P.served(spark, d)
    return Store(None, read(spark, d, "sites"), own.links, own.urls, own.index, own.dictionary)


SEARCHES = {
    "q_word": "garden", "q_and": "describes along", "q_and_three": "describes along western", "q_or": "garden OR library", "q_not": "garden -library",
    "q_nested": "(garden OR library) (describes OR covers) -western", "q_phrase": '"with pictures of each"', "q_phrase_gap": '"pictures of each"',
    "q_phrase_or": '"all about the (garden | library)"', "q_pattern_star": "describe*", "q_pattern_qmark": "describ?s", "q_pattern_or": "remembe* OR garden",
    "q_pattern_middle": "descri*e?", "q_word_forms": "pictures garden", "q_stopword_in_and": "covers the library", "q_unknown_word": "garden zzzzunknown", "q_unknown_or": "garden OR zzzzunknown",
    "q_title_only": "title:garden", "q_body_only": "body:garden", "q_title_or_body": "title:body:garden", "q_keywords_and_title": "keywords:bright title:home", "q_desc_phrase": 'desc:"with pictures"',
    "q_site_suffix": "describes site:test", "q_site_label": "describes site:www", "q_site_exclude": "describes -site:test", "q_site_or": "describes (site:test | site:example)", "q_site_and": "describes site:www -site:invalid",
    "q_phrase_and_word": '"with pictures" garden', "q_runs_gap": "pictures of each library",
}


def _search(text: str):
    tree = parse(text, VOCABULARY).tree

    def run(spark, d):
        return evaluate(tree, store(spark, d)).select("url_id", "site_id", F.col("wp").cast("long").alias("wp"))

    return run, to_sql.query_sql(tree, "SELECT url_id, site_id, wp::BIGINT AS wp FROM hits", STOP)


for _name, _text in SEARCHES.items():
    QUERIES[_name], SQL[_name] = _search(_text)


# The same grammar in SQL written by hand, apart from the parser's trees: which documents a query of each rule finds.

_IN = "SELECT url_id FROM postings WHERE word = '{0}'"
_AT = "SELECT DISTINCT a.url_id FROM postings a JOIN postings b ON b.url_id = a.url_id AND b.section = a.section AND b.pos = a.pos + {2} AND b.word = '{1}' WHERE a.word = '{0}'"
_ON = "SELECT url_id FROM postings JOIN sites USING (site_id) WHERE '.' || lower(regexp_extract(site, '^[a-zA-Z]+://([^/:]+)', 1)) || '.' LIKE '%.{0}.%'"
BY_HAND = {
    "rule_word": ("garden", "SELECT DISTINCT url_id FROM postings WHERE word IN ('garden', 'gardens')"),
    "rule_and": ("describes western", f"{_IN.format('western')} INTERSECT SELECT url_id FROM postings WHERE word IN ('describes', 'describe', 'described')"),
    "rule_or_binds_looser": ("western library OR covers", f"({_IN.format('western')} INTERSECT {_IN.format('library')}) UNION {_IN.format('covers')}"),
    "rule_group": ("western (library | covers)", f"{_IN.format('western')} INTERSECT ({_IN.format('library')} UNION {_IN.format('covers')})"),
    "rule_not": ("covers -western", f"{_IN.format('covers')} EXCEPT {_IN.format('western')}"),
    "rule_hyphen": ("covers-western", f"{_IN.format('covers')} INTERSECT {_IN.format('western')}"),
    "rule_phrase": ('"with pictures of each"', _AT.format("pictures", "each", 2)),
    "rule_pattern": ("descri*", "SELECT DISTINCT url_id FROM postings WHERE word LIKE 'descri%'"),
    "rule_section": ("title:western", f"{_IN.format('western')} AND section = 3"),
    "rule_sections": ("desc:title:western", f"{_IN.format('western')} AND section IN (1, 3)"),
    "rule_section_of_group": ("title:(western | library)", "SELECT DISTINCT url_id FROM postings WHERE word IN ('western', 'library') AND section = 3"),
    "rule_site": ("covers site:test", f"{_IN.format('covers')} INTERSECT {_ON.format('test')}"),
    "rule_not_site": ("covers -site:test", f"{_IN.format('covers')} EXCEPT {_ON.format('test')}"),
    "rule_stopword": ("the covers of", f"SELECT DISTINCT url_id FROM ({_IN.format('covers')})"),
}


def _found(text: str):
    tree = parse(text, VOCABULARY).tree

    def run(spark, d):
        return evaluate(tree, store(spark, d)).select("url_id")

    return run


for _name, (_text, _sql) in BY_HAND.items():
    QUERIES[_name], SQL[_name] = _found(_text), f"WITH {to_sql.postings(STOP)} SELECT DISTINCT url_id FROM ({_sql})"


_MOST_LINKED = "SELECT to_id, count(*) AS n FROM links JOIN u ON u.url_id = to_id GROUP BY to_id ORDER BY n DESC, to_id LIMIT 1"


@query("q_link_to", "WITH " + to_sql.URLS + ", " + to_sql.LINKS + f", t AS ({_MOST_LINKED}) SELECT DISTINCT from_id AS url_id, u.site_id, 0::BIGINT AS wp FROM links JOIN t USING (to_id) JOIN u ON u.url_id = from_id")
def q_link_to(spark, d):
    s = store(spark, d)
    counts = s.links.groupBy("to_id").agg(F.count(F.lit(1)).alias("n")).join(s.urls.select(F.col("url_id").alias("to_id"), "url"), "to_id")
    row = counts.orderBy(F.desc("n"), "to_id").first()
    return evaluate(parse(f"link: {row['url'] if row else 'none'}").tree, s).select("url_id", "site_id", F.col("wp").cast("long").alias("wp"))


# Ranking and results

_RANK = "rank AS (SELECT to_id AS url_id, count(*)::DOUBLE / 4 AS rank FROM links GROUP BY to_id)"
_QUANT = "CASE WHEN rank IS NULL OR rank <= 0 THEN 0 ELSE floor(ln(rank * 10) * 2000)::BIGINT & 65535 END"
_WEIGHT = f"""{_RANK},
q AS (SELECT hits.url_id, site_id, wp::BIGINT AS wp, {_QUANT} AS q FROM hits LEFT JOIN rank USING (url_id)),
w AS (SELECT url_id, site_id, CASE WHEN wp & 24576 <> 0 THEN wp * 65536 + q ELSE ((wp & 63488) * 65536 + q * 2048) & 4294967295 END AS weight, wp * 65536 + q AS within FROM q),
sw AS (SELECT site_id, (site_id % 5 = 0)::BIGINT * 3 AS site_weight FROM sites GROUP BY site_id),
r AS (SELECT w.*, coalesce(site_weight, 0) AS site_weight FROM w LEFT JOIN sw USING (site_id))"""
_RANKED = parse("garden OR describes OR library OR covers", VOCABULARY).tree


def ranks(s: Store) -> DataFrame:
    return s.links.groupBy(F.col("to_id").alias("url_id")).agg((F.count(F.lit(1)) / 4).alias("rank"))


def ranked(spark, d) -> DataFrame:
    s = store(spark, d)
    weights = s.sites.select("site_id").distinct().withColumn("weight", F.when(F.col("site_id") % 5 == 0, 3).otherwise(0).cast("long"))
    return R.weighted(evaluate(_RANKED, s), ranks(s), weights)


def _ranked_sql(select: str) -> str:
    return to_sql.query_sql(_RANKED, select, STOP, _WEIGHT)


@query("rank_quantize", "WITH " + to_sql.URLS + ", " + to_sql.LINKS + f", {_RANK} SELECT url_id, {_QUANT} AS q FROM rank")
def rank_quantize(spark, d):
    return ranks(store(spark, d)).select("url_id", R.quantized_rank(F.col("rank")).alias("q"))


@query("weight_final", _ranked_sql("SELECT url_id, site_id, weight FROM r"))
def weight_final(spark, d):
    return ranked(spark, d).select("url_id", "site_id", "weight")


@query("rating_shown", _ranked_sql("SELECT url_id, printf('%7.5f', weight / 4294967296.0::DOUBLE) AS rating FROM r"))
def rating_shown(spark, d):
    return ranked(spark, d).select("url_id", R.rating(F.col("weight")).alias("rating"))


@query("site_weight_order", _ranked_sql("SELECT url_id, site_weight, weight FROM r ORDER BY site_weight DESC, weight DESC, url_id LIMIT 200"))
def site_weight_order(spark, d):
    return R.top(ranked(spark, d), 200).select("url_id", "site_weight", "weight")


@query("topk_rate", _ranked_sql("SELECT url_id, site_id, weight FROM r ORDER BY site_weight DESC, weight DESC, url_id LIMIT 20"))
def topk_rate(spark, d):
    return R.top(ranked(spark, d), 20).select("url_id", "site_id", "weight")


_BEST = """f AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY within DESC, url_id) AS rn, count(*) OVER (PARTITION BY site_id) AS n_urls FROM r),
g AS (SELECT a.site_id, a.url_id, a.weight, b.url_id AS second_url, b.weight AS second_weight, a.n_urls, a.site_weight FROM f a LEFT JOIN f b ON b.site_id = a.site_id AND b.rn = 2 WHERE a.rn = 1)"""


@query("group_by_site", to_sql.query_sql(_RANKED, "SELECT * FROM g", STOP, _WEIGHT + ",\n" + _BEST))
def group_by_site(spark, d):
    return R.by_site(ranked(spark, d))


@query("page_slice", to_sql.query_sql(_RANKED, "SELECT site_id, url_id, place FROM (SELECT *, row_number() OVER (ORDER BY site_weight DESC, weight DESC, url_id) AS place FROM g) WHERE place BETWEEN 21 AND 40", STOP, _WEIGHT + ",\n" + _BEST))
def page_slice(spark, d):
    return R.page(R.by_site(ranked(spark, d)), 1, 20).select("site_id", "url_id", "place")


@query("result_totals", _ranked_sql("SELECT count(DISTINCT site_id) AS n_sites, count(*) AS n_urls, ceil(count(DISTINCT site_id) / 20)::BIGINT AS n_pages FROM r"))
def result_totals(spark, d):
    return R.result_totals(ranked(spark, d))


@query("more_from_site", _ranked_sql("SELECT url_id, weight FROM r WHERE site_id = (SELECT site_id FROM r GROUP BY site_id ORDER BY count(*) DESC, site_id LIMIT 1)"))
def more_from_site(spark, d):
    rows = ranked(spark, d)
    most = rows.groupBy("site_id").count().orderBy(F.desc("count"), "site_id").first()
    return rows.where(F.col("site_id") == (most["site_id"] if most else 0)).select("url_id", "weight")


@query("q_single_site", _ranked_sql("SELECT url_id, weight FROM r WHERE site_id = (SELECT min(site_id) FROM r)"))
def q_single_site(spark, d):
    from siftmesh.search import Parameters, Side, filtered

    rows = ranked(spark, d)
    return filtered(rows, Parameters(site=rows.agg(F.min("site_id")).first()[0] or 0), Side()).select("url_id", "weight")


@query("q_space", _ranked_sql("SELECT url_id, weight FROM r WHERE site_id IN (SELECT site_id FROM sites WHERE site_id % 4 IN (1, 3))"))
def q_space(spark, d):
    from siftmesh.search import Parameters, Side, filtered

    spaces = read(spark, d, "sites").select((F.col("site_id") % 4).cast("int").alias("space_id"), "site_id").distinct()
    return filtered(ranked(spark, d), Parameters(spaces=(1, 3)), Side(spaces=spaces)).select("url_id", "weight")


@query("q_site_like", _ranked_sql("SELECT url_id, weight FROM r WHERE site_id IN (SELECT site_id FROM sites WHERE site LIKE 'https://www.%' OR site LIKE 'http://%.test/%')"))
def q_site_like(spark, d):
    from siftmesh.search import Parameters, Side, filtered

    return filtered(ranked(spark, d), Parameters(site_masks=("https://www.%", "http://%.test/%")), Side(sites=read(spark, d, "sites"))).select("url_id", "weight")


@query("q_subset", _ranked_sql("SELECT url_id, weight FROM r WHERE url_id IN (SELECT url_id FROM u WHERE url LIKE 'https://www.%' OR url LIKE '%/garden/%')"))
def q_subset(spark, d):
    """Hits in a subset named by its mask or in one named by its number."""
    from siftmesh.operators.storage import subset_urls
    from siftmesh.search import Parameters, Side, filtered

    subsets = spark.createDataFrame([(1, "https://www.%"), (2, "%/garden/%"), (3, "http://%")], "subset_id int, mask string")
    urls = subset_urls(urls_once(read(spark, d, "urlword"), "url"), subsets)
    return filtered(ranked(spark, d), Parameters(subsets=("https://www.%", "site/#2", "unknown%")), Side(subsets=subsets, subset_urls=urls)).select("url_id", "weight")


@query("q_time", _ranked_sql("SELECT url_id, weight FROM r WHERE url_id % 1000 BETWEEN 100 AND 600"))
def q_time(spark, d):
    """Hits whose hour of change lies in a window."""
    from siftmesh.search import Parameters, Side, filtered

    hours = urls_once(read(spark, d, "urlword"), "url").select("url_id", (F.col("url_id") % 1000).alias("hour"))
    return filtered(ranked(spark, d), Parameters(since=100, until=600), Side(lastmod=hours)).select("url_id", "weight")


_OFF = parse("describes garden OR library", VOCABULARY).tree


@query("q_without_distance", to_sql.query_sql(_OFF, "SELECT url_id, site_id, wp::BIGINT AS wp FROM hits", STOP, distance=False))
def q_without_distance(spark, d):
    return evaluate(_OFF, store(spark, d), distance=False).select("url_id", "site_id", F.col("wp").cast("long").alias("wp"))


@query("form_search", _ranked_sql("SELECT url_id, weight FROM r WHERE site_id IN (SELECT site_id FROM sites WHERE site LIKE 'http://%') ORDER BY weight DESC, url_id LIMIT 100").replace("/ 4 AS rank", "* 0 AS rank"))
def form_search(spark, d):
    """A form's parameters as they come over the wire: the first page of 100 hits, ungrouped, on sites that a mask names."""
    from siftmesh.functions.cgi import answer
    from siftmesh.search import Side

    found = answer("iq=garden+OR+describes+OR+library+OR+covers&ps=100&gr=off&ul=http://%25&fm=en", store(spark, d), Side(sites=read(spark, d, "sites")), 0, 0, set(STOP), {"en": VOCABULARY.forms})
    return found.rows.select("url_id", "weight")


def _plain_sql(select: str, more: str = "") -> str:
    """Without ranks and site weights, as a search without tables beside the index."""
    sql = to_sql.query_sql(_RANKED, select, STOP, _WEIGHT + (",\n" + more if more else ""))
    return sql.replace("/ 4 AS rank", "* 0 AS rank").replace("(site_id % 5 = 0)::BIGINT * 3", "0::BIGINT")


_ASKED = "garden OR describes OR library OR covers"


@query("search_page", _plain_sql("SELECT site_id, url_id, place FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, url_id) AS place FROM g) WHERE place BETWEEN 11 AND 20", _BEST))
def search_page(spark, d):
    """The second page of ten sites through the public interface."""
    from siftmesh.search import Parameters, search

    return search(store(spark, d), _ASKED, Parameters(number=1, size=10), VOCABULARY).rows.select("site_id", "url_id", "place")


@query("search_first", _plain_sql("SELECT site_id, url_id, weight FROM g ORDER BY weight DESC, url_id LIMIT 1", _BEST))
def search_first(spark, d):
    from siftmesh.search import Parameters, search

    return search(store(spark, d), _ASKED, Parameters(first_only=True), VOCABULARY).rows.select("site_id", "url_id", "weight")


@query("search_one_site", _plain_sql("SELECT url_id, weight FROM r WHERE site_id = (SELECT min(site_id) FROM r) ORDER BY weight DESC, url_id LIMIT 100"))
def search_one_site(spark, d):
    """Where one site has all hits, its documents are listed instead of the site."""
    from siftmesh.search import Parameters, search

    s = store(spark, d)
    first = evaluate(_RANKED, s).agg(F.min("site_id")).first()[0]
    return search(s.where(F.col("site_id") == (first or 0)), _ASKED, Parameters(size=100), VOCABULARY).rows.select("url_id", "weight")


@query("rt_union", to_sql.query_sql(_RANKED, "SELECT url_id, site_id, wp::BIGINT AS wp FROM hits", STOP))
def rt_union(spark, d):
    """The postings in two overlapping stores give the hits of one."""
    s = store(spark, d)
    low, high = (s.where(c) for c in (F.col("url_id") % 3 != 0, F.col("url_id") % 3 != 1))
    return R.both_stores(evaluate(_RANKED, low), evaluate(_RANKED, high)).select("url_id", "site_id", F.col("wp").cast("long").alias("wp"))


_FRESH = """fm AS (SELECT *, (url_id % 3 = 0)::INT AS late FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY late, within DESC, url_id) AS first FROM fm),
rest AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY within DESC, url_id) AS second FROM o WHERE first > 1),
sites2 AS (SELECT site_id, count(*) AS n_urls, max(site_weight) AS site_weight FROM fm GROUP BY site_id)"""


@query("rt_grouped", to_sql.query_sql(_RANKED, "SELECT o.site_id, o.url_id, o.weight, rest.url_id AS second_url, rest.weight AS second_weight, n_urls, sites2.site_weight FROM o JOIN sites2 USING (site_id) LEFT JOIN rest ON rest.site_id = o.site_id AND rest.second = 1 WHERE o.first = 1", STOP, _WEIGHT + ",\n" + _FRESH))
def rt_grouped(spark, d):
    """Results by site of a main and a real-time store that overlap."""
    rows = ranked(spark, d)
    return R.both_grouped(rows.where(F.col("url_id") % 3 != 0), rows.where(F.col("url_id") % 3 != 1))


_SHARDS = """sh AS (SELECT *, (url_id % 3)::INT AS shard FROM r), fs AS (SELECT *, row_number() OVER (PARTITION BY shard, site_id ORDER BY within DESC, url_id) AS rn FROM sh)"""


@query("federated_grouped", to_sql.query_sql(_RANKED, "SELECT site_id, url_id, weight, shard FROM fs WHERE rn = 1 ORDER BY site_weight DESC, weight DESC, url_id, shard LIMIT 50", STOP, _WEIGHT + ",\n" + _SHARDS))
def federated_grouped(spark, d):
    """Each server sends its sites' best documents; a site competes once a server."""
    rows = ranked(spark, d)
    return R.federated([R.by_site(rows.where(F.col("url_id") % 3 == k)) for k in range(3)], 50).select("site_id", "url_id", "weight", "shard")


@query("federated_totals", to_sql.query_sql(_RANKED, "SELECT count(DISTINCT (shard, site_id)) AS n_sites, count(*) AS n_urls, count(*) > 0 AS complex FROM sh", STOP, _WEIGHT + ",\n" + _SHARDS))
def federated_totals(spark, d):
    rows = ranked(spark, d)
    each = [R.result_totals(rows.where(F.col("url_id") % 3 == k)).withColumn("complex", F.col("n_urls") > 0) for k in range(3)]
    return R.federated_totals(each)


@query("federated_words", f"WITH {to_sql.postings()} SELECT word, count(DISTINCT url_id) AS urlcount, count(*) AS totalcount FROM postings WHERE word IN ('describes', 'garden', 'pictures') GROUP BY word")
def federated_words(spark, d):
    own = P.served(spark, d)
    words = ["describes", "garden", "pictures"]
    each = [own.index.where(F.col("word").isin(words) & (F.col("url_id") % 2 == k)).groupBy("word").agg(F.count(F.lit(1)).alias("urlcount"), F.sum("cnt").alias("totalcount")) for k in range(2)]
    return R.federated_words(each)


@query("federated_topk", _ranked_sql("SELECT url_id, weight, (url_id % 3)::INT AS shard FROM r ORDER BY site_weight DESC, weight DESC, url_id LIMIT 50"))
def federated_topk(spark, d):
    rows = ranked(spark, d)
    return R.federated([rows.where(F.col("url_id") % 3 == k) for k in range(3)], 50).select("url_id", "weight", "shard")
