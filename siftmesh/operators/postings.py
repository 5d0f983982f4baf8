"""From documents to positional postings, dictionary and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.functions.text import BODY, DESCRIPTION, KEYWORDS, TITLE, indexable, position_word, stopwords, tokens
from siftmesh.session import Scratch
from siftmesh.sources.tables import read, urls_once

SECTIONS = {TITLE: "title", KEYWORDS: "keywords", DESCRIPTION: "description", BODY: "txt"}


def pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per page of the crawl: url_id and the given columns (by default the texts and links).

    A redelivered page counts once. Only the columns that are asked for are read and shuffled.
    """
    rest = list(columns or [*SECTIONS.values(), "hrefs"])
    return (
        read(spark, folder, "urlwords").where(F.col("url_id").isNotNull())
        .groupBy("url_id").agg(F.min(F.struct("parsed_at", *rest)).alias("r")).select("url_id", *[f"r.{c}" for c in rest])
    )


def located(spark: SparkSession, folder: str, *columns: str, url_columns: tuple[str, ...] = ("url", "crc")) -> DataFrame:
    """Pages with the site (0 if unknown) and further columns of their URL; pages of unknown or deleted URLs are left out."""
    urls = urls_once(read(spark, folder, "urlword"), "site_id", "deleted", *url_columns).where(F.col("deleted") == 0)
    kept = urls.select("url_id", F.coalesce("site_id", F.lit(0).cast("long")).alias("site_id"), *url_columns)
    return pages(spark, folder, *columns).join(kept, "url_id")


def page_postings(spark: SparkSession, folder: str, stop: list[str] | None = None) -> DataFrame:
    """word, site_id, url_id, section, pos (16-bit position word) over all four sections."""
    rows = tokens(located(spark, folder, *SECTIONS.values(), url_columns=()), ["site_id", "url_id"], SECTIONS)
    rows = indexable(rows, stopwords("en") if stop is None else stop)
    return rows.select("word", "site_id", "url_id", "section", position_word(F.col("section"), F.col("pos")).alias("pos"))


def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, pos, word of the documents."""
    return tokens(read(spark, folder, "documents"), ["doc_id"], {BODY: "text"}).select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


def grouped(postings: DataFrame) -> DataFrame:
    """word, site_id, url_id, positions (sorted), cnt: the form in which an index is stored."""
    out = postings.groupBy("word", "site_id", "url_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return out.withColumn("cnt", F.size("positions").cast("long"))


def totals(postings: DataFrame, key: str) -> DataFrame:
    """word, urlcount, totalcount. Counted by (word, document) first, so a common word is combined before it moves."""
    per = postings.groupBy("word", key).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("word").agg(F.count(F.lit(1)).alias("urlcount"), F.sum("c").alias("totalcount"))


def document_counts(postings: DataFrame, key: str) -> DataFrame:
    """key, wordcount (distinct words), totalcount (all words)."""
    per = postings.groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("wordcount"), F.sum("c").alias("totalcount"))


def write_index(postings: DataFrame, path: str, files: int) -> None:
    """The stored index: clustered by word and site, so a query reads the few row groups of its words.

    The ranges are on (word, site_id), so a very common word is spread over files.
    """
    grouped(postings).repartitionByRange(files, "word", "site_id").sortWithinPartitions("word", "site_id", "url_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings of a stored index, one row a position; filters on word reach the scan."""
    rows = spark.read.parquet(path).select("word", "site_id", "url_id", F.explode("positions").alias("pos"))
    return rows.withColumn("section", F.shiftright("pos", 14))


@dataclass
class Served:
    """A stored index with the tables beside it. index: word, site_id, url_id, positions, cnt. dictionary: word, urlcount, totalcount."""

    index: DataFrame
    dictionary: DataFrame
    links: DataFrame
    urls: DataFrame


_served: dict[tuple, Served] = {}
#: Bytes of compressed texts that one file of the index comes from; postings are some ten times as many.
FILE_BYTES = 16 << 20


def _state(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple:
    """Files of the tables with their sizes and times: an index is of one state of its tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(conf)
        each = fs.listFiles(path, True)
        while each.hasNext():
            f = each.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def served(spark: SparkSession, folder: str) -> Served:
    """The index of a folder's crawl tables, written once for a state of the tables and then only read.

    A search reads the postings of its words, not the pages. The index lies in the shared folder; a table that has changed since
    gets an index of its own.
    """
    state = _state(spark, folder, ("urlword", "urlwords"))
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _served:
        scratch = Scratch(spark, "index")
        path = scratch.path("postings")
        write_index(page_postings(spark, folder), path, max(1, -(-sum(n for _, n, _ in state) // FILE_BYTES)))
        index = spark.read.parquet(path)
        dictionary = scratch.write(index.groupBy("word").agg(F.count(F.lit(1)).alias("urlcount"), F.sum("cnt").alias("totalcount")).repartitionByRange("word").sortWithinPartitions("word"), "dictionary")
        links = pages(spark, folder, "hrefs").select(F.col("url_id").alias("from_id"), F.explode("hrefs").alias("to_id")).where(F.col("to_id").isNotNull()).distinct()
        urls = urls_once(read(spark, folder, "urlword"), "site_id", "url")
        _served[key] = Served(index, dictionary, scratch.write(links, "links"), scratch.write(urls, "urls"))
    return _served[key]
