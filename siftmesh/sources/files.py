"""Small text files of a crawl: URL lists, robots rules, stopwords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stopwords longer than this are no stopwords.
LONGEST_STOPWORD = 16


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of the lines of text files; blank lines and ``#`` comments are skipped, a missing scheme is ``http://``."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))
    return rows.select(F.when(F.contains("url", F.lit("://")), F.col("url")).otherwise(F.concat(F.lit("http://"), "url")).alias("url")).distinct()


def stopword_list(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, word of a file with one word a line and ``#`` comments."""
    word = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    rows = spark.read.text(path).select(F.lit(lang).alias("lang"), word.alias("word"))
    return rows.where((F.col("word") != "") & (F.length("word") <= LONGEST_STOPWORD)).distinct()


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """site_id, path of the rules for ``*`` or for our own name, of ``files`` (site_id, body).

    An empty ``Disallow:`` forbids nothing. A file is small, so its lines stay in one row until they are read.
    """
    lines = files.select("site_id", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("n", "line"))
    part = lambda i: F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:\s*([^#\s]*)", i)
    fields = lines.select("site_id", "n", F.lower(part(1)).alias("name"), part(2).alias("value")).where(F.col("name").isin("user-agent", "disallow"))
    names = F.col("name") == "user-agent"
    w = Window.partitionBy("site_id").orderBy("n")
    # Agents that follow each other without a rule between them share the rules below.
    opens = names & (F.coalesce(F.lag("name").over(w), F.lit("disallow")) != "user-agent")
    groups = fields.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(w))
    ours = names & ((F.col("value") == "*") | (F.contains(F.lit(agent.lower()), F.lower("value")) & (F.col("value") != "")))
    wanted = groups.where(ours).select("site_id", "group").distinct()
    return groups.where(~names & (F.col("value") != "")).join(wanted, ["site_id", "group"]).select("site_id", F.col("value").alias("path")).distinct()
