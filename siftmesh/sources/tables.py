"""Readers for the crawl tables: one row per record, whatever was delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def urls_once(urlword: DataFrame, *columns: str) -> DataFrame:
    """One row per url_id with its first seen_at; rows without url_id are no records.

    Redelivered rows differ in seen_at only. Should others differ after all, the values of the
    earliest row count (then the smallest), so that the result is the same in any order.
    """
    rest = F.struct("seen_at", *columns)
    return (
        urlword.where(F.col("url_id").isNotNull())
        .groupBy("url_id")
        .agg(F.min("seen_at").alias("first_seen"), F.min(rest).alias("r"))
        .select("url_id", "first_seen", *[F.col(f"r.{c}").alias(c) for c in columns])
    )


def word_key(column: str = "word"):
    """Lowercased, without spaces and tabs at both ends; null if nothing is left."""
    word = F.lower(F.btrim(F.col(column), F.lit(" \t")))
    return F.when(word != "", word)
