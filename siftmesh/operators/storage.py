"""What is kept: contents, snapshots with a pointer, logs, spaces and subsets."""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.operators.skewed_keys import numbered
from siftmesh.session import Scratch


def saved(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key. Of repeated new rows the greatest counts."""
    rest = [c for c in old.columns if c != key]
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("_new", *rest)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def selection(masks: dict[str, list]) -> Column:
    """All fields must match one of their values; text values are LIKE patterns."""
    return reduce(
        lambda a, b: a & b,
        [reduce(lambda a, b: a | b, [F.col(f).like(v) if isinstance(v, str) else F.col(f) == v for v in values]) for f, values in masks.items() if values],
        F.lit(True),
    )


def cleared(urls: DataFrame, masks: dict[str, list]) -> DataFrame:
    """``urls`` without those a selection names; without any mask nothing is left."""
    return urls.where(~F.coalesce(selection(masks), F.lit(False)))


def word_ids(words: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """word, word_id: ids of known words stay, new ones follow by name."""
    top = known.agg(F.coalesce(F.max("word_id"), F.lit(0))).first()[0]
    new = words.where(F.col("word").isNotNull()).select("word").distinct().join(known, "word", "left_anti").withColumn("_all", F.lit(0))
    return known.select("word", "word_id").unionByName(numbered(new, "_all", ["word"], scratch, "word_id").select("word", (F.col("word_id") + top).alias("word_id")))


def subset_urls(urls: DataFrame, subsets: DataFrame) -> DataFrame:
    """subset_id, url_id of the URLs that the masks of ``subsets`` (subset_id, mask; a few rows) match."""
    masks = [(r["subset_id"], r["mask"]) for r in subsets.where("mask is not null").orderBy("subset_id").toLocalIterator()]
    hits = F.filter(F.array(*[F.when(F.col("url").like(m), F.lit(i).cast("int")) for i, m in masks] or [F.lit(None).cast("int")]), lambda x: x.isNotNull())
    return urls.select(F.explode(F.array_distinct(hits)).alias("subset_id"), "url_id")


def changed_spaces(spaces: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """space_id, site_id after adding and removing pairs."""
    out = spaces.select("space_id", "site_id")
    out = out.unionByName(add.select("space_id", "site_id")) if add is not None else out
    out = out.distinct()
    return out.join(remove, ["space_id", "site_id"], "left_anti") if remove is not None else out


def publish(table: DataFrame, folder: str) -> str:
    """Write a new snapshot and point to it; readers of the old one go on undisturbed."""
    spark = table.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT"), True)
    out.writeUTF(name)
    out.close()
    return name


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that was published last."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT"))
    name = stream.readUTF()
    stream.close()
    return spark.read.parquet(f"{folder}/{name}")


def result_key(normal_query: str, *parameters) -> int:
    """Key of a cached result: a checksum of the query's normal form and its parameters."""
    return zlib.crc32("\x00".join([normal_query, *map(repr, parameters)]).encode())


def log_query(spark: SparkSession, folder: str, query: str, address: str, sites: int, urls: int, start: float, finish: float, page: int = 0, size: int = 20) -> None:
    """Append a search to the query log."""
    schema = "addr string, query string, np int, ps int, sites long, urls long, start double, finish double"
    row = spark.createDataFrame([(address, query, page, size, sites, urls, start, finish)], schema)
    row.select("*").withColumns({c: F.col(c).cast("decimal(15,3)") for c in ("start", "finish")}).write.mode("append").parquet(folder)


def append_changes(changes: DataFrame, folder: str, parts: int = 100) -> None:
    """Append changes to a log in ``folder``, one part for each ``word_id`` modulo ``parts`` (null ids in a part of their own)."""
    part = F.pmod("word_id", F.lit(parts)).cast("int")
    changes.withColumn("part", part).repartition("part").write.mode("append").partitionBy("part").parquet(folder)


def logged_changes(spark: SparkSession, folder: str, part: int | None = None, schema: str | None = None) -> DataFrame:
    """The log with its ``part``; of a single part only that folder is read. An empty log needs the schema."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    return rows if part is None else rows.where(F.col("part") == part)


def purged(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """``rows`` (url_id, ...) without those of URLs that are flagged as deleted or have no row: the second step of a deletion."""
    return rows.join(urls.where(F.col("deleted") == 0).select("url_id"), "url_id", "left_semi")


class ResultCache:
    """Results of the last searches as tables in the shared folder, by :func:`result_key`; new ranks or a new index clear it."""

    def __init__(self, scratch: Scratch, most: int = 100):
        self.scratch, self.most = scratch, most
        self.tables: OrderedDict[int, DataFrame] = OrderedDict()

    def get(self, key: int, search: Callable[[], DataFrame]) -> DataFrame:
        """The stored result, or that of ``search``, which is stored; the one that wasn't asked for longest goes beyond ``most``."""
        if key not in self.tables:
            self.tables[key] = self.scratch.write(search(), "result")
            if len(self.tables) > self.most:
                self.scratch.drop(self.tables.popitem(last=False)[1])
        self.tables.move_to_end(key)
        return self.tables[key]

    def clear(self) -> None:
        self.scratch.drop(*self.tables.values())
        self.tables.clear()
