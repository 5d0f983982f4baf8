"""Change logs: merging into an index in batches or as a stream, and windows over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.session import Scratch, delete


def latest(changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """seq, keys, value: the last change of each key, removals included. A null value is an empty one."""
    empty = F.array().cast(changes.schema[value].dataType)
    last = changes.groupBy(*keys).agg(F.max(F.struct("seq", F.coalesce(value, empty).alias(value))).alias("r"))
    return last.select("r.seq", *keys, F.col(f"r.{value}").alias(value))


def merge(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` after the changes: the last change of a key (by ``seq``) counts, an empty value removes it.

    ``base``: keys, value (an array), one row a key. ``delta``: seq, keys, value. The changes are combined first; what they don't name passes
    an anti-join as it is, which leaves the index where it lies if the changes are small enough to be sent around (as Spark
    sees by their size), and sorts both sides by key otherwise. Null keys are keys like others.
    """
    last = latest(delta, keys, value)
    named = last.select(*[F.col(k).alias(f"changed_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"changed_{k}")) for k in keys])
    kept = base.select(*keys, value).join(named, same, "left_anti")
    return kept.unionByName(last.where(F.size(value) > 0).select(*keys, value))


class FoldedIndex:
    """An index in buckets of its keys that changes are folded into, bucket by bucket.

    Rows keep the number of the change that they come from, and removed keys an empty value, so changes may come in any order
    and a batch may be folded twice. Only buckets that a batch names are read and written again, under new names; a reader
    has the buckets of the time when it began. Where each bucket lies is all that the driver keeps.
    """

    def __init__(self, base: DataFrame, keys: list[str], value: str, scratch: Scratch, buckets: int = 32):
        self.spark, self.keys, self.value, self.scratch, self.buckets = base.sparkSession, keys, value, scratch, buckets
        self.places: dict[int, str] = {}
        self.schema = base.select(F.lit(0).cast("long").alias("seq"), *keys, value).schema
        self._write(base.select(F.lit(-1).cast("long").alias("seq"), *keys, value), "index")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, tag: str) -> list[str]:
        path = self.scratch.path(tag)
        self._bucketed(rows).repartition(self.buckets, "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        # Names of folders, one a bucket.
        written = {r["bucket"] for r in self.spark.read.parquet(path).select("bucket").distinct().collect()} if self._filled(path) else set()
        old = [self.places[b] for b in written if b in self.places]
        self.places |= {b: f"{path}/bucket={b}" for b in written}
        return old

    def _filled(self, path: str) -> bool:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(fs_path))

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = [self.places[b] for b in buckets if b in self.places]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def fold(self, changes: DataFrame) -> None:
        """``changes``: seq, keys, value."""
        own = self.scratch.write(latest(changes.select("seq", *self.keys, self.value), self.keys, self.value), "changes")
        named = sorted(r["bucket"] for r in self._bucketed(own).select("bucket").distinct().collect())
        if named:
            old = self._write(latest(self._read(named).unionByName(own), self.keys, self.value), "index")
            for path in old:
                delete(self.spark, path)
        self.scratch.drop(own)

    def rows(self) -> DataFrame:
        """keys, value of all keys that aren't removed."""
        return self._read(sorted(self.places)).where(F.size(self.value) > 0).select(*self.keys, self.value)


def stream_merge(spark: SparkSession, source: str, schema: str, base: DataFrame, keys: list[str], value: str, scratch: Scratch, per_batch: int = 1, buckets: int = 32) -> DataFrame:
    """The same as a stream over files of changes: each micro-batch is folded into the buckets that it names."""
    index = FoldedIndex(base, keys, value, scratch, buckets)
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    run = changes.writeStream.foreachBatch(lambda batch, _: index.fold(batch)).option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return index.rows()


class RecentStore:
    """The real-time store beside an index: whole new versions of documents, searched together with it and folded in when it is full.

    ``index``: document, further keys, value. A document's rows in the store hide all its rows in the index; a version without
    values removes it.
    """

    def __init__(self, index: FoldedIndex, document: str, most: int = 1_000):
        self.index, self.document, self.most = index, document, most
        self.recent: DataFrame | None = None

    def put(self, versions: DataFrame) -> None:
        """``versions``: seq, document, further keys, value. The last version of a document counts, whole."""
        every = versions.select("seq", *self.index.keys, self.index.value)
        every = self.recent.unionByName(every) if self.recent is not None else every
        newest = every.groupBy(F.col(self.document).alias("of")).agg(F.max("seq").alias("last"))
        kept = every.join(newest, F.col(self.document).eqNullSafe(F.col("of")) & (F.col("seq") == F.col("last")), "left_semi")
        old, self.recent = self.recent, self.index.scratch.write(kept, "recent")
        self.index.scratch.drop(old)
        if self.recent.select(self.document).distinct().count() >= self.most:
            self.fold()

    def rows(self) -> DataFrame:
        """keys, value of both stores together."""
        if self.recent is None:
            return self.index.rows()
        own = self.recent.select(F.col(self.document).alias("of")).distinct()
        old = self.index.rows().join(own, F.col(self.document).eqNullSafe(F.col("of")), "left_anti")
        return old.unionByName(self.recent.where(F.size(self.index.value) > 0).select(*self.index.keys, self.index.value))

    def fold(self) -> None:
        """Put the store's versions into the index and empty it: words that a version no longer has are removed."""
        if self.recent is None:
            return
        versions = self.recent.groupBy(F.col(self.document).alias("of")).agg(F.max("seq").alias("seq"))
        gone = self.index.rows().join(versions, F.col(self.document).eqNullSafe(F.col("of"))).join(
            self.recent.select(*[F.col(k).alias(f"new_{k}") for k in self.index.keys]),
            reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in self.index.keys]), "left_anti",
        )
        empty = F.array().cast(self.index.schema[self.index.value].dataType)
        changes = self.recent.where(F.size(self.index.value) > 0).unionByName(gone.select("seq", *self.index.keys, empty.alias(self.index.value)))
        self.index.fold(changes)
        self.index.scratch.drop(self.recent)
        self.recent = None


def sliding_sums(events: DataFrame, at: str, value: str, width: str, step: str) -> DataFrame:
    """starts, n, total of sliding windows: the measure a bandwidth limit looks at."""
    w = F.window(at, width, step)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("starts"), "n", "total")


def tumbling(events: DataFrame, at: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """starts, key, n by window; ``late`` sets a watermark, so the same plan runs over a stream."""
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str) -> DataFrame:
    """key, starts, n of sessions that end after a gap without events."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("starts"), "n")
