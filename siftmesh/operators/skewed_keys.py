"""Per-key results where a handful of keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmesh.session import Scratch, partitions
from siftmesh.sources.tables import read, word_key


def per_key(rows: DataFrame, key: str, order: str, values: dict[str, str], tasks: int | None = None) -> DataFrame:
    """``key``, ``n`` (distinct values of ``order``) and the aggregates of ``values`` by name.

    ``values`` maps an output name to ``sum:column``, ``min:column`` or ``max:column``.
    The rows are range partitioned on (key, order) by sampled quantiles, so every task gets about the
    same number of rows and a heavy key is cut into as many ranges as it fills. As the ranges are on
    (key, order), rows that repeat a pair lie in one task, and are counted once there without another
    shuffle. Each task then holds one partial state per key; only those states travel, and a key that
    stands on both sides of a boundary is stitched from its states.

    Rows whose key or order is null are left out. An empty table gives an empty result.
    """
    functions = {"sum": F.sum, "min": F.min, "max": F.max}
    parsed = {name: spec.split(":") for name, spec in values.items()}
    columns = list(dict.fromkeys(c for _, c in parsed.values()))
    spread = (
        rows.where(F.col(key).isNotNull() & F.col(order).isNotNull())
        .select(key, order, *columns)
        .repartitionByRange(tasks or partitions(rows.sparkSession), key, order)
    )
    once = spread.groupBy(key, order).agg(*[F.max(c).alias(c) for c in columns] or [F.lit(1).alias("_")])
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[functions[f](c).alias(name) for name, (f, c) in parsed.items()])


def posting_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "wordurlu").select(
        word_key().alias("word"), "block_id", F.coalesce(F.size("urls"), F.lit(0)).cast("long").alias("listed"), "merged_at"
    ).withColumn("listed", F.greatest("listed", F.lit(0)))


def words(spark: SparkSession, folder: str) -> DataFrame:
    """word, n_blocks, n_listed (entries of urls), longest (list), first_merged, last_merged."""
    out = per_key(posting_blocks(spark, folder), "word", "block_id",
                  {"n_listed": "sum:listed", "longest": "max:listed", "first_merged": "min:merged_at", "last_merged": "max:merged_at"})
    return out.withColumnRenamed("n", "n_blocks")


def heavy_words(spark: SparkSession, folder: str, share: float = 0.01) -> DataFrame:
    """word of every word that holds at least ``share`` of the distinct blocks."""
    scratch = Scratch(spark, "heavy-words")
    each = scratch.write(per_key(posting_blocks(spark, folder), "word", "block_id", {}), "words")
    total = each.agg(F.sum("n")).first()[0] or 0
    return each.where(F.col("n") >= F.lit(share * total)).select("word")


def numbered(rows: DataFrame, key: str, order: list[str], scratch: Scratch, name: str = "place", tasks: int | None = None) -> DataFrame:
    """Rows with their 1-based place within the key, as ``row_number`` gives it, without a task that holds a whole key.

    The rows are range partitioned on (key, order) and numbered within each range; the counts of the
    ranges of a key are then added up from left to right. ``order`` must be unique within a key for a defined result;
    rows with a null key are left out.
    """
    ranged = rows.where(F.col(key).isNotNull()).repartitionByRange(tasks or partitions(rows.sparkSession), key, *order).sortWithinPartitions(key, *order)
    marked = ranged.select("*", F.lit(0).alias("_range"), F.lit(0).cast("long").alias("_local"))
    kept = scratch.write(marked.mapInArrow(_local_places(key), marked.schema), "ranges")
    counts = kept.groupBy(key, "_range").agg(F.max("_local").alias("_n"))
    # A key has no more rows here than there are ranges.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).select(key, "_range", "_before").where(F.col("_before") > 0)
    placed = kept.join(offsets, [key, "_range"], "left")
    return placed.select(*rows.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def _local_places(key: str):
    """Number the sorted rows of a partition within their key; a key goes on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, reached = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(batch.schema.get_field_index(key))
            # Runs of equal keys, null being a key of its own.
            codes = pc.fill_null(pc.dictionary_encode(values).indices, -1).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            size = np.diff(np.append(begin, n))
            local = np.arange(n) - np.repeat(begin, size) + 1
            if values[0].as_py() == last:
                local[: size[0]] += reached
            last, reached = values[n - 1].as_py(), int(local[-1])
            columns = [*batch.columns[:-2], pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


#: Rows of one key that one task joins; a key with more is split into as many parts as it needs.
JOIN_ROWS = 1_000_000


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None, limit: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, whatever share of ``left`` a key holds. ``right`` should have few rows a key.

    The rows of a key with more than ``limit`` are told apart by the hash of their values and meet a copy of the key's rows of ``right``
    in each part. At most one key in ``limit`` rows is hot, so their list can be sent around. Null keys join with nothing. ``rows``: how many
    ``left`` has at most, where that is known.
    """
    limit = limit or JOIN_ROWS
    if (left.count() if rows is None else rows) <= limit:
        return left.join(right, key, how)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_same")).where(F.col("n_same") > limit).select(key, F.ceil(F.col("n_same") / limit).cast("int").alias("n_parts"))
    parts = F.coalesce("n_parts", F.lit(1))
    apart = left.join(F.broadcast(hot), key, "left").withColumn("part_of", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("n_parts")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("part_of", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n_parts")
    return apart.join(copied, [key, "part_of"], how).drop("part_of")
