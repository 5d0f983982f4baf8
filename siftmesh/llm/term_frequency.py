"""Frequency of every distinct term, by recursive radix partitions aggregated out of core."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.session import local_shared_path, partitions
from siftmesh.sources.tables import read, word_key

#: Bits of the hash that one level of the recursion splits by, and levels over the term's hash.
DIGIT_BITS, LEVELS = 4, 4
#: (term, record) entries that a partition may have before it is split further; so many fit in ``MEMORY``, and what doesn't after all is spilled.
PART_ENTRIES = 500_000
MEMORY = "256MB"
RARE, COMMON = 2, 0.25


def plan(cells: dict[int, int], limit: int) -> tuple[list[str], dict[str, int]]:
    """Which prefixes of the term hash are split on, and which full prefixes need a split by record as well.

    ``cells``: entries by the first ``LEVELS`` digits of the hash, so the recursion needs no further pass over the data.
    """
    split: list[str] = []
    by_record: dict[str, int] = {}
    level = {"": list(cells.items())}
    for depth in range(LEVELS + 1):
        below: dict[str, list[tuple[int, int]]] = {}
        for prefix, own in level.items():
            total = sum(n for _, n in own)
            if depth and total <= limit:
                continue
            if depth == LEVELS:
                by_record[prefix] = 1 << (-(-total // limit) - 1).bit_length()
                continue
            split.append(prefix)
            for cell, n in own:
                below.setdefault(prefix + f"{(cell >> DIGIT_BITS * (LEVELS - 1 - depth)) & 15:x}", []).append((cell, n))
        level = below
    return split, by_record


def assignment(cells: dict[int, int], limit: int) -> list[tuple[int, str, int]]:
    """(cell, partition, parts by record) of every cell; one row for each, 65 536 at most."""
    split, by_record = plan(cells, limit)
    whole = set(split)
    out = []
    for cell in cells:
        digits = f"{cell:0{LEVELS}x}"
        prefix = next(digits[:d] for d in range(1, LEVELS + 1) if digits[:d] not in whole)
        out.append((cell, prefix, by_record.get(prefix, 1)))
    return out


def _aggregate(folder: str | None):
    """Count a task's partitions in DuckDB one after the other, with its memory limited and the rest in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        schema = pa.schema([("term", pa.string()), ("total", pa.int64()), ("records", pa.int64())])
        con = duckdb.connect()
        spill = folder and f"{folder}/duckdb-{uuid.uuid4().hex}"

        def counted() -> Iterator[pa.RecordBatch]:
            out = con.sql(
                "WITH once AS (SELECT DISTINCT ON (block, piece, term) term, records FROM entries), "
                "each AS (SELECT term, unnest(CASE WHEN len(records) > 0 THEN records ELSE [NULL] END) AS record FROM once), "
                "pairs AS (SELECT term, record, count(record) AS n FROM each GROUP BY term, record) "
                "SELECT term, sum(n)::BIGINT AS total, count(record) AS records FROM pairs GROUP BY term"
            ).to_arrow_table()
            yield from out.cast(schema).to_batches(max_chunksize=50_000)

        try:
            con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET preserve_insertion_order = false")
            con.execute(f"SET temp_directory = '{spill or ''}'")
            con.execute("CREATE TABLE entries (term VARCHAR, block BIGINT, piece INTEGER, records BIGINT[])")
            held = None
            for batch in batches:
                part = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
                begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
                for a, b in zip(begin, [*begin[1:], len(part)]):
                    if held is not None and part[a] != held:
                        yield from counted()
                        con.execute("TRUNCATE entries")
                    held = part[a]
                    rows = pa.Table.from_batches([batch.slice(a, b - a)])  # noqa: F841  read by name
                    con.execute("INSERT INTO entries SELECT term, block, piece, records FROM rows")
            if held is not None:
                yield from counted()
        finally:
            con.close()
            if spill and os.path.isdir(spill):
                shutil.rmtree(spill, ignore_errors=True)

    return run


def frequencies(rows: DataFrame, limit: int = PART_ENTRIES) -> DataFrame:
    """``rows``: term, block, records (array of longs). Result: term, total, records.

    ``total`` counts the entries of all distinct blocks, ``records`` the distinct entries. A block counts once however often
    it is delivered; null terms and blocks are left out, null entries don't count, a term with no entries has zeros.

    Terms are partitioned by four bits of their hash; a partition with more than ``limit`` entries is split by the next four,
    recursively. Where all sixteen bits don't suffice, because one term is that heavy, its entries are split by the hash of the
    record instead, so the parts are disjoint in records and their counts add up. The parts go to disk as the
    shuffle's partitions, sorted by part; a task holds one part at a time and aggregates it out of core. A part fits in memory anyway,
    so it makes no difference where the shared folder is no plain path and DuckDB has no place to spill to.
    """
    spark = rows.sparkSession
    live = rows.where(F.col("term").isNotNull() & F.col("block").isNotNull()).withColumn(
        "cell", F.shiftrightunsigned(F.xxhash64("term"), 64 - DIGIT_BITS * LEVELS)
    )
    entries = (F.greatest(F.coalesce(F.size("records"), F.lit(0)), F.lit(0)) + 1).cast("long")
    cells = {r["cell"]: r["n"] for r in live.groupBy("cell").agg(F.sum(entries).alias("n")).toLocalIterator()}
    assigned = assignment(cells, limit)
    count = sum({prefix: folds for _, prefix, folds in assigned}.values())
    # One row a cell of sixteen bits, so this side has a bound whatever the data.
    live = live.join(F.broadcast(spark.createDataFrame(assigned, "cell long, part string, folds int")), "cell")
    whole = live.select("term", "block", F.lit(-1).alias("piece"), "records", "part", "folds")
    if any(folds > 1 for _, _, folds in assigned):
        single = live.where("folds > 1").select("term", "block", "part", "folds", F.posexplode_outer("records").alias("piece", "record")).select(
            "term", "block", F.coalesce("piece", F.lit(0)).alias("piece"), F.array("record").alias("records"),
            F.concat("part", F.lit("/"), F.pmod(F.xxhash64("record"), F.col("folds")).cast("string")).alias("part"), "folds",
        )
        whole = whole.where("folds = 1").unionByName(single)
    spread = whole.select("part", "term", "block", F.col("piece").cast("int").alias("piece"), "records").repartition(max(partitions(spark), count // 2), "part").sortWithinPartitions("part")
    counted = spread.mapInArrow(_aggregate(local_shared_path(spark)), "term string, total long, records long")
    return counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies(read(spark, folder, "wordurlu").select(word_key().alias("term"), F.col("block_id").alias("block"), F.col("urls").alias("records")))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    urls = read(spark, folder, "urlword").agg(F.countDistinct("url_id")).first()[0]
    mark = F.when(F.col("records") <= RARE, "rare").when(F.col("records") >= F.lit(COMMON * urls), "common")
    return _words(spark, folder).select(F.col("term").alias("word"), F.col("total").alias("n_listed"), F.col("records").alias("n_urls"), mark.alias("mark"))


def word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """word, n_listed (entries of urls over all blocks), n_urls (distinct), mark (rare, common or null)."""
    return _marked(spark, folder)


def marked_words(spark: SparkSession, folder: str) -> DataFrame:
    """word, mark of the words with at most 2 URLs or at least a quarter of all."""
    return _marked(spark, folder).where(F.col("mark").isNotNull()).select("word", "mark")
