"""References to records that do not exist, by key bitmaps per range and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.session import Scratch, partitions
from siftmesh.sources.tables import read, urls_once

#: Keys that one range of the dictionary has; bit b of range r stands for the b-th key of the range.
RANGE = 1 << 16
#: References that one task packs before it writes containers out, and containers that are merged at once.
PACK_ROWS, MERGED = 2_000_000, 64
#: References to one target in a period that one task joins; a target with more is split into as many parts as it needs.
HOT_ROWS = 1_000_000
_NO_PERIOD = -(1 << 31)
_DICTIONARY = -1


def _packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first one and the steps between them in as few bytes as they need."""
    steps = np.diff(keys.astype(np.int64)).astype(np.uint64)
    width = next(w for w in "1248" if w == "8" or not len(steps) or steps.max() < 1 << 8 * int(w))
    return width.encode() + keys[:1].astype("<i8").tobytes() + steps.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    first, steps = np.frombuffer(data, "<i8", 1, 1), np.frombuffer(data, f"<u{data[:1].decode()}", offset=9)
    return first[0] + np.append(np.uint64(0), np.cumsum(steps, dtype=np.uint64)).astype(np.int64)


def _compressed(bits: np.ndarray) -> bytes:
    """Sorted codes of a range: as they are if few (two bytes each), else as the bitmap (8 KB at most)."""
    if len(bits) < RANGE // 16:
        return b"a" + bits.astype("<u2").tobytes()
    full = np.zeros(RANGE, bool)
    full[bits] = True
    return b"b" + np.packbits(full).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def _dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted parents (space, key, period, living) cut to ranges: each range's keys, whose places are their codes, and a bitmap of codes per period."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        keys, period = rows["key"].to_numpy(np.int64), rows["period"].to_numpy(np.int64)
        alive = np.flatnonzero(rows["living"].to_numpy(bool))
        periods = np.unique(period[alive])
        return pd.DataFrame({
            "space": int(rows["space"].iloc[0]), "low": int(keys[0]), "period": [_NO_PERIOD, *periods], "kind": [_DICTIONARY, *[0] * len(periods)],
            "data": [_packed(keys), *[_compressed(alive[period[alive] == p]) for p in periods]],
        })

    held: pd.DataFrame | None = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        while held is not None and len(held):
            same = int((held["space"] == held["space"].iloc[0]).sum())
            if same == len(held) and same < RANGE:
                break
            cut = min(same, RANGE)
            yield one(held.iloc[:cut])
            held = held.iloc[cut:]
    if held is not None and len(held):
        yield one(held)


def _containers(lows: dict[int, np.ndarray]):
    """Rows (space, field, period, key) packed to one container of keys per (space, range, field, period)."""

    def pack(parts: list[pd.DataFrame], lane: int) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        key = rows["key"].to_numpy(np.int64)
        space, field, period = (rows[c].to_numpy(np.int64) for c in ("space", "field", "period"))
        place = np.zeros(len(rows), np.int64)
        for s in np.unique(space):
            own = space == s
            place[own] = np.searchsorted(lows.get(int(s), np.zeros(0, np.int64)), key[own], "right")
        order = np.lexsort((key, period, field, place, space))
        cols = [c[order] for c in (space, place, field, period)]
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        keep = new.copy()
        keep[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(key))
        return pd.DataFrame({
            "space": cols[0][starts], "range": cols[1][starts], "field": cols[2][starts], "period": cols[3][starts], "lane": lane,
            "data": [_packed(key[a:b][keep[a:b]]) for a, b in zip(starts, ends)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
            if count >= PACK_ROWS:
                yield pack(held, lane)
                held, count = [], 0
        if held:
            yield pack(held, lane)

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring rows of one (space, range, field, period, lane) as one container; the rows come sorted by these."""
    name: tuple | None = None
    data: list[bytes] = []

    def merged() -> tuple:
        return (*name, data[0] if len(data) == 1 else _packed(np.unique(np.concatenate(list(map(_unpacked, data))))))

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            own = tuple(row)[:5]
            if own != name or len(data) >= MERGED:
                if data:
                    out.append(merged())
                name, data = own, []
            data.append(row.data)
        if out:
            yield pd.DataFrame(out, columns=batch.columns)
    if data:
        yield pd.DataFrame([merged()], columns=["space", "range", "field", "period", "lane", "data"])


def _and_not(key: tuple, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """One range: the references of each period AND NOT the parents of all earlier periods, and references to keys without a code."""
    space = int(key[0])
    named = parents["kind"] == _DICTIONARY
    keys = _unpacked(parents["data"][named].iloc[0]) if named.any() else np.zeros(0, np.int64)
    known = np.zeros(RANGE, bool)
    waiting = sorted(zip(parents["period"][~named], parents["data"][~named]))
    at, out = 0, []
    for period, group in refs.groupby("period", sort=True):
        while at < len(waiting) and waiting[at][0] < period:
            known[_decoded(waiting[at][1])] = True
            at += 1
        for field, same in group.groupby("field"):
            target = np.unique(np.concatenate(list(map(_unpacked, same["data"]))))
            code = np.searchsorted(keys, target)
            coded = code < len(keys)
            coded[coded] = keys[code[coded]] == target[coded]
            asked = np.zeros(RANGE, bool)
            asked[code[coded]] = True
            left = np.append(keys[np.flatnonzero(asked & ~known)], target[~coded])
            if len(left):
                out.append(pd.DataFrame({"space": space, "field": int(field), "period": int(period), "target_id": left}))
    if not out:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("space", "field", "period", "target_id")})
    return pd.concat(out, ignore_index=True)


def orphans(refs: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """References whose target is missing, deleted or late.

    ``refs``: space, field (ints), source_id, target_id, at (the record's own time), each once.
    ``parents``: space, key, deleted (0/1), first_seen, one row per key.
    Result: field, source_id, target_id, at, kind.

    The parents' keys are encoded in their order: range partitions are cut to ranges of 65 536 keys, and a key's code is its place in its
    range, however far apart the keys are. Living parents become compressed bitmaps of codes per range and period, a day.
    The tasks that read references pack their targets per range, field and period; such containers of many tasks are
    merged, ``MERGED`` at once, until there is one each, so what meets in one task is one range with at most one container a
    field and day, whatever share of all references names it. A reference is settled there if its parent isn't deleted and came in an
    earlier period. Only the surviving bits are decoded, and only they are compared by time with their parent. A target that very many
    records of a period name is split by record, into parts of ``HOT_ROWS``.
    A record without time can't be before its target, so it is missing or deleted or nothing.
    """
    spark = refs.sparkSession
    period = lambda at: F.coalesce(F.unix_date(F.to_date(at)), F.lit(_NO_PERIOD)).cast("long")
    refs = refs.withColumn("period", period("at"))
    ordered = parents.select("space", "key", period("first_seen").alias("period"), (F.coalesce("deleted", F.lit(0)) == 0).alias("living"))
    ordered = ordered.repartitionByRange(partitions(spark), "space", "key").sortWithinPartitions("space", "key")
    known = scratch.write(ordered.mapInPandas(_dictionary, "space long, low long, period long, kind int, data binary"), "dictionary")
    # One key a range goes through the driver, of 65 536 and of each task.
    lows: dict[int, list[int]] = {}
    for space, low in sorted(map(tuple, known.where(F.col("kind") == _DICTIONARY).select("space", "low").collect())):
        lows.setdefault(space, []).append(low)
    bounds = {s: np.array(v, np.int64) for s, v in lows.items()}
    place = spark.createDataFrame([(s, low, i + 1) for s, v in lows.items() for i, low in enumerate(v)], "space long, low long, range long")
    shape = "space long, range long, field long, period long, lane long, data binary"
    asked = refs.select("space", "field", "period", F.col("target_id").alias("key")).mapInPandas(_containers(bounds), shape)
    same = ["space", "range", "field", "period", "lane"]
    while True:
        laned = asked.withColumn("lane", F.floor(F.col("lane") / MERGED))
        asked = scratch.write(laned.repartition(*same).sortWithinPartitions(*same).mapInPandas(_merge, shape), "asked")
        if not (asked.agg(F.max("lane")).first()[0] or 0):
            break
    coded = known.join(place, ["space", "low"]).select(F.col("space").alias("own_space"), F.col("range").alias("own_range"), "period", "kind", "data")
    left = asked.groupBy("space", "range").cogroup(coded.groupBy("own_space", "own_range")).applyInPandas(
        _and_not, "space long, field long, period long, target_id long"
    )
    left = scratch.write(left, "surviving")
    group = ["space", "field", "period", "target_id"]
    judged = left.join(parents.withColumnRenamed("key", "target_id"), ["space", "target_id"], "left").select(
        *group, "deleted", "first_seen", F.col("found").isNotNull().alias("found")
    )
    if refs.count() > HOT_ROWS:
        # At most one target in HOT_ROWS references is hot.
        hot = scratch.write(refs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_same")).where(F.col("n_same") > HOT_ROWS).select(
            *group, F.ceil(F.col("n_same") / HOT_ROWS).cast("int").alias("n_parts")), "hot")
        one = F.coalesce("n_parts", F.lit(1))
        judged = judged.join(hot, group, "left").withColumn("part_of", F.explode(F.sequence(F.lit(0), one - 1))).drop("n_parts")
        refs = refs.join(F.broadcast(hot), group, "left").withColumn("part_of", F.pmod(F.xxhash64("source_id"), one).cast("int"))
        group = [*group, "part_of"]
    kind = (
        F.when(~F.col("found"), "missing")
        .when(F.col("deleted") == 1, "deleted")
        .when(F.col("first_seen") > F.col("at"), "late")
    )
    return (
        refs.join(judged, group)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("field", "source_id", "target_id", "at", "kind")
    )


FIELDS = ("urlword.referrer", "urlword.site_id", "urlwords.hrefs")


def crawl_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """ref_field, url_id, target_id, kind, ref_month of every orphan reference of the crawl tables."""
    scratch = Scratch(spark, "orphans")
    urls = scratch.write(urls_once(read(spark, folder, "urlword"), "site_id", "deleted", "referrer"), "urls")
    sites = read(spark, folder, "sites").where(F.col("site_id").isNotNull()).groupBy("site_id").agg(F.min("seen_at").alias("first_seen"))
    pages = (
        read(spark, folder, "urlwords").where(F.col("url_id").isNotNull())
        .select("url_id", "parsed_at", F.explode("hrefs").alias("target_id")).where(F.col("target_id").isNotNull())
        .groupBy("url_id", "target_id").agg(F.min("parsed_at").alias("at"))
    )

    def refs(space: int, field: int, source: str, target, at: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(space).cast("long").alias("space"), F.lit(field).cast("long").alias("field"),
                           F.col(source).alias("source_id"), target.cast("long").alias("target_id"), F.col(at).alias("at"))

    every = (
        refs(0, 0, "url_id", F.col("referrer"), "first_seen", urls.where(F.col("referrer").isNotNull() & (F.col("referrer") != 0)))
        .unionByName(refs(1, 1, "url_id", F.col("site_id"), "first_seen", urls.where(F.col("site_id").isNotNull())))
        .unionByName(refs(0, 2, "url_id", F.col("target_id"), "at", pages))
    )
    every = scratch.write(every, "references")
    parents = urls.select(F.lit(0).cast("long").alias("space"), F.col("url_id").alias("key"), "deleted", "first_seen").unionByName(
        sites.select(F.lit(1).cast("long").alias("space"), F.col("site_id").alias("key"), F.lit(0).alias("deleted"), "first_seen")
    ).withColumn("found", F.lit(True))
    out = orphans(every, parents, scratch)
    name = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field").cast("int") + 1)
    return out.select(name.alias("ref_field"), F.col("source_id").alias("url_id"), "target_id", "kind", F.date_format("at", "yyyy-MM").alias("ref_month"))


def orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """ref_field, ref_month, kind, n_refs, n_targets."""
    return crawl_orphans(spark, folder).groupBy("ref_field", "ref_month", "kind").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("target_id").alias("n_targets")
    )
