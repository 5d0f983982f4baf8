"""Near-duplicate records with small edits: HyperMinHash registers, bands, estimate, exact check."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.llm.components import components
from siftmesh.session import Scratch, partitions
from siftmesh.sources.tables import read

#: Jaccard similarity of the word sets from which on two texts are near-duplicates.
SIMILARITY = 0.6
#: A register is 16 bits: the leading zeros of the smallest hash value, then this many bits that follow its first one.
MANTISSA = 11
ZEROS = 31
#: Registers of a band, and bands.
ROWS, BANDS = 6, 100
#: Bands of the first round, at least of a later one, and at most; what a round puts on disk is gone before the next one begins. Candidates
#: a text that a round should have at most: from those of the last round follows how many bands the next one has.
FIRST, LEAST, ROUND, CANDIDATES = 4, 5, 20, 5.0
#: Registers of the estimate, and how many standard deviations below the threshold still count.
ESTIMATE, SLACK = 64, 4.0
#: Bits of each of these registers that go along with a band entry, and the deviations that still count for them.
CHECKED, CHECK_SLACK = 2, 3.1
#: Entries that one task sorts. A band value of more entries, by a sample in which it has so many, is salted into as many blocks as it needs.
TASK_ENTRIES, SAMPLE, SAMPLED_HOT = 2_000_000, 20_000, 50
#: Buckets of a task; each is sorted at once.
BUCKETS = 16
#: Ids of a value that meet in one unit of work, and pairs that a unit has at least before the next one begins.
BLOCK, UNIT_PAIRS = 2_048, 500_000
#: Texts that are banded at once, and entries that a task holds before it writes.
CHUNK, HELD = 10_000, 1_000_000


def word_set(text: str):
    """The distinct lowercased runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(words: pa.Array, count: int, seed: int) -> np.ndarray:
    """Of each word and register: leading zeros and inverted mantissa, so that the largest code has the smallest hash."""
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    out = np.empty((len(h), count), np.uint16)
    for k in range(count):
        with np.errstate(over="ignore"):
            fraction, power = np.frexp(_mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + k + 1)).astype(np.float64))
        zeros = np.clip(64 - power, 0, ZEROS).astype(np.uint16)
        rest = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.uint16)
        out[:, k] = (zeros << MANTISSA) | (((1 << MANTISSA) - 1) - rest)
    return out


def registers(words: pa.ListArray, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """HyperMinHash registers (texts x count, 16 bits each) of the word sets, and their numbers of words.

    Every register looks at all words of a text under its own hash function; texts here have too few words to
    spread them over registers. The registers of a text without words are 0.
    """
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.dictionary_encode(words.flatten())
    if not isinstance(flat, pa.DictionaryArray):
        flat = flat.combine_chunks()
    code = flat.indices.to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), count), np.uint16)
    if len(code):
        table = _codes(flat.dictionary, count, seed)
        filled = np.flatnonzero(size)
        begin = np.cumsum(size)[filled] - size[filled]
        # The k-th word of all texts that have one, the longest first, so no array has a row a word.
        order = np.argsort(-size[filled], kind="stable")
        begin, length = begin[order], size[filled][order]
        most = table[code[begin]]
        left = np.searchsorted(-length, -np.arange(1, length[0]), "left")
        for k, n in enumerate(left.tolist(), 1):
            np.maximum(most[:n], table[code[begin[:n] + k]], out=most[:n])
        out[filled[order]] = most
    return out, size


def _chance(sizes: list[int]) -> np.ndarray:
    """Chance that registers of two sets without a common word are equal, for each pair of sizes."""
    zeros = np.repeat(np.arange(ZEROS + 1), 1 << MANTISSA)
    low = 2.0 ** -(zeros + 1) * (1 + np.tile(np.arange(1 << MANTISSA), ZEROS + 1) / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    each = np.array([(1 - low) ** n - (1 - high) ** n for n in sizes])
    return each @ each.T


_SIZES = [1 << k for k in range(16)]


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from the share of equal registers."""
    same = (a == b).mean(axis=1)
    log = lambda s: np.clip(np.round(np.log2(np.maximum(s, 1))).astype(int), 0, len(_SIZES) - 1)
    by_chance = chance[log(size_a), log(size_b)]
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)


def _folded(regs: np.ndarray, rows: int, space: int, first: int = 0) -> np.ndarray:
    """The registers of each band as one 64-bit value, told apart by the number of the band, from ``first``."""
    bands = regs.shape[1] // rows
    own = np.ascontiguousarray(regs).reshape(len(regs), bands, rows).astype(np.uint64)
    value = np.broadcast_to(np.arange(first, first + bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(space), (len(regs), bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(0, rows, 3):
            word = own[:, :, k]
            for more in range(k + 1, min(k + 3, rows)):
                word = (word << np.uint64(16)) | own[:, :, more]
            value = _mix(value + word + np.uint64(1))
    return value


def _band_values(words: pa.ListArray, bands: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit value) of the bands that are named, which follow each other, or of all if none is."""
    own = range(bands[0], bands[-1] + 1) if len(bands) else range(BANDS)
    regs, size = registers(words, ROWS * len(own), ROWS * own[0])
    some = np.flatnonzero(size)
    return np.repeat(some, len(own)), _folded(regs[some], ROWS, 2, own[0]).ravel()


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, lowest first: the empty high bytes of all values lie together and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _checks(sketch: np.ndarray) -> np.ndarray:
    """The lowest bits of all registers of the estimate, the first of each in one 64-bit word, the second in another."""
    planes = [np.packbits((sketch >> np.uint8(k)) & np.uint8(1), axis=1, bitorder="little") for k in range(CHECKED)]
    return np.hstack(planes).view("<u8")


def _least_equal(similarity: float) -> int:
    """Registers of the estimate whose checked bits are equal in a pair that still counts, chance included."""
    p = similarity + (1 - similarity) / (1 << CHECKED)
    return int(ESTIMATE * p - CHECK_SLACK * (ESTIMATE * p * (1 - p)) ** 0.5)


_CHECK_BYTES = ESTIMATE * CHECKED // 8


def _packed(ids: np.ndarray, checks: np.ndarray) -> bytes:
    return _planes(ids) + checks.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 + _CHECK_BYTES)
    return _unplanes(data[: 8 * n]).astype(np.int64), np.frombuffer(data, "<u8", offset=8 * n).reshape(n, CHECKED)


_KEY_BITS = np.uint64((1 << 32) - 1)


def _salted(value: np.ndarray, ids: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of hot values as many: an id falls into one of the value's blocks and meets every other block, and with it its own.

    Returns the new values and the place of each one's entry.
    """
    own = (_mix(ids.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(ids)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at, other = at[other != own[at]], other[other != own[at]]
    pair = (np.minimum(own[at], other) * blocks[at] + np.maximum(own[at], other)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(value[at] + (pair + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), at


def _entries(bands: Sequence[int], hot: dict[int, int], buckets: int):
    """Band entries of a partition, packed as one row a bucket: 32-bit values, and ids with their checked bits.

    Together with the bucket, whose number grows with the data, a value is long enough that few
    different bands meet by chance, and those that do are told apart by the checked bits. Input: rep, words, and the sketch if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_values = np.array(sorted(hot), np.uint64)
        hot_blocks = np.array([hot[v] for v in sorted(hot)], np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def packed() -> pa.RecordBatch:
            value, ids, check = (np.concatenate(x) for x in zip(*held))
            bucket = (value % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, key, ids, check = bucket[order], ((value // np.uint64(buckets)) & _KEY_BITS)[order], ids[order], check[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            end = np.append(begin[1:], len(bucket))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[begin].astype(np.int64), pa.int64()), pa.array([_planes(key[a:b]) for a, b in zip(begin, end)], pa.binary()),
                 pa.array([_packed(ids[a:b], check[a:b]) for a, b in zip(begin, end)], pa.binary())], names=["bucket", "keys", "ids"])

        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                words = pc.split_pattern(part.column(1), " ")
                sketch = _sketched(words)[0] if part.num_columns == 2 else np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, ESTIMATE)
                ids, checks = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _checks(sketch)
                text, value = _band_values(words, bands)
                if len(hot_values):
                    at = np.minimum(np.searchsorted(hot_values, value), len(hot_values) - 1)
                    is_hot = hot_values[at] == value
                    salted, place = _salted(value[is_hot], ids[text[is_hot]], hot_blocks[at[is_hot]])
                    value, text = np.append(value[~is_hot], salted), np.append(text[~is_hot], text[is_hot][place])
                held.append((value, ids[text], checks[text]))
                count += len(value)
                if count >= HELD:
                    yield packed()
                    held, count = [], 0
        if held:
            yield packed()

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that share a value as units of work: many small groups in one, two blocks of a large group in one.

    The rows come ordered by bucket, so a bucket is sorted at once; no pair is built here, so a value of very many ids does no
    harm. Ids go with their checked bits. ``size``: ids of each group in ``left``; where ``right`` isn't null, all of ``left`` meets all of it.
    """
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0

    def batch(rows: list[tuple[bytes, bytes, bytes | None]]) -> pa.RecordBatch:
        nonlocal number
        first, number = number, number + len(rows)
        unit = pa.array([(part << 32) + first + i for i in range(len(rows))], pa.int64())
        return pa.RecordBatch.from_arrays([unit, *[pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]], names=["unit", "size", "left", "right"])

    def emit(keys: list[bytes], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([_unplanes(k) for k in keys]).astype(np.uint32)
        own, check = (np.concatenate(x) for x in zip(*(_unpacked(i) for i in ids)))
        # Most values are of one id only, so the rest is ordered fully.
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(False, same) | np.append(same, False)]
        order = order[np.lexsort((own[order], key[order]))]
        key, own, check = key[order], own[order], check[order]
        if not len(key):
            return
        keep = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
        key, own, check = key[keep], own[keep], check[keep]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        small = np.flatnonzero((size > 1) & (size <= BLOCK))
        unit = np.cumsum(size[small] * (size[small] - 1) // 2) // UNIT_PAIRS
        rows = []
        for group in np.split(small, np.flatnonzero(np.diff(unit)) + 1) if len(small) else []:
            take = np.repeat(begin[group] - np.append(0, np.cumsum(size[group])[:-1]), size[group]) + np.arange(size[group].sum())
            rows.append((size[group].astype("<i4").tobytes(), _packed(own[take], check[take]), None))
        for g in np.flatnonzero(size > BLOCK):
            blocks = [slice(k, min(k + BLOCK, begin[g] + size[g])) for k in range(begin[g], begin[g] + size[g], BLOCK)]
            for i, a in enumerate(blocks):
                ids_of_a = np.array([a.stop - a.start], "<i4").tobytes()
                rows.append((ids_of_a, _packed(own[a], check[a]), None))
                for b in blocks[i + 1 :]:
                    rows.append((ids_of_a, _packed(own[a], check[a]), _packed(own[b], check[b])))
                    if len(rows) >= 256:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    bucket, keys, ids = None, [], []
    for whole in batches:
        for b, k, i in zip(*(c.to_pylist() for c in whole.columns)):
            if b != bucket and keys:
                yield from emit(keys, ids)
                keys, ids = [], []
            bucket = b
            keys.append(k)
            ids.append(i)
    if keys:
        yield from emit(keys, ids)


def _pairs(batches: Iterator[pa.RecordBatch], similarity: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """The pairs of each unit whose checked bits are equal often enough, the smaller id first."""
    least = _least_equal(similarity)
    for batch in batches:
        for size, left, right in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            own, check = _unpacked(left)
            if right is not None:
                other, other_check = _unpacked(right)
                i, j = np.repeat(np.arange(len(own)), len(other)), np.tile(np.arange(len(other)), len(own))
            else:
                other, other_check = own, check
                n = np.frombuffer(size, "<i4").astype(np.int64)
                # Each id with those that follow it in its group.
                after = np.repeat(np.cumsum(n), n) - np.arange(len(own)) - 1
                i = np.repeat(np.arange(len(own)), after)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            for k in range(0, len(i), 500_000):
                x, y = i[k : k + 500_000], j[k : k + 500_000]
                unlike = np.bitwise_or.reduce(check[x] ^ other_check[y], axis=1)
                keep = (ESTIMATE - np.bitwise_count(unlike) >= least) & (own[x] != other[y])
                a, b = own[x[keep]], other[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _sketched(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """One hashed byte of each register of the estimate, and the numbers of words."""
    regs, size = registers(words, ESTIMATE, 10_000)
    return ((regs.astype(np.uint32) * np.uint32(0x9E37)) >> np.uint32(8)).astype(np.uint8), size


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            part = batch.slice(k, CHUNK)
            sketch, size = _sketched(pc.split_pattern(part.column(1), " "))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array(size.astype(np.int32), pa.int32())],
                                             names=["rep", "words", "sketch", "size"])



def _likely(similarity: float):
    least = similarity - SLACK * (similarity * (1 - similarity) / ESTIMATE) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = None
        for batch in batches:
            if chance is None:
                # Registers are compared by one byte of a hash, which is equal by chance, too.
                chance = 1 - (1 - _chance(_SIZES)) * (1 - 1 / 256)
            sketch = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ESTIMATE)
            size = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            keep = estimate(sketch("sketch_a"), sketch("sketch_b"), size("size_a"), size("size_b"), chance) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


class NearDuplicates:
    """Exact-copy classes of a table of texts and the near-duplicate pairs between classes.

    ``rows``: id (long), text. A text whose word set is empty (null, empty, only signs) is left out. Texts with the same
    word set are one class, represented by its smallest id, so copies are banded once, however many there are.

    Registers of a class over all its words are banded, whatever words they are; bands that meet give candidates. A band entry carries two
    bits of each of 64 other registers, so most pairs of unrelated texts end where they meet and never leave the task; the
    collision-corrected estimate over all bits thins out the rest and an exact comparison of the word sets decides. With
    similarity s a pair is missed with chance (1 - s^6)^100, and with 0.0007 for the checked bits at the threshold.

    The bands come in rounds. Each round's files are deleted before the next one begins, so the disk holds the entries and candidates of
    one round; it has the fewer bands the more candidates the last one had. Few texts take one round.

    A band value with more entries than a task sorts is salted into as many blocks as it needs; ids that share a value leave
    their task as blocks of bounded size, and each two blocks meet in a unit of work of its own, so no task builds all pairs of a value.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, similarity: float = SIMILARITY):
        self.scratch, self.similarity, self.spark = scratch, similarity, rows.sparkSession
        sets = rows.where(F.col("id").isNotNull()).select("id", F.array_join(F.sort_array(word_set("text")), " ").alias("words")).where(F.col("words") != "")
        self.keyed = scratch.write(sets.withColumn("key", F.unhex(F.md5("words"))), "keyed")
        least = self.keyed.groupBy("key").agg(F.min(F.struct("id", "words")).alias("m"))
        self.classes = scratch.write(least.select("key", F.col("m.id").alias("rep"), F.col("m.words").alias("words")), "classes")
        self.count = self.classes.count()

    def members(self) -> DataFrame:
        """id, rep of every record that has words."""
        return self.keyed.select("id", "key").distinct().join(self.classes.select("key", "rep"), "key").select("id", "rep")

    def _hot(self) -> dict[int, int]:
        """Values of more than ``TASK_ENTRIES`` entries, by a sample, and blocks of each. It only steers where entries go."""
        share = min(1.0, max(SAMPLE / max(self.count, 1), SAMPLED_HOT / TASK_ENTRIES))
        if self.count <= TASK_ENTRIES:
            return {}  # a text has a value once

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = []
            for batch in batches:
                for k in range(0, batch.num_rows, CHUNK):
                    values.append(_band_values(pc.split_pattern(batch.slice(k, CHUNK).column(1), " "), ())[1])
            value, n = np.unique(np.concatenate(values or [np.zeros(0, np.uint64)]), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(value[often].astype(np.int64), pa.int64()), pa.array(n[often], pa.int64())], names=["value", "n"])

        seen = self.classes.select("rep", "words").sample(False, share, 7)
        each = seen.mapInArrow(count, "value long, n long").groupBy("value").agg((F.sum("n") / share).alias("n"))
        hot = each.where(F.col("n") > TASK_ENTRIES).select("value", F.ceil(2 * F.col("n") / TASK_ENTRIES).alias("blocks"))
        return {r["value"] & 0xFFFFFFFFFFFFFFFF: r["blocks"] for r in hot.toLocalIterator()}

    def _release(self) -> None:
        """Spark deletes the files of a shuffle once nothing refers to it, when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def pairs(self) -> DataFrame:
        """a, b: representatives of classes whose word sets are similar enough, each pair once."""
        hot = self._hot()
        tasks = max(partitions(self.spark), -(-self.count * ROUND // TASK_ENTRIES))
        texts = self.scratch.write(self.classes.select("rep", "words").mapInArrow(_sketches, "rep long, words string, sketch binary, size int"), "texts")
        side = lambda t, c: t.select(*[F.col(x).alias(c if x == "rep" else f"{x}_{c}") for x in t.columns])
        sketches, words = texts.select("rep", "sketch", "size"), texts.select("rep", "words")
        rounds, first, width = [], 0, BANDS if self.count * BANDS <= TASK_ENTRIES else FIRST
        while first < BANDS:
            bands = range(first, min(first + width, BANDS))
            entries = texts.select("rep", "words", "sketch").mapInArrow(_entries(bands, hot, BUCKETS * tasks), "bucket long, keys binary, ids binary")
            # The order is total, so a task that runs again makes the same units.
            units = entries.repartition(tasks, "bucket").sortWithinPartitions("bucket", "ids", "keys").mapInArrow(_units, "unit long, size binary, left binary, right binary")
            met = units.repartition(tasks, "unit").mapInArrow(partial(_pairs, similarity=self.similarity), "a long, b long")
            candidates = self.scratch.write(met.distinct(), "candidates")
            del entries, units, met
            self._release()
            near = candidates.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").mapInArrow(_likely(self.similarity), "a long, b long")
            rounds.append(self.scratch.write(near, "likely"))
            first, width = bands.stop, int(min(max(CANDIDATES * self.count * len(bands) / max(candidates.count(), 1), LEAST), ROUND))
            self.scratch.drop(candidates)
            del near
            self._release()
        likely = reduce(DataFrame.unionByName, rounds).distinct()
        both = likely.join(side(words, "a"), "a").join(side(words, "b"), "b")
        a, b = F.split("words_a", " "), F.split("words_b", " ")
        common = F.size(F.array_intersect(a, b))
        near = common >= F.lit(self.similarity) * (F.size(a) + F.size(b) - common)
        return self.scratch.write(both.where(near).select("a", "b"), "pairs")


def _within(members: DataFrame, block: int = 2_000) -> DataFrame:
    """a, b of all records of one class; a large class meets in blocks, so no task has all of it."""
    sized = members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "rep")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = sized.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = own.select("rep", F.col("id").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = own.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    met = left.join(right, ["rep", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "urlwords").select(F.col("url_id").alias("id"), F.col("txt").alias("text"))


def page_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """url_id_a, url_id_b of all pages whose word sets have a Jaccard similarity of at least 0.6."""
    scratch = Scratch(spark, "near")
    near = NearDuplicates(_pages(spark, folder), scratch)
    pairs = near.pairs()
    members = scratch.write(near.members(), "members")
    across = pairs.join(members.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    # A URL that was delivered with two different texts is no pair with itself, and no pair twice.
    every = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(_within(members)).where(F.col("a") < F.col("b"))
    return every.distinct().select(F.col("a").alias("url_id_a"), F.col("b").alias("url_id_b"))


def page_groups(spark: SparkSession, folder: str) -> DataFrame:
    """url_id, class_id, group_id, n_links of every page with words: its class of copies, the group of classes that hang
    together by similar pairs, and the number of other classes that its class is similar to."""
    scratch = Scratch(spark, "near")
    near = NearDuplicates(_pages(spark, folder), scratch)
    pairs = near.pairs()
    groups = components(pairs, scratch)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    per_class = near.classes.select("rep").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    return near.members().join(per_class, "rep").groupBy("id").agg(F.min(F.struct("rep", "group_id", "n_links")).alias("c")).select(
        F.col("id").alias("url_id"), F.col("c.rep").alias("class_id"), F.col("c.group_id").alias("group_id"), F.col("c.n_links").alias("n_links")
    )
