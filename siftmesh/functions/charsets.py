"""Charsets and languages of bytes by n-gram profiles, and words of texts without spaces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a gram, grams of a profile, and the least score of a guess.
GRAM, PROFILE, LEAST = 4, 400, 0.01


def grams(data: bytes) -> Counter:
    """Counts of the 1- to 4-grams of bytes, white space being one sign."""
    data = b" ".join(data.lower().split())
    return Counter(data[i : i + n] for n in range(1, GRAM + 1) for i in range(len(data) - n + 1))


def profile(samples: list[bytes]) -> frozenset[bytes]:
    """The most frequent grams of samples (ties in order of bytes)."""
    total: Counter = Counter()
    for s in samples:
        total.update(grams(s))
    return frozenset(g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:PROFILE])


def learned(rows: DataFrame) -> dict[str, frozenset[bytes]]:
    """Profiles by name from all texts of ``rows`` (name, data as bytes): the maps that a guess compares with. Null names and data are left out.

    Grams are counted in the tasks and summed by gram; of a name only the grams of its profile come to the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, Counter] = {}
            for name, data in zip(batch["name"], batch["data"]):
                out.setdefault(name, Counter()).update(grams(data))
            yield pd.DataFrame([(name, g, n) for name, c in out.items() for g, n in c.items()], columns=["name", "gram", "n"])

    known = rows.where(F.col("name").isNotNull() & F.col("data").isNotNull()).select("name", "data")
    total = known.mapInPandas(count, "name string, gram binary, n long").groupBy("name", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "gram"))
    out: dict[str, set[bytes]] = {}
    for r in total.withColumn("place", place).where(F.col("place") <= PROFILE).select("name", "gram").toLocalIterator():
        out.setdefault(r["name"], set()).add(bytes(r["gram"]))
    return {name: frozenset(g) for name, g in out.items()}


def guess(data: bytes | None, profiles: dict[str, frozenset[bytes]]) -> str | None:
    """Name of the profile that shares most of the grams of data; None for no data or if all score too low."""
    own = grams(data or b"")
    if not own or not profiles:
        return None
    common = set(g for g, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:PROFILE])
    score, name = max((len(common & p) / len(common | p), n) for n, p in sorted(profiles.items()))
    return name if score >= LEAST else None


def guessed(rows: DataFrame, profiles: dict[str, frozenset[bytes]], key: str, data: str) -> DataFrame:
    """key, guess of binary or text columns. Profiles have 400 grams each, so they travel with the plan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "guess": [guess(x.encode() if isinstance(x, str) else x, profiles) for x in batch[data]]})

    return rows.select(key, data).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, guess string")


def segments(text: str, words: frozenset[str]) -> list[str]:
    """Cut runs of ideographs into the longest words of a dictionary, else single signs; other runs stay whole."""
    longest = max(map(len, words), default=1)
    out, i = [], 0
    while i < len(text):
        if not _ideograph(text[i]):
            j = i
            while j < len(text) and text[j].isalnum() and not _ideograph(text[j]):
                j += 1
            if j > i:
                out.append(text[i:j].lower())
            i = max(j, i + 1)
            continue
        size = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in words), 1)
        out.append(text[i : i + size])
        i += size
    return out


def _ideograph(c: str) -> bool:
    return "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3"
