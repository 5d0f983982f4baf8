"""Countries of addresses by ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Addresses of a bucket of the range join.
BUCKET_BITS = 16


def address(text: Column) -> Column:
    """``a.b.c.d`` as a number; null if it isn't one."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("long"))
    ok = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def read_ranges(lines: DataFrame) -> DataFrame:
    """start, end, country of lines ``a.b.c.d-e.f.g.h CC``; other lines are skipped."""
    form = r"^\s*([\d.]+)\s*-\s*([\d.]+)\s+(\w+)"
    parts = lines.select(*[F.regexp_extract("value", form, i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "country"))])
    rows = parts.select(address(F.col("a")).alias("start"), address(F.col("b")).alias("end"), "country")
    return rows.where(F.col("start").isNotNull() & (F.col("end") >= F.col("start")))


def lookup(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """``rows`` with country of the narrowest range that holds ``ip``, null without one.

    Ranges are cut into buckets of 65 536 addresses and joined on the bucket, so neither side is broadcast or crossed.
    ``rows`` needs a unique id column ``id``.
    """
    cut = ranges.select("start", "end", "country", F.explode(F.sequence(F.shiftright("start", BUCKET_BITS), F.shiftright("end", BUCKET_BITS))).alias("bucket"))
    hit = rows.select("id", F.col(ip).alias("ip"), F.shiftright(ip, BUCKET_BITS).alias("bucket")).join(cut, "bucket").where(F.col("ip").between(F.col("start"), F.col("end")))
    best = hit.groupBy("id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "start", "country")).alias("b")).select("id", F.col("b.country").alias("country"))
    return rows.join(best, "id", "left")


def blocks(ranges: DataFrame) -> DataFrame:
    """network, bits, country: each range as the fewest aligned blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start, end, country in zip(batch["start"], batch["end"], batch["country"]):
                at = int(start)
                while at <= end:
                    size = min((at & -at) or 1 << 32, 1 << (int(end) - at + 1).bit_length() - 1)
                    out.append((at, 32 - (size.bit_length() - 1), country))
                    at += size
            yield pd.DataFrame(out, columns=["network", "bits", "country"])

    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    return ranges.where(whole).select("start", "end", "country").mapInPandas(run, "network long, bits long, country string")
