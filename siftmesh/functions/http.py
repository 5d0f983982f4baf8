"""Responses of a crawl: header fields, classes of status, and the next visit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmesh.functions.dates import http_date

#: What a status means for the crawl.
OK, REDIRECT, UNCHANGED, DELETE, RETRY, UNKNOWN = "ok", "redirect", "unchanged", "delete", "retry", "unknown"
_CLASSES = ((OK, (200,)), (REDIRECT, (300, 301, 302, 303, 307)), (UNCHANGED, (304,)), (DELETE, (204, 400, 401, 402, 403, 404, 405, 406, 407, 409, 410, 411, 414, 415, 500, 501, 505)), (RETRY, (408, 502, 503, 504)))


def status_class(status: Column) -> Column:
    out = F.lit(UNKNOWN)
    for name, codes in _CLASSES:
        out = F.when(status.isin(*codes), name).otherwise(out)
    return out


def headers(text: Column) -> Column:
    """Map of the lowercased header fields of a response; of a repeated field the last one counts."""
    lines = F.filter(F.split(text, r"\r\n|\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([\w-]+)", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[\w-]+\s*:\s*(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.map_from_arrays(names, last)


def content_type(field: Column) -> Column:
    """``type/subtype`` in lower case, without parameters; empty and null are null."""
    kind = F.lower(F.trim(F.regexp_extract(field, r"^([^;]*)", 1)))
    return F.when(kind != "", kind)


def charset(field: Column) -> Column:
    """The charset parameter of a content type, in lower case."""
    found = F.lower(F.regexp_extract(field, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1))
    return F.when(found != "", found)


def next_visit(fetched: Column, period: int, expires: Column) -> Column:
    """Seconds of the next visit: a period after the fetch, or when the response expires, if that is later."""
    due = fetched + period
    until = http_date(expires)
    return F.when(until > due, until).otherwise(due)
