"""From the parameters of a search form to a query and its settings."""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmesh.operators.excerpts import colored
from siftmesh.plans.compile import Store
from siftmesh.plans.query_language import Vocabulary, parse
from siftmesh.search import Found, Parameters, Side, placed, search

#: Section prefixes of the form's switches, results a page at most and by default.
_SECTIONS = (("bd", "body:"), ("ds", "desc:"), ("kw", "keywords:"), ("tl", "title:"))
MOST, USUAL = 100, 20
#: Backgrounds of the words of a query in a stored copy, in turn.
COLORS = ["#ffff66", "#a0ffff", "#99ff99", "#ff9999"]


@dataclass(frozen=True)
class Request:
    query: str
    parameters: Parameters
    forms: tuple[str, ...] = ()
    masks: tuple[str, ...] = ()
    cached: int | None = None


def _sites(text: str) -> str:
    hosts = text.replace(",", " ").split()
    return f"site:{hosts[0]}" if len(hosts) == 1 else f"({' | '.join(f'site:{h}' for h in hosts)})" if hosts else ""


def rewrite(values: dict[str, str]) -> str:
    """The query that a form's words, excluded words, sites, sections and earlier query stand for."""
    link = values.get("ln", "").strip()
    if link:
        return f"link: {link}"
    query = (values.get("iq") or values.get("q", "")).strip()
    if values.get("iq") and values.get("im") == "p":
        query = f'"{query}"'
    prefix = "".join(p for key, p in _SECTIONS if values.get(key) == "on")
    if query and prefix and sum(values.get(k) == "on" for k, _ in _SECTIONS) < 4:
        query = f"{prefix}({query})"
    without = values.get("xq", "").strip()
    if without:
        query += f' -"{without}"' if values.get("xm") == "p" else "".join(f" -{w}" for w in without.split())
    if only := _sites(values.get("is", "")):
        query += f" {only}"
    if drop := _sites(values.get("xs", "")):
        query += f" -{drop}"
    if values.get("in") == "on" and values.get("r", "").strip():
        query = f"({values['r'].strip()}) ({query})"
    return query.strip()


def _number(text: str | None, default: int) -> int:
    return int(text) if text and text.isdigit() else default


_UNIT = {"s": 1, "M": 60, "h": 3600, "d": 86_400, "m": 2_592_000, "y": 31_536_000}


def seconds(text: str) -> int | None:
    """``4h30m`` and the like; a bare integer counts seconds; anything else is None."""
    import re

    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"([+-]?\d+[sMhdmy])+", text):
        return sum(int(n) * _UNIT[u] for n, u in re.findall(r"([+-]?\d+)([sMhdmy])", text))
    return None


def window(values: dict[str, str], now: int) -> tuple[int | None, int | None]:
    """Seconds from and to of a form's time limit: back from now, before or after a day, or between two days."""
    kind = values.get("dt")
    if kind == "back" and (back := seconds(values.get("dp", ""))):
        return now - back, None
    if kind == "er":
        day = calendar.timegm((_number(values.get("dy"), 1970), _number(values.get("dm"), 0) + 1, _number(values.get("dd"), 1), 0, 0, 0))
        return (day, None) if values.get("dx") == "1" else (None, day)
    if kind == "range":
        return _day(values.get("db", "")), _day(values.get("de", ""))
    return None, None


def _day(text: str) -> int | None:
    try:
        d, m, y = (int(x) for x in text.split("/"))
        return calendar.timegm((y, m, d, 0, 0, 0))
    except ValueError:
        return None


def request(text: str, now: int, origin: int) -> Request:
    """Read ``a=1&b=2``. ``origin`` is the second of hour 0 of the stored times of change."""
    values = dict(parse_qsl(text, keep_blank_values=True))
    start, end = window(values, now)
    hour = lambda s: None if s is None else max(0, (s - origin) // 3600)
    p = Parameters(
        sort="date" if values.get("s") == "date" else "rate", group=values.get("gr") != "off", number=_number(values.get("np"), 0),
        size=min(max(_number(values.get("ps"), USUAL), 1), MOST), site=_number(values.get("st"), 0) or None,
        spaces=tuple(sorted(int(k[2:]) for k, v in values.items() if k[:2] == "sp" and k[2:].isdigit() and v == "on")),
        since=hour(start), until=hour(end), first_only="t" in values, distances=values.get("ad") != "no",
    )
    if p.site:
        p = replace(p, group=False)
    return Request(rewrite(values), p, tuple(values.get("fm", "").replace(",", " ").split()), tuple(values.get("ul", "").split()), _number(values.get("ch"), 0) or None)


def answer(text: str, store: Store, side: Side, now: int, origin: int, stop: set[str], forms: dict[str, dict[str, tuple[str, ...]]]) -> Found | DataFrame:
    """What a form asks for: the results of its query, or with ``ch`` the row (url_id, page) of a stored copy with the query's words colored.

    ``forms``: word forms by language; ``fm`` says which languages' forms count.
    """
    asked = request(text, now, origin)
    known: dict[str, tuple[str, ...]] = {}
    for language in asked.forms:
        for word, others in forms.get(language, {}).items():
            known[word] = known.get(word, ()) + tuple(o for o in others if o not in known.get(word, ()))
    vocabulary = Vocabulary(stop=stop, forms=known)
    if asked.cached is not None:
        return copy(side.copies.where(F.col("url_id") == asked.cached), parse(asked.query, vocabulary).tree)
    sites, subsets = placed(list(asked.masks), side.subsets)
    return search(store, asked.query, replace(asked.parameters, site_masks=sites, subsets=subsets), vocabulary, side)


def copy(rows: DataFrame, tree) -> DataFrame:
    """url_id, page of stored copies with the words of a query colored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"url_id": batch["url_id"], "page": [None if p is None else colored(p, tree, COLORS) for p in batch["page"]]})

    return rows.select("url_id", "page").mapInPandas(run, "url_id long, page string")
