"""Excerpts and highlights of the documents of a shown page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame

from siftmesh.plans.query_language import And, Forms, InSections, Or, Pattern, Phrase, Word, leaves

_WORD = re.compile(r"[^\W_]+")
OPEN, CLOSE = "<B>", "</B>"


def _pattern(leaves_of) -> str:
    """A regular expression for any of the given leaves of a tree."""
    out = set()
    for leaf in leaves_of:
        match leaf:
            case Word(w):
                out.add(re.escape(w))
            case Forms(exact, others):
                out.update(re.escape(w) for w in (exact, *others) if w)
            case Pattern(_, text):
                out.add(re.escape(text).replace(r"\*", r"\w*").replace(r"\?", r"\w"))
    return "|".join(sorted(out, key=len, reverse=True)) or r"(?!)"


class Matcher:
    """Finds what a query asks for in a text: single words, and the words of a phrase only where the phrase stands. Excluded terms aren't asked for.

    ``terms`` is the number of what can be found; a match says which of them it belongs to.
    """

    def __init__(self, tree):
        self.units: list[tuple[list[re.Pattern], tuple[int, ...]]] = []
        self._add(tree)
        self.terms = len(self.units)

    def _add(self, tree) -> None:
        match tree:
            case And(terms, _, _, _) | Or(terms):
                for t in terms:
                    self._add(t)
            case InSections(inner, _):
                self._add(inner)
            case Phrase(terms, offsets):
                self.units.append(([re.compile(_pattern(leaves(t)), re.I) for t in terms], offsets))
            case _:
                if leaves(tree):
                    self.units.append(([re.compile(_pattern(leaves(tree)), re.I)], (0,)))

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """start, end, term of each word that matches, in order, once."""
        words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text or "")]
        hit: dict[int, int] = {}
        for n, (patterns, offsets) in enumerate(self.units):
            for i, (_, _, word) in enumerate(words):
                if patterns[0].fullmatch(word) and all(i + o < len(words) and p.fullmatch(words[i + o][2]) for p, o in zip(patterns[1:], offsets[1:])):
                    for o in offsets:
                        hit.setdefault(i + o, n)
        return [(*words[i][:2], hit[i]) for i in sorted(hit)]


def matcher(tree) -> Matcher:
    return Matcher(tree)


def excerpts(text: str | None, wanted: Matcher, most: int = 3, length: int = 120) -> list[str]:
    """Up to ``most`` stretches of about ``length`` letters around matches, at word ends, in order and without overlap.

    The last one gives way to a later one that holds more of the query's terms, until one holds all.
    """
    text = text or ""
    found = wanted.find(text)
    out: list[tuple[str, int]] = []
    end = 0
    for first, last, _ in found:
        if first < end:
            continue
        begin = max(end, first - length // 2)
        if begin > 0 and (space := text.find(" ", begin, first)) >= 0:
            begin = space + 1
        end = begin + length
        if end < len(text):
            end = max(text.rfind(" ", last, end), last)
        stretch = text[begin:end].strip(), len({n for a, b, n in found if begin <= a and b <= end})
        end = max(end, last)
        if len(out) < most:
            out.append(stretch)
        elif stretch[1] > out[-1][1]:
            out[-1] = stretch
        if len(out) == most and out[-1][1] == wanted.terms:
            break
    return [s for s, _ in out]


def highlighted(text: str | None, wanted: Matcher, start: str = OPEN, stop: str = CLOSE) -> str:
    """Escaped text with the matches between ``start`` and ``stop``."""
    text = text or ""
    out, at = [], 0
    for begin, end, _ in wanted.find(text):
        out += [escape(text[at:begin], quote=False), start, escape(text[begin:end], quote=False), stop]
        at = end
    return "".join(out) + escape(text[at:], quote=False)


def shown(rows: DataFrame, tree, texts: dict[str, str], key: str = "url_id", body: str = "txt") -> DataFrame:
    """``rows`` with highlighted columns (by new name) and ``excerpts``. Call it on the rows of a page, not on all hits."""
    wanted = matcher(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {key: batch[key], **{new: [highlighted(t, wanted) for t in batch[old]] for new, old in texts.items()}}
            yield pd.DataFrame(out | {"excerpts": [[highlighted(e, wanted) for e in excerpts(t, wanted)] for t in batch[body]]})

    schema = ", ".join([f"{key} long", *(f"{new} string" for new in texts), "excerpts array<string>"])
    return rows.mapInPandas(run, schema)


def colored(page: str, tree, colors: list[str]) -> str:
    """A stored page with each term of the query in the next color of the list; tags are left alone, a phrase may go over them."""
    plain = re.sub(r"<[^>]*>", lambda m: " " * len(m.group()), page)
    out, at = [], 0
    for begin, end, n in matcher(tree).find(plain):
        out += [page[at:begin], f'<span style="background:{colors[n % len(colors)]}">{page[begin:end]}</span>']
        at = end
    return "".join(out) + page[at:]
