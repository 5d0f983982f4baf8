"""Evaluation passages inside training text, by a generalised suffix automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siftmesh.sources.tables import read

#: Words in a row that make a leak.
LEAST_WORDS = 13
#: Leaked share of a document's words beyond which the whole document goes.
DROP_SHARE = 0.5
#: Documents whose words are held at once.
DOCUMENTS = 1_000
#: Words of one automaton; more items are taken in blocks, so what is broadcast has a bound.
BLOCK_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lowercased runs of letters and digits; none for null."""
    return _WORD.findall(text.lower()) if text else []


class Automaton:
    """The suffix automaton of many word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.code: dict[str, int] = {}
        coded = [(item, [self.code.setdefault(w, len(self.code)) for w in ws]) for item, ws in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, sequence in coded:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        held: list[set[int]] = [set() for _ in self.next]
        for item, sequence in coded:
            at = 0
            for c in sequence:
                at = self.next[at][c]
                up = at
                while up > 0 and item not in held[up]:
                    held[up].add(item)
                    up = self.link[up]
        # A word row of a state ends with the rows of its links, so the shortest that is long enough has the most items.
        self.items: list[tuple[int, ...]] = []
        for state in range(len(self.next)):
            up = state
            while self.link[up] > 0 and self.length[self.link[up]] >= least:
                up = self.link[up]
            self.items.append(tuple(sorted(held[up])) if self.length[state] >= least else ())
        pairs = {a * len(self.code) + b for _, s in coded for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        if (there := self.next[last].get(c)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, c, there)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][c]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._clone(at, c, there)
        return new

    def _clone(self, at: int, c: int, there: int) -> int:
        copy = self._state(dict(self.next[there]), self.length[at] + 1, self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(c) == there:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def matches(self, sequence: list[int]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(position of the last word, longest match ending there, items), where that is long enough."""
        at = matched = 0
        for i, c in enumerate(sequence):
            while at and c not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if (to := self.next[at].get(c)) is not None:
                at, matched = to, matched + 1
            if matched >= self.least:
                yield i, matched, self.items[at]

    def scan(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        """(text, first word, last word, items) of the longest matches of many texts.

        Where two neighbouring words are neighbours in no item, no transition leads on and a match is at
        most one word long; so the automaton only walks the stretches between such places.
        """
        size = np.array([len(t) for t in texts])
        total = int(size.sum())
        if total < self.least or not len(self.pairs):
            return
        get = self.code.get
        code = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, total)
        text = np.repeat(np.arange(len(texts)), size)
        key = code[:-1] * len(self.code) + code[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        on = (self.pairs[at] == key) & (code[:-1] >= 0) & (code[1:] >= 0) & (text[:-1] == text[1:])
        edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.cumsum(size) - size
        for b, e in zip(begin, end):
            if e - b + 1 >= self.least:
                t = int(text[b])
                for i, matched, items in self.matches(code[b : e + 1].tolist()):
                    last = int(b + i - first[t])
                    yield t, last - matched + 1, last, items


def stretches(matches: Iterator[tuple[int, int, int, tuple[int, ...]]]) -> Iterator[tuple[int, int, int]]:
    """(text, first word, last word) of matches, those that overlap or follow each other as one."""
    text = first = last = -1
    for t, a, b, _ in matches:
        if t == text and a <= last + 1:
            first, last = min(first, a), max(last, b)
            continue
        if text >= 0:
            yield text, first, last
        text, first, last = t, a, b
    if text >= 0:
        yield text, first, last


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), DOCUMENTS):
            yield batch.iloc[k : k + DOCUMENTS]


def automata(items: pd.DataFrame, least: int, block_words: int = BLOCK_WORDS) -> list[Automaton]:
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    held = 0
    for item, text in zip(items["item_id"], items["text"]):
        ws = words(text)
        if held + len(ws) > block_words and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((int(item), ws))
        held += len(ws)
    return [Automaton(b, least) for b in blocks]


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each block of items: (doc_id, item_id) of all leaks, and (doc_id, first, last) of leaked word ranges.

    The item set is the stated query set: it is read on the driver, in blocks of ``block_words`` words, and each block's
    automaton is broadcast. The documents are streamed once a block, whole, without a shuffle. Items with fewer than
    ``least`` words and null or empty texts on either side have no leak.
    """
    spark = documents.sparkSession
    for automaton in automata(items.select("item_id", "text").where("item_id is not null").orderBy("item_id").toPandas(), least, block_words):
        shared = spark.sparkContext.broadcast(automaton)

        def found(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for rows in _slices(batches):
                docs = rows["doc_id"].to_numpy()
                hits = {(t, item) for t, _, _, items in shared.value.scan([words(x) for x in rows["text"]]) for item in items}
                yield pd.DataFrame([(docs[t], item) for t, item in sorted(hits)], columns=["doc_id", "item_id"])

        def spans(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for rows in _slices(batches):
                docs = rows["doc_id"].to_numpy()
                yield pd.DataFrame([(docs[t], a, b) for t, a, b in stretches(shared.value.scan([words(x) for x in rows["text"]]))], columns=["doc_id", "first", "last"])

        rows = documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0")
        yield rows.mapInPandas(found, "doc_id long, item_id long"), rows.mapInPandas(spans, "doc_id long, first long, last long")


def leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id of every document that holds at least 13 words in a row of an item, each pair once."""
    out = None
    for pairs, _ in leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items")):
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _cut(texts: pd.Series, firsts: pd.Series, lasts: pd.Series, share: float) -> pd.DataFrame:
    out = []
    for text, first, last in zip(texts, firsts, lasts):
        at, ends = [], []
        # Lowering may change a text's length, so words are found in the text as it stands, and counted as when lowered.
        for m in _WORD.finditer(text):
            n = len(words(m.group()))
            at += [m.start()] * n
            ends += [m.end()] * n
        leaked = np.zeros(len(at), bool)
        for a, b in zip(first, last):
            leaked[a : b + 1] = True
        part = leaked.mean() if len(at) else 0.0
        kept, begin = [], 0
        for k in np.flatnonzero(leaked & ~np.append(False, leaked[:-1])):
            stop = k
            while stop + 1 < len(at) and leaked[stop + 1]:
                stop += 1
            kept.append(text[begin : at[k]])
            begin = ends[stop]
        kept.append(text[begin:])
        drop = part > share
        out.append((len(at), int(leaked.sum()), "drop" if drop else "cut", None if drop else "".join(kept)))
    return pd.DataFrame(out, columns=["n_words", "n_leaked", "action", "clean"])


def cleaned(spark: SparkSession, folder: str, share: float = DROP_SHARE) -> DataFrame:
    """doc_id, n_words, n_leaked, action, clean of each document with a leak.

    ``cut``: clean is the text without the leaked stretches. ``drop``: they cover more than ``share`` of
    the words, and clean is null.
    """
    from pyspark.sql import functions as F

    documents = read(spark, folder, "documents")
    spans = None
    for _, part in leaks(documents, read(spark, folder, "eval_items")):
        spans = part if spans is None else spans.unionByName(part)
    # One row a stretch and block of items.
    ranges = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = _cut(rows["text"], rows["first"], rows["last"], share)
            yield pd.concat([rows[["doc_id"]].reset_index(drop=True), out], axis=1)

    joined = documents.select("doc_id", "text").join(ranges, "doc_id").select("doc_id", "text", F.col("r.first").alias("first"), F.col("r.last").alias("last"))
    return joined.mapInPandas(run, "doc_id long, n_words long, n_leaked long, action string, clean string")
