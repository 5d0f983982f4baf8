"""Keyword-stuffed and link-list fields, by mean pointwise mutual information and excessively repeated collocations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmesh.session import Scratch
from siftmesh.sources.tables import read

#: Words over which a word still stands beside itself, and over which a pair comes back.
WORD_SPAN, PAIR_SPAN = 4, 12
#: Times that a word stands beside itself in a field, at least, to be repeated; links and marks less.
TIMES = 4
#: Share of a field that lies within its repeated collocations.
COVERED = 0.72
#: Share of the arrows of a chain that close a pair which is there already.
CHAINED = 0.25
#: Words in a row without a sign between them that are enough to tell salad from a phrase, and the share of them that the corpus has often enough elsewhere.
RUN, OFTEN, KNOWN = 6, 3, 0.5
#: Mean positive information of the neighbours in such runs, below which they are salad; occurrences added to seen and to expected ones.
INCOHERENT, SMOOTH = 0.3, 1.0
#: Tokens of a chunk, whose distinct pairs ask for their counts together.
CHUNK_TOKENS = 100_000
#: Fields that are lists of words, so their neighbours need no coherence.
LISTS = ("keywords",)
#: Letters of a word that others may begin with, at least, first letters that stand for long words, and how many must begin so.
ROOT, LONG, ALIKE = 3, 5, 3

_TOKEN = re.compile(
    r"(?P<link>\[/?url[^\]]*\]?|<a\b[^>]*>?|</a>|https?:\S+|(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}(?:/[\w./-]*)?)"
    r"|(?P<mark>\#\w+|\[[^\]]*\]?|\b[^\W\d_]{2,4}-\d{3,}\b|-?\d+(?:[.,]\d+)?\s?(?:%|eur|usd|gbp|€|\$|£)|\bsize\s\w{1,3}\b)"
    r"|(?P<number>\d+(?:[.,:]\d+)*(?![^\W\d_]))|(?P<arrow>>>+|»)|(?P<word>[^\W_]+)|(?P<sign>[^\w\s'’-])"
)
_LINK, _MARK, _NUMBER, _ARROW = "<link>", "<mark>", "<number>", "<arrow>"
#: Texts without any of this are words and signs only.
_SPECIAL = re.compile(r"[\[<>#»%€$£\d]|\w\.\w|https?:|size\s")
_SIMPLE = re.compile(r"[^\W_]+|[^\w\s'’-]")


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Lowercased words of one root as that root, a kind in brackets for each link, product mark, number and arrow; and whether a sign stands before each."""
    low = text.lower()
    out: list[str] = []
    cut: list[bool] = []
    sign = False
    if not _SPECIAL.search(low):
        for t in _SIMPLE.findall(low):
            if t[0].isalnum():
                out.append(t)
                cut.append(sign)
                sign = False
            else:
                sign = True
    else:
        for m in _TOKEN.finditer(low):
            kind, value = m.lastgroup, m.group()
            if kind == "sign":
                sign = True
            elif kind != "link" or not value.startswith(("[/", "</")):
                out.append(value if kind == "word" else f"<{kind}>")
                cut.append(sign)
                sign = False
    return _rooted(out), cut


def _rooted(words: list[str]) -> list[str]:
    """Slightly varied words as one: those that begin with a shorter one of the field, or three long ones that begin alike."""
    distinct = {w for w in words if len(w) >= ROOT and w[0] != "<"}
    if len({w[:ROOT] for w in distinct}) == len(distinct):
        return words
    root: dict[str, str] = {}
    base = ""
    for w in sorted(distinct):
        if base and w.startswith(base):
            root[w] = base
        else:
            base = w
    alike = Counter(w[:LONG] for w in distinct if w not in root and len(w) > LONG)
    for w in distinct:
        if w not in root and len(w) > LONG and alike[w[:LONG]] >= ALIKE:
            root[w] = w[:LONG]
    return [root.get(w, w) for w in words]


class Chunk:
    """Tokens of many fields in flat arrays: what each position is, and the distinct words, self-neighbours and pairs.

    A word is its own neighbour if it comes back within ``WORD_SPAN`` words; a pair is two words that follow each other, whatever
    sign stands between them.
    """

    def __init__(self, size: np.ndarray, code: np.ndarray):
        self.size, self.code = size, code
        self.field = np.repeat(np.arange(len(size)), size)
        n = len(code)
        self.follows = np.flatnonzero(self.field[1:] == self.field[:-1]) if n else np.zeros(0, np.int64)
        self.words = int(code.max()) + 1 if n else 0
        # Occurrences of a word of a field in a row, then the next one of the same.
        self.order = np.lexsort((np.arange(n), code, self.field))
        f, c = self.field[self.order], code[self.order]
        self.first_word = np.append(True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])) if n else np.zeros(0, bool)
        again = np.flatnonzero(~self.first_word)
        self.back, self.ahead = self.order[again - 1], self.order[again]
        close = self.ahead - self.back <= WORD_SPAN
        self.back, self.ahead = self.back[close], self.ahead[close]
        self.selves, self.n_selves = np.unique(code[self.back], return_counts=True)
        pair = code[self.follows].astype(np.int64) * self.words + code[self.follows + 1]
        self.pairs, self.pair_at, self.n_pairs = np.unique(pair, return_inverse=True, return_counts=True)

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the chunk asks counts for, and its own: words (second key 0), words beside themselves (1), and pairs."""
        a, b = self.pairs // max(self.words, 1), self.pairs % max(self.words, 1)
        first = np.concatenate([hashes, hashes[self.selves], hashes[a]])
        second = np.concatenate([np.zeros(self.words, np.int64), np.ones(len(self.selves), np.int64), hashes[b]])
        return first, second, np.concatenate([np.bincount(self.code, minlength=self.words), self.n_selves, self.n_pairs])

    def scores(self, count: np.ndarray, total: float, pairs: float, cut: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each field: mean positive information of neighbours, share within repeated collocations, and whether it is salad.

        ``count``: the corpus's counts of :meth:`keys`; ``total``, ``pairs``: of all tokens and pairs; ``kinds``: of each word of the chunk.
        """
        fields, n = len(self.size), len(self.code)
        if not n:
            return np.full(fields, np.nan), np.zeros(fields), np.zeros(fields, bool)
        single, own_self, double = np.split(count.astype(np.float64), [self.words, self.words + len(self.selves)])
        covered = self._covered(single, own_self, double, total, pairs, kinds)
        # Information from all other fields: what a field says itself is no evidence for its neighbours.
        word_group = np.empty(n, np.int64)
        word_group[self.order] = np.cumsum(self.first_word) - 1
        outside = single[self.code] - np.bincount(word_group)[word_group]
        i = self.follows
        order = np.lexsort((self.pair_at, self.field[i]))
        p, f = self.pair_at[order], self.field[i][order]
        pair_group = np.empty(len(i), np.int64)
        pair_group[order] = np.cumsum(np.append(True, (p[1:] != p[:-1]) | (f[1:] != f[:-1]))) - 1 if len(i) else order
        seen = np.maximum(double[self.pair_at] - np.bincount(pair_group, minlength=1)[pair_group], 0)
        expected = outside[i] * outside[i + 1] / max(pairs, 1)
        positive = np.maximum(np.log((seen + SMOOTH) / (expected + SMOOTH)), 0)
        mean = lambda at, value: np.bincount(self.field[at], value, fields) / np.maximum(np.bincount(self.field[at], minlength=fields), 1)
        information = np.where(np.bincount(self.field[i], minlength=fields) > 0, mean(i, positive), np.nan)
        # Runs of words without a sign between them, as far as they are long enough to tell.
        run = np.cumsum(np.append(True, (self.field[1:] != self.field[:-1]) | cut[1:])) - 1
        long = np.bincount(run)[run] >= RUN
        inner = long[i] & (run[i] == run[i + 1])
        at = np.flatnonzero(long)
        familiar = mean(at, (outside[at] >= OFTEN).astype(float))
        salad = (np.bincount(self.field[i[inner]], minlength=fields) > 0) & (familiar >= KNOWN) & (mean(i[inner], positive[inner]) < INCOHERENT)
        return information, covered, salad

    def _covered(self, single: np.ndarray, own_self: np.ndarray, double: np.ndarray, total: float, pairs: float, kinds: np.ndarray) -> np.ndarray:
        """Share of each field between the first and the last of collocations that repeat without a gap; only those with positive information count."""
        fields, n = len(self.size), len(self.code)
        edge = np.zeros(n + 1, np.int64)
        # Words beside themselves.
        group = np.cumsum(self.first_word) - 1
        times = np.empty(n, np.int64)
        times[self.order] = np.bincount(group)[group]
        code = self.code[self.back]
        kind = kinds[code]
        chance = WORD_SPAN * single[code] ** 2 / max(total, 1)
        tied = own_self[np.searchsorted(self.selves, code)] > chance
        enough = times[self.back] >= np.where((kind == _LINK) | (kind == _MARK), 2, TIMES)
        keep = tied & enough & (kind != _NUMBER) & ((kind != _ARROW) | self._chained(kinds)[self.field[self.back]])
        np.add.at(edge, self.back[keep], 1)
        np.add.at(edge, self.ahead[keep] + 1, -1)
        # Pairs that come back.
        i = self.follows
        order = np.lexsort((i, self.pair_at, self.field[i]))
        i, p = i[order], self.pair_at[order]
        same = np.flatnonzero((p[1:] == p[:-1]) & (self.field[i[1:]] == self.field[i[:-1]]) & (i[1:] - i[:-1] <= PAIR_SPAN)) if len(i) else i
        a, b = self.code[i[same]], self.code[i[same] + 1]
        keep = (double[p[same]] * pairs > single[a] * single[b]) & (kinds[a] != _NUMBER) & (kinds[b] != _NUMBER)
        np.add.at(edge, i[same][keep], 1)
        np.add.at(edge, i[same + 1][keep] + 2, -1)
        inside = np.cumsum(edge)[:n] > 0
        return np.bincount(self.field, inside, fields) / np.maximum(self.size, 1)

    def _chained(self, kinds: np.ndarray) -> np.ndarray:
        """Whether the pairs that arrows close repeat in a field, so it is no path of different steps."""
        i = self.follows
        closing = i[kinds[self.code[i + 1]] == _ARROW]
        distinct = np.unique(self.field[closing] * np.int64(max(self.words, 1)) + self.code[closing]) // max(self.words, 1)
        arrows = np.bincount(self.field[closing], minlength=len(self.size))
        return arrows - np.bincount(distinct, minlength=len(self.size)) >= CHAINED * np.maximum(arrows, 1)


_CHUNK = ("chunk long, id array<long>, field array<string>, size array<int>, code array<int>, cut array<boolean>, kind array<string>, "
          "first array<long>, second array<long>, n array<long>")


def _hashed(words: np.ndarray) -> np.ndarray:
    h = pd.util.hash_array(words.astype(object), categorize=False).astype(np.int64)
    return np.where((h == 0) | (h == 1), 2, h)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    begun = TaskContext.get().partitionId() << 32

    def packed(number: int, ids: list, fields: list, size: list, flat: list, cut: list) -> pd.DataFrame:
        code, words = pd.factorize(np.array(flat, object))
        words = words.astype(str) if len(words) else np.zeros(0, object)
        kind = np.where(np.char.startswith(words.astype(str), "<"), words, "") if len(words) else np.zeros(0, object)
        first, second, n = Chunk(np.array(size, np.int64), code).keys(_hashed(words))
        return pd.DataFrame({"chunk": [begun + number], "id": [ids], "field": [fields], "size": [size], "code": [code.astype(np.int32)], "cut": [cut],
                             "kind": [kind.tolist()], "first": [first], "second": [second], "n": [n]})

    number, held = 0, ([], [], [], [], [])
    for batch in batches:
        for i, name, text in zip(batch["id"], batch["field"], batch["text"]):
            items, signs = tokens(text)
            held[0].append(i)
            held[1].append(name)
            held[2].append(len(items))
            held[3].extend(items)
            held[4].extend(signs)
            if len(held[3]) >= CHUNK_TOKENS:
                yield packed(number, *held)
                number, held = number + 1, ([], [], [], [], [])
    if held[0]:
        yield packed(number, *held)


def _judge(total: float, pairs: float, lists: tuple[str, ...]):
    def run(key: tuple, chunk: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        code, size = np.asarray(row["code"], np.int64), np.asarray(row["size"], np.int64)
        own = Chunk(size, code)
        count = np.zeros(own.words + len(own.selves) + len(own.pairs))
        count[counts["at"].to_numpy(np.int64)] = counts["total"]
        information, covered, salad = own.scores(count, total, pairs, np.asarray(row["cut"], bool), np.asarray(row["kind"], object))
        field = np.asarray(row["field"], object)
        salad &= ~np.isin(field, lists)
        kind = np.where(covered >= COVERED, "repeated", np.where(salad, "salad", None))
        return pd.DataFrame({"id": row["id"], "field": field, "pmi": information, "repeated": covered, "kind": kind})

    return run


def fields(pages: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """id, field, text: the fields that have a text."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("f")
    return pages.select("id", each).select("id", "f.field", "f.text").where(F.col("id").isNotNull() & (F.length("text") > 0))


def judged(texts: DataFrame, scratch: Scratch, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """``texts``: id, field, text. Result: id, field, pmi, repeated, kind (``repeated``, ``salad`` or null) of every field.

    Mutual information comes from the counts of all words and of all neighbouring pairs of the corpus, none left out. A
    field is ``repeated`` if at least ``COVERED`` of its words lie within collocations of positive information that come back
    without a gap: a word (or a word of its root, or a link, or a product mark) beside itself, or a pair. It is ``salad`` if the mean positive
    information of neighbours in its runs of words is under ``INCOHERENT``, although the words themselves are known well enough; fields in
    ``lists`` can't be, as different keywords need not belong together. Null texts must be left out; empty ones, and ones of
    signs only, have no words and no kind.

    The tokens of a chunk of fields are encoded once; each chunk asks for the counts of its distinct words and pairs, so a pair that is
    everywhere is asked for once a chunk and the answers of a chunk have a bound.
    """
    chunks = scratch.write(texts.select("id", "field", "text").mapInPandas(_chunks, _CHUNK), "chunks")
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("first", "second", "n")).alias("at", "k")).select("chunk", "at", "k.first", "k.second", "k.n")
    counts = scratch.write(asked.groupBy("first", "second").agg(F.sum("n").alias("total")), "counts")
    word, single = F.col("second") == 0, F.col("second") == 1
    sums = counts.agg(F.sum(F.when(word, F.col("total"))), F.sum(F.when(~word & ~single, F.col("total")))).first()
    answers = asked.drop("n").join(counts, ["first", "second"]).select(F.col("chunk").alias("asker"), "at", "total")
    rows = chunks.select("chunk", "id", "field", "size", "code", "cut", "kind")
    return rows.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInPandas(
        _judge(float(sums[0] or 0), float(sums[1] or 0), lists), "id long, field string, pmi double, repeated double, kind string"
    )


def _page_fields(spark: SparkSession, folder: str) -> DataFrame:
    return fields(read(spark, folder, "urlwords").withColumn("id", F.col("url_id")), ("title", "keywords", "description"))


def stuffed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """url_id of every page with a stuffed title, keywords or description."""
    each = judged(_page_fields(spark, folder), Scratch(spark, "stuffed"))
    return each.where(F.col("kind").isNotNull()).select(F.col("id").alias("url_id")).distinct()


def stuffing_report(spark: SparkSession, folder: str) -> DataFrame:
    """field, kind, n_fields, mean_pmi, mean_repeated; kind ``none`` for the rest."""
    each = judged(_page_fields(spark, folder), Scratch(spark, "stuffed"))
    return each.groupBy("field", F.coalesce("kind", F.lit("none")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_fields"), F.round(F.avg(F.nanvl("pmi", F.lit(None))), 4).alias("mean_pmi"), F.round(F.avg("repeated"), 4).alias("mean_repeated")
    )
