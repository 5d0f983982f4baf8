"""From a query's tree to one DataFrame plan, with exact weights."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmesh.plans.query_language import And, Empty, Forms, InSections, LinkTo, Or, Pattern, Phrase, Site, SiteSet, Stop, Word

EXACT = 0x8000


@dataclass
class Store:
    """What a query reads. postings: word, site_id, url_id, section, pos; or index: word, site_id, url_id, positions. sites: site_id, site.
    links: from_id, to_id. urls: url_id, site_id, url. dictionary: word. Only postings or index is always needed."""

    postings: DataFrame | None = None
    sites: DataFrame | None = None
    links: DataFrame | None = None
    urls: DataFrame | None = None
    index: DataFrame | None = None
    dictionary: DataFrame | None = None

    def where(self, condition: Column) -> Store:
        """The same store with a part of its documents."""
        return replace(self, postings=self.postings and self.postings.where(condition), index=self.index and self.index.where(condition))


#: Words that a pattern may match in the dictionary to be looked up by name; beyond it the index is read by the pattern's beginning.
NAMED = 1_000


def low(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask))


def word_weight(positions: Column, form: int, distance: bool = True) -> Column:
    """Weight of one word in a document, from its best section and the first position there.

    In the body only the form counts; in other sections the section (bits 13-14) and 13 bits that fall with the position, or are
    all set where ``distance`` doesn't count.
    """
    best = low(F.element_at(positions, -1), 0xC000)
    first = F.array_min(F.filter(positions, lambda p: low(p, 0xC000) == best))
    near = low(F.bitwise_not(first), 0x1FFF) if distance else F.lit(0x1FFF)
    return F.when(best == 0, F.lit(form)).otherwise(F.lit(form).bitwiseOR(F.shiftright(best, 1)).bitwiseOR(near)).cast("int")


def _one_longer(before: Column, gap: int):
    """A position with the length of the run that ends there: one more than the run that ended ``gap`` before it."""

    def step(p: Column) -> Column:
        prior = F.filter(before, lambda s: (s["p"] + gap == p) & (low(s["p"], 0xC000) == low(p, 0xC000)))
        return F.struct(p.alias("p"), (F.lit(1) + F.coalesce(F.get(prior, F.lit(0))["n"], F.lit(0))).alias("n"))

    return step


def _back(offset: int):
    return lambda p: p - offset


def _runs(lists: list[Column], gaps: list[int]) -> Column:
    """Of each list of positions: the longest run of neighbouring terms that ends there, as an array of ints."""
    ended = F.transform(lists[0], lambda p: F.struct(p.alias("p"), F.lit(1).alias("n")))
    longest = [F.lit(1)]
    for own, gap in zip(lists[1:], gaps[1:]):
        ended = F.transform(own, _one_longer(ended, gap))
        longest.append(F.array_max(F.transform(ended, lambda s: s["n"])))
    return F.array(*longest)


def _run_weight(lists: list[Column], gaps: list[int]) -> Column:
    n = len(lists)
    smallest = F.least(*[F.element_at(p, -1) for p in lists])
    runs = _runs(lists, gaps)
    longest, ends = F.array_max(runs), F.size(F.filter(runs, lambda x: x >= 2))
    near = F.when(longest == n, 0x1800).when(ends > 1, 0x1000).otherwise(F.shiftleft(ends, 11))
    return F.shiftright(low(smallest, 0xC000), 1).bitwiseOR(near).bitwiseOR(low(F.bitwise_not(smallest), 0x7FF))


def and_weight(parts: list[tuple[Column, Column, bool]], gaps: list[int]) -> Column:
    """``parts``: weight, positions, has positions. Pieces of neighbours with positions are weighed by their runs; the least piece counts."""
    form = reduce(lambda a, b: a.bitwiseAND(b), [w for w, _, _ in parts]).bitwiseAND(F.lit(EXACT))
    pieces: list[list[int]] = []
    least: list[Column] = []
    run: list[int] = []
    for i, (weight, _, positioned) in enumerate(parts):
        if positioned:
            run.append(i)
            continue
        least.append(low(weight, 0x7FFF))
        pieces.append(run)
        run = []
    pieces.append(run)
    for piece in pieces:
        if len(piece) == 1:
            least.append(low(parts[piece[0]][0], 0x7FFF))
        elif piece:
            least.append(_run_weight([parts[i][1] for i in piece], [gaps[i] for i in piece]))
    return (F.least(*least) if len(least) > 1 else least[0]).bitwiseOR(form).cast("int")


def phrase_weight(start: Column) -> Column:
    return F.when(low(start, 0xC000) != 0, start.bitwiseXOR(F.lit(0x3FFF))).otherwise(F.lit(0x3000)).cast("int")


@dataclass
class Hit:
    """A node in a document's row: whether it matches, its weight, and its positions (None if the node has none)."""

    present: Column
    weight: Column
    positions: Column | None


class Compiler:
    """Evaluates a tree within one row a document.

    The postings of all the query's words are filtered, then gathered by document in one aggregate, each word's (or
    pattern's) positions in a column of its own. Boolean terms, phrases, sections and weights are expressions over these columns, so a
    query is one scan and one shuffle, whatever its tree; only site filters add a join with the site ids that match.
    """

    def __init__(self, store: Store, tree, distance: bool = True):
        self.store, self.distance = store, distance
        self.columns: dict[tuple[str, str], str] = {}
        self.filters: list[DataFrame] = []
        self.tree = tree

    def _column(self, kind: str, text: str) -> Column:
        return F.col(self.columns.setdefault((kind, text), f"c{len(self.columns)}"))

    def run(self) -> DataFrame:
        hit = self.node(self.tree, 15, EXACT)
        wanted, gathered = F.lit(False), []
        plain = [text for kind, text in self.columns if kind == "word"]
        if plain:
            wanted = F.col("word").isin(plain)
        stored = self.store.index is not None
        for (kind, text), name in self.columns.items():
            if kind == "word":
                own, value = F.col("word") == text, F.col("positions" if stored else "pos")
            else:
                own, value = F.col("word").like(text), F.transform("positions", lambda p: F.struct("word", p.alias("pos"))) if stored else F.struct("word", "pos")
                wanted = wanted | self._named(text)
            found = F.collect_list(F.when(own, value))
            found = F.flatten(found) if stored else found
            gathered.append((F.sort_array(found) if kind == "word" else found).alias(name))
        if not gathered:
            wanted, gathered = F.lit(False), [F.count("word").alias("c")]
        rows = (self.store.index if stored else self.store.postings).where(wanted).groupBy("url_id", "site_id").agg(*gathered)
        for i, ids in enumerate(self.filters):
            rows = rows.join(ids.select("site_id", F.lit(True).alias(f"f{i}")), "site_id", "left")
        return rows.where(hit.present).select("url_id", "site_id", hit.weight.cast("int").alias("wp"))

    def _named(self, like: str) -> Column:
        """The words of a pattern by name, as the dictionary has them, if they are few; else all that begin alike and match."""
        begin = re.match(r"(?:[^\\%_]|\\.)*", like).group().replace("\\", "")
        matching = F.col("word").startswith(begin) & F.col("word").like(like)
        if self.store.dictionary is None:
            return matching
        words = [r["word"] for r in self.store.dictionary.where(matching).select("word").take(NAMED + 1)]
        return matching if len(words) > NAMED else F.col("word").isin(words) if words else F.lit(False)

    def _word(self, positions: Column, form: int) -> Hit:
        present = F.size(positions) > 0
        return Hit(present, F.when(present, word_weight(positions, form, self.distance)), positions)

    @staticmethod
    def _within(positions: Column, mask: int) -> Column:
        sections = [s for s in range(4) if mask >> s & 1]
        return positions if len(sections) == 4 else F.filter(positions, lambda p: F.shiftright(p, 14).isin(sections))

    def node(self, tree, mask: int, form: int) -> Hit:
        match tree:
            case Word(word):
                return self._word(self._within(self._column("word", word), mask), form)
            case Pattern(like, _):
                return self._pattern(self._column("like", like), mask, form)
            case Forms(exact, others):
                each = [self._word(self._within(self._column("word", w), mask), form if w == exact or not exact else 0) for w in [exact, *others] if w]
                return self._either(each)
            case Or(terms):
                return self._either([self.node(t, mask, form) for t in terms])
            case InSections(term, inner):
                # Sections given by a prefix replace the mask as a whole, and with it the bit of exact forms.
                return self.node(term, inner, 0)
            case Phrase(terms, offsets):
                return self._phrase([self.node(t, mask, form) for t in terms], offsets)
            case And():
                return self._all(tree, mask, form)
            case Empty() | Stop():
                return Hit(F.lit(False), F.lit(0), None)
        raise TypeError(tree)

    def _pattern(self, found: Column, mask: int, form: int) -> Hit:
        """Each matching word has its own weight, the best one counts; positions count once."""
        sections = [s for s in range(4) if mask >> s & 1]
        found = F.filter(found, lambda x: F.shiftright(x["pos"], 14).isin(sections))
        words = F.array_distinct(F.transform(found, lambda x: x["word"]))

        def weight(word: Column) -> Column:
            return low(word_weight(F.sort_array(F.transform(F.filter(found, lambda x: x["word"] == word), lambda x: x["pos"])), form, self.distance), 0x7FFF)

        best = F.array_max(F.transform(words, weight)).bitwiseOR(F.lit(form))
        return Hit(F.size(found) > 0, best, F.sort_array(F.array_distinct(F.transform(found, lambda x: x["pos"]))))

    @staticmethod
    def _either(each: list[Hit]) -> Hit:
        present = reduce(lambda a, b: a | b, [h.present for h in each])
        weights = [F.when(h.present, low(h.weight, 0x7FFF)) for h in each]
        forms = [F.when(h.present, low(h.weight, EXACT)).otherwise(0) for h in each]
        weight = (F.greatest(*weights) if len(each) > 1 else weights[0]).bitwiseOR(reduce(lambda a, b: a.bitwiseOR(b), forms))
        positions = None
        if all(h.positions is not None for h in each):
            positions = F.sort_array(F.concat(*[h.positions for h in each]))
        return Hit(present, weight, positions)

    @staticmethod
    def _phrase(each: list[Hit], offsets: tuple[int, ...]) -> Hit:
        starts = each[0].positions
        for h, offset in zip(each[1:], offsets[1:]):
            starts = F.array_intersect(starts, F.transform(h.positions, _back(offset)))
        last = offsets[-1]
        start = F.array_max(F.filter(starts, lambda p: low(p, 0xC000) == low(p + last, 0xC000)))
        return Hit(start.isNotNull(), phrase_weight(start), None)

    def _all(self, tree: And, mask: int, form: int) -> Hit:
        each = [self.node(t, mask, form) for t in tree.terms]
        present = reduce(lambda a, b: a & b, [h.present for h in each])
        weight, positions = each[0].weight, each[0].positions
        if len(each) > 1:
            weight, positions = and_weight([(h.weight, h.positions, h.positions is not None) for h in each], list(tree.gaps)), None
        for term in tree.without:
            present = present & ~self.node(term, mask, form).present
        for site in tree.sites:
            self.filters.append(self._matching(site))
            inside = F.coalesce(F.col(f"f{len(self.filters) - 1}"), F.lit(False))
            present = present & (inside if site.include else ~inside)
        return Hit(present, F.when(present, weight), positions)

    def _matching(self, site: Site | SiteSet) -> DataFrame:
        hosts = [s.host for s in (site.sites if isinstance(site, SiteSet) else [site])]
        wanted = reduce(lambda a, b: a | b, [host_matches(F.col("site"), h) for h in hosts])
        return self.store.sites.where(wanted).select("site_id").distinct()


def links_to(store: Store, url: str) -> DataFrame:
    """url_id, site_id, wp (0) of the documents that link to a URL."""
    target = store.urls.where(url_is(F.col("url"), url)).agg(F.min("url_id").alias("to_id"))
    to = store.links.join(F.broadcast(target), "to_id", "left_semi").select(F.col("from_id").alias("url_id")).distinct()
    out = to.join(store.urls.select("url_id", F.coalesce("site_id", F.lit(0).cast("long")).alias("site_id")), "url_id")
    return out.select("url_id", "site_id", F.lit(0).alias("wp"))


def host_matches(site: Column, pattern: str) -> Column:
    """The labels of the pattern stand in a row, in order, anywhere in the site's host; labels over 32 letters don't count."""
    labels = [p for p in pattern.lower().split(".") if p and len(p) <= 32]
    host = F.concat(F.lit("."), F.lower(F.regexp_extract(site, r"^[a-zA-Z]+://([^/:]+)", 1)), F.lit("."))
    return F.contains(host, F.lit("." + ".".join(labels) + "."))


def url_is(url: Column, asked: str) -> Column:
    """The URL, with ``http://`` where no scheme is given, and with a slash where it ends without."""
    full = asked if "://" in asked else f"http://{asked}"
    return url.isin([full] if full.endswith("/") else [full, full + "/"])


def evaluate(tree, store: Store, distance: bool = True) -> DataFrame:
    """url_id, site_id, wp of every document that matches. Without ``distance`` the place of a word in its section doesn't count."""
    return links_to(store, tree.url) if isinstance(tree, LinkTo) else Compiler(store, tree, distance).run()
