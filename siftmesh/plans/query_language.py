"""The query language: lexer, recursive descent, tree, errors and normal form."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Literal characters that a pattern needs before its first wildcard.
MIN_PATTERN = 6
MAX_WORD = 32
#: Section prefixes and their bits.
SECTION_BITS = {"body:": 1, "desc:": 2, "keywords:": 4, "title:": 8}
ALL_SECTIONS = 15


class QueryError(ValueError):
    """code: stopwords, extrasymbol, emptyquery, tooshort, noquoted, noparenthesis."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Stop:
    pass


@dataclass(frozen=True)
class Word:
    word: str


@dataclass(frozen=True)
class Forms:
    exact: str
    others: tuple[str, ...]


@dataclass(frozen=True)
class Pattern:
    like: str
    text: str


@dataclass(frozen=True)
class Site:
    host: str
    include: bool = True


@dataclass(frozen=True)
class SiteSet:
    """Sites of an OR in parentheses."""

    sites: tuple[Site, ...]
    include: bool = True


@dataclass(frozen=True)
class LinkTo:
    url: str


@dataclass(frozen=True)
class And:
    terms: tuple
    gaps: tuple[int, ...]  # distance of each term to the one before; stopwords between them add one each
    without: tuple = ()
    sites: tuple = ()


@dataclass(frozen=True)
class Or:
    terms: tuple


@dataclass(frozen=True)
class Phrase:
    terms: tuple
    offsets: tuple[int, ...]


@dataclass(frozen=True)
class InSections:
    term: object
    mask: int


@dataclass
class Vocabulary:
    """What the parser asks of the index: is a word known, stopped, and which other forms has it."""

    known: set[str] | None = None
    stop: set[str] = field(default_factory=set)
    forms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def has(self, word: str) -> bool:
        return self.known is None or word in self.known


@dataclass
class Parsed:
    tree: object
    complexity: int
    words: tuple[str, ...]


def _lex(text: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, value, delimiter before, delimiter after). Kinds: word, key, quote, open, close, or, plus, minus."""
    out: list[list] = []
    i, gap = 0, True
    while i < len(text):
        c = text[i]
        if ord(c) < 32 and c not in "\t\n\r":
            raise QueryError("extrasymbol")
        if c.isalnum() or c in "$*?":
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] in "$*?"):
                j += 1
            value = text[i:j]
            if j < len(text) and text[j] == ":" and value + ":" in (*SECTION_BITS, "site:", "link:"):
                out.append(["key", value + ":", gap, False])
                i, gap = j + 1, False
                if value == "site":
                    while i < len(text) and text[i].isspace():
                        i += 1
                    j = i
                    while j < len(text) and (text[j].isalnum() or text[j] in ".-_"):
                        j += 1
                    out.append(["word", text[i:j], True, False])
                    i = j
                elif value == "link":
                    out.append(["word", text[i:].strip(), True, False])
                    i = len(text)
                continue
            out.append(["word", value, gap, False])
            i, gap = j, False
        elif c in '"()|+-':
            kind = {'"': "quote", "(": "open", ")": "close", "|": "or", "+": "plus", "-": "minus"}[c]
            after = i + 1 >= len(text) or text[i + 1].isspace()
            out.append([kind, c, gap, after])
            i += 1
            gap = c in '("|'
        else:
            if out:
                out[-1][3] = True
            i, gap = i + 1, True
    return [tuple(x) for x in out]


class _Parser:
    def __init__(self, text: str, vocabulary: Vocabulary):
        self.items, self.at, self.v = _lex(text), 0, vocabulary
        self.complexity = 0
        self.words: list[str] = []

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else ("end", "", True, True)

    def take(self):
        item = self.peek()
        self.at += 1
        return item

    def start(self) -> Parsed:
        if self.peek()[:2] == ("key", "link:"):
            self.take()
            tree = LinkTo(self.take()[1])
        else:
            tree = self.either()
            if self.peek()[0] == "close":
                raise QueryError("noparenthesis")
            if self.peek()[0] != "end":
                raise QueryError("extrasymbol" if tree is not None else "emptyquery")
        if tree is None:
            raise QueryError("emptyquery")
        if isinstance(tree, (Stop, Site, SiteSet)):
            raise QueryError("stopwords")
        return Parsed(tree, self.complexity, tuple(dict.fromkeys(self.words)))

    def is_or(self) -> bool:
        return self.peek()[0] == "or" or self.peek()[:2] == ("word", "OR")

    def either(self):
        terms = []
        if (first := self.all_of()) is None:
            return None
        terms.append(first)
        while self.is_or():
            self.complexity |= 2
            self.take()
            if (more := self.all_of()) is None:
                raise QueryError("emptyquery")
            terms.append(more)
        return join_or(terms)

    def all_of(self):
        first = self.term()
        if first is None:
            return None
        terms: list[tuple[object, bool]] = [(first, False)]
        while True:
            if self.peek()[:2] == ("word", "AND") or self.peek()[0] == "plus":
                self.complexity |= 2
                self.take()
            minus = self.peek()
            negative = minus[0] == "minus" and minus[2] and not minus[3]
            if minus[0] == "minus":
                self.take()
                if negative:
                    self.complexity |= 2
            if self.is_or() or (more := self.term()) is None:
                break
            terms.append((more, negative))
        return join_and(terms)

    def term(self):
        mask = 0
        while self.peek()[0] == "key" and self.peek()[1] in SECTION_BITS:
            mask |= SECTION_BITS[self.take()[1]]
        inner = self.plain()
        if mask in (0, ALL_SECTIONS) or inner is None or isinstance(inner, (Site, SiteSet, Empty, Stop)):
            return inner
        return InSections(inner, mask)

    def plain(self):
        kind, value, *_ = self.peek()
        if kind == "word":
            if value in ("AND", "OR"):
                return None
            self.take()
            return self.word(value)
        if kind == "key" and value == "site:":
            self.take()
            return Site(self.take()[1].lower())
        if kind == "quote":
            return self.phrase()
        if kind == "open":
            self.take()
            inner = self.either()
            if self.take()[0] != "close":
                raise QueryError("noparenthesis")
            return inner
        return None

    def phrase(self):
        self.take()
        terms = []
        while self.peek()[0] not in ("quote", "end"):
            if self.peek()[0] in ("minus", "plus"):
                self.take()
                continue
            terms.append(self.phrase_or())
        if self.take()[0] != "quote":
            raise QueryError("noquoted")
        return join_phrase(terms)

    def phrase_or(self):
        terms = [self.phrase_term()]
        while self.peek()[0] == "or" or self.peek()[:2] == ("word", "OR"):
            self.complexity |= 1
            self.take()
            terms.append(self.phrase_term())
        return join_or(terms)

    def phrase_term(self):
        kind, value, *_ = self.take()
        if kind == "word":
            return self.word(value)
        if kind == "open":
            inner = self.phrase_or()
            if self.take()[0] != "close":
                raise QueryError("noparenthesis")
            return inner
        raise QueryError("extrasymbol")

    def word(self, value: str):
        word = value.lower()
        if word == "*" or word in self.v.stop:
            return Stop()
        if len(word) > MAX_WORD:
            return Empty()
        self.words.append(word)
        if "*" in word or "?" in word:
            fixed = min(word.find(c) for c in "*?" if c in word)
            if fixed < MIN_PATTERN:
                raise QueryError("tooshort")
            like = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
            return Pattern(like, word)
        others = tuple(w for w in self.v.forms.get(word, ()) if w != word and self.v.has(w))
        if others:
            return Forms(word if self.v.has(word) else "", others)
        return Word(word) if self.v.has(word) else Empty()


def join_or(terms: list):
    kept = list(dict.fromkeys(t for t in terms if not isinstance(t, (Empty, Stop))))
    if kept and all(isinstance(t, (Site, SiteSet)) for t in kept):
        return kept[0] if len(kept) == 1 else SiteSet(tuple(kept))
    kept = [t for t in kept if not isinstance(t, (Site, SiteSet))]
    if not kept:
        return Stop() if any(isinstance(t, (Stop, Site, SiteSet)) for t in terms) else Empty()
    return kept[0] if len(kept) == 1 else Or(tuple(kept))


def join_and(terms: list[tuple[object, bool]]):
    plus, gaps, minus, sites = [], [], [], []
    gap, stopped = 1, False
    for term, negative in terms:
        if isinstance(term, (Site, SiteSet)):
            flipped = type(term)(*(getattr(term, f) for f in term.__dataclass_fields__ if f != "include"), include=term.include != negative)
            sites.append(flipped)
            gap += 1
        elif isinstance(term, Stop):
            if not negative:
                gap, stopped = gap + 1, True
        elif negative:
            if not isinstance(term, Empty):
                minus.append(term)
        else:
            if isinstance(term, Empty):
                return Empty()
            plus.append(term)
            gaps.append(gap)
            gap = 1
    if not plus:
        if minus:
            raise QueryError("emptyquery")
        return sites[0] if len(terms) == 1 and sites else Stop() if stopped or sites else Empty()
    if len(plus) == 1 and not minus and not sites:
        return plus[0]
    return And(tuple(plus), tuple(gaps), tuple(minus), tuple(sites))


def join_phrase(terms: list):
    if any(isinstance(t, Empty) for t in terms):
        return Empty()
    kept = [(i, t) for i, t in enumerate(terms) if not isinstance(t, Stop)]
    if not kept:
        return Stop() if terms else Empty()
    if len(kept) == 1:
        return kept[0][1]
    return Phrase(tuple(t for _, t in kept), tuple(i - kept[0][0] for i, _ in kept))


def parse(text: str, vocabulary: Vocabulary | None = None) -> Parsed:
    """The tree of a query. Raises :class:`QueryError`.

    Empty and stopped terms are folded away: AND with an empty term is empty, OR drops empty ones, groups of one collapse.
    A stopword inside AND or a phrase leaves a gap of one position. A single ``site:`` is no query, and neither is a
    leading ``-term``.
    """
    return _Parser(text, vocabulary or Vocabulary()).start()


def normal(tree) -> str:
    """The canonical text of a tree, the same for queries that differ in case, blanks or repeated alternatives."""
    match tree:
        case Word(w):
            return w
        case Forms(exact, others):
            return f"{{{'|'.join([exact, *others])}}}"
        case Pattern(_, text):
            return text
        case Site(host, include):
            return f"{'' if include else '-'}site:{host}"
        case SiteSet(sites, include):
            return f"{'' if include else '-'}({' | '.join(map(normal, sites))})"
        case LinkTo(url):
            return f"link:{url}"
        case And(terms, gaps, without, sites):
            out = " & ".join(("* " * (g - 1) if i else "") + normal(t) for i, (t, g) in enumerate(zip(terms, gaps)))
            return "(" + " ".join([out, *(f"-{normal(t)}" for t in without), *map(normal, sites)]) + ")"
        case Or(terms):
            return f"({' | '.join(sorted(map(normal, terms)))})"
        case Phrase(terms, offsets):
            return '"' + " ".join(f"{normal(t)}@{o}" for t, o in zip(terms, offsets)) + '"'
        case InSections(term, mask):
            return f"{mask}:{normal(term)}"
        case Empty():
            return "#"
    return "*"


def leaves(tree) -> list:
    """The words, forms and patterns of a tree."""
    match tree:
        case Word() | Forms() | Pattern():
            return [tree]
        case And(terms, _, without, _):
            return [x for t in (*terms, *without) for x in leaves(t)]
        case Or(terms) | Phrase(terms, _):
            return [x for t in terms for x in leaves(t)]
        case InSections(term, _):
            return leaves(term)
    return []
