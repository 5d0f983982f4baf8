"""HTML to sections, links and directives: one tolerant scanner, run over Arrow batches."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords and description that are taken, letters of the stored fields.
KEYWORD_BYTES, DESCRIPTION_BYTES = 254, 99
STORED = {"title": 128, "txt": 255, "keywords": 255, "description": 100}
_SITE = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]*")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|<[!?]((?:--.*?(?:-->|$))|[^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_ENTITY = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);?")
#: Pairs of comments between which text isn't indexed.
_SKIPS = (("noindex", "/noindex"), ("udmcomment", "/udmcomment"), ("htdig_noindex", "/htdig_noindex"))
#: Font sizes of headings, and the size of plain text.
_HEADINGS, PLAIN = {f"h{i}": 7 - i for i in range(1, 7)}, 3
_LINK_AT = {"a": "href", "area": "href", "link": "href", "frame": "src", "iframe": "src", "img": "src"}


def joined(base: str, link: str) -> str:
    """The link as seen from the base, whatever the scheme of the base; scheme and host of the base in lower case."""
    site = _SITE.match(base)
    if not site:
        return urljoin(base, link)
    base = site.group().lower() + base[site.end() :]
    scheme = site.group(1).lower()
    # The library resolves links for schemes that it knows.
    found = urljoin("http" + base[len(scheme) :], link)
    own = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", link)
    return found if own or not found.startswith("http:") else scheme + found[4:]


def entities(text: str) -> str:
    """Named and numbered entities, with or without ``;``. Unknown ones stay as they are."""

    def one(m: re.Match) -> str:
        name = m.group(1)
        if name[0] == "#":
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""
        return _html.entities.html5.get(name + ";", m.group())

    return _ENTITY.sub(one, text)


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", entities(text).replace("'", "`")).strip()


def parse(page: str | None, url: str = "") -> dict:
    """title, keywords, description, body, txt (body text inside <body>), large, links, index, follow, base.

    ``large`` is the body text in a font above that of plain text (headings, ``font``, ``big``), which may weigh more.

    Scripts and styles are skipped up to their end tag, marked comments switch indexing off and on, broken quotes and missing
    end tags are tolerated. ``noindex`` drops all words, ``nofollow`` all links. Null and empty pages give empty parts.
    """
    text = page or ""
    out = {"title": "", "keywords": "", "description": "", "index": True, "follow": True, "base": url}
    body, inside, large, links = [], [], [], []
    plain, fonts = PLAIN, []
    in_title = in_body = False
    skipped: set[str] = set()
    title: list[str] = []
    at = 0

    def words(piece: str) -> None:
        if not piece or skipped:
            return
        if in_title:
            title.append(piece)
            return
        body.append(piece)
        if in_body:
            inside.append(piece)
        if fonts and fonts[-1][1] > plain:
            large.append(piece)

    while at < len(text):
        m = _TAG.search(text, at)
        if m is None:
            words(text[at:])
            break
        words(text[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            comment = (m.group(4) or "").removeprefix("--").removesuffix("-->").strip().lower()
            for on, off in _SKIPS:
                if comment == on:
                    skipped.add(on)
                elif comment == off:
                    skipped.discard(on)
            continue
        name, closing = m.group(2).lower(), m.group(1) == "/"
        if name in ("script", "style") and not closing:
            end = re.compile(rf"</{name}", re.I).search(text, at)
            at = len(text) if end is None else text.find(">", end.start()) + 1 or len(text)
            continue
        if name == "title":
            in_title = not closing
        elif name == "body":
            in_body = not closing
        if closing:
            words(" ")
            if any(n == name for n, _ in fonts):
                while fonts.pop()[0] != name:
                    pass
            continue
        given = {k.lower(): entities((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(m.group(3) or "")}
        if name == "meta":
            _meta(given, out, links)
        elif name == "base" and given.get("href"):
            out["base"] = joined(url, given["href"])
        elif name == "basefont":
            plain = _size(given.get("size", ""), PLAIN)
        elif name in _HEADINGS:
            fonts.append((name, _HEADINGS[name]))
        elif name in ("font", "big", "small"):
            now = fonts[-1][1] if fonts else plain
            fonts.append((name, _size(given.get("size", ""), now) if name == "font" else now + (1 if name == "big" else -1)))
        elif name in _LINK_AT and given.get(_LINK_AT[name]):
            links.append(given[_LINK_AT[name]])
        words(" ")
    out["title"] = _plain("".join(title))
    out["body"], out["txt"], out["large"] = _plain("".join(body)), _plain("".join(inside))[: STORED["txt"]], _plain("".join(large))
    if not out["index"]:
        out |= {"title": "", "keywords": "", "description": "", "body": "", "txt": "", "large": ""}
    absolute = (urldefrag(joined(out["base"], link.strip()))[0] for link in links) if out["follow"] else ()
    out["links"] = [link for link in dict.fromkeys(absolute) if link and link != url]
    return out


def _size(text: str, now: int) -> int:
    """A font size, absolute or relative to the plain one; the present one if it can't be read."""
    if not (m := re.fullmatch(r"\s*([+-]?)(\d)\s*", text)):
        return now
    return int(m.group(2)) if not m.group(1) else PLAIN + int(m.group(1) + m.group(2))


def _cut(text: str, size: int) -> str:
    return text.encode()[:size].decode(errors="ignore")


def _meta(given: dict[str, str], out: dict, links: list[str]) -> None:
    name, content = given.get("name", given.get("http-equiv", "")).lower(), given.get("content", "")
    if name == "keywords":
        out["keywords"] = _plain(_cut(content, KEYWORD_BYTES))
    elif name == "description":
        out["description"] = _plain(_cut(content, DESCRIPTION_BYTES))
    elif name == "robots":
        flags = set(re.split(r"[\s,]+", content.lower()))
        out["index"] = not flags & {"noindex", "none"} and (out["index"] or bool(flags & {"index", "all"}))
        out["follow"] = not flags & {"nofollow", "none"} and (out["follow"] or bool(flags & {"follow", "all"}))
    elif name == "refresh" and (m := re.search(r"url\s*=\s*(\S+)", content, re.I)):
        links.append(m.group(1))


def parsed(pages: DataFrame, key: str = "url_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, title, keywords, description, body, txt, large, links, index, follow of HTML pages. No shuffle."""
    fields = ["title", "keywords", "description", "body", "txt", "large", "links", "index", "follow"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse(p, u or "") for p, u in zip(batch[page], batch[url])]
            yield pd.DataFrame({key: batch[key], **{f: [r[f] for r in rows] for f in fields}})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, page).mapInPandas(
        run, f"{key} {kind}, title string, keywords string, description string, body string, txt string, large string, links array<string>, index boolean, follow boolean"
    )



def converted(pages: DataFrame, converters: dict[str, Callable[[bytes], str]], key: str = "url_id", kind: str = "content_type", data: str = "data") -> DataFrame:
    """key, text of documents (binary ``data``) by a function for their type; types without one have null.

    The hook for formats that need a converter of their own. The functions travel with the plan.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [converters[k](d) if k in converters and d is not None else None for k, d in zip(batch[kind], batch[data])]
            yield pd.DataFrame({key: batch[key], "text": done})

    return pages.select(key, kind, data).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` with title, txt, keywords and description cut to the letters that an index keeps of them."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in STORED.items() if c in rows.columns})
