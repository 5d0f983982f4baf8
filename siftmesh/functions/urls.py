"""URLs: parts, escaping, resolution of links, sites and host labels, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/?#]*)(?::(\d+))?)?([^?#]*?)([^/?#]*)(\?[^#]*)?(?:#.*)?$"


def decompose(url: Column) -> Column:
    """struct scheme, user, password, host, port, path (up to the last slash), file, query. Missing parts are empty.

    The scheme and the host are lowercased; a URL whose host has a quote or a backslash is rejected (null).
    """
    names = ("scheme", "user", "password", "host", "port", "path", "file", "query")
    parts = {n: F.regexp_extract(url, _PARTS, i) for i, n in enumerate(names, 1)}
    parts["scheme"], parts["host"] = F.lower(parts["scheme"]), F.lower(parts["host"])
    parts["path"] = F.when((parts["path"] == "") & (parts["host"] != ""), "/").otherwise(parts["path"])
    return F.when(~parts["host"].rlike(r"['\\]"), F.struct(*[c.alias(n) for n, c in parts.items()]))


def site_of(url: Column) -> Column:
    """``scheme://host/`` with its port, if any."""
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)), F.lit("/"))


def labels(site: Column) -> Column:
    """Array of struct label, from_left, from_right of the host's labels, for joins on runs of labels."""
    parts = F.split(F.regexp_extract(site, r"^[a-zA-Z]+://([^/:]+)", 1), r"\.")
    return F.transform(parts, lambda p, i: F.struct(F.lower(p).alias("label"), i.cast("long").alias("from_left"), (F.size(parts) - 1 - i).cast("long").alias("from_right")))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` at the root is dropped, empty segments (``a//b``) stay."""
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/")
    last = F.element_at(segments, -1)
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    stacked = F.aggregate(
        F.slice(segments, 1, F.size(segments) - 1), F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept).when(s == "..", up(kept)).otherwise(F.array_append(kept, s)),
    )
    whole = F.array_append(F.when(last == "..", up(stacked)).otherwise(stacked), F.when(last.isin(".", ".."), "").otherwise(last))
    return F.concat(F.lit("/"), F.array_join(whole, "/"))


def resolve(base: Column, link: Column) -> Column:
    """The link as seen from the base: absolute, ``//host``, from the root, relative or a query; fragments are cut, dots resolved."""
    link = F.regexp_replace(F.trim(link), r"#.*$", "")
    b = decompose(base)
    root = F.concat(b["scheme"], F.lit("://"), F.when(b["user"] != "", F.concat(b["user"], F.when(b["password"] != "", F.concat(F.lit(":"), b["password"])).otherwise(""), F.lit("@"))).otherwise(""),
                    b["host"], F.when(b["port"] != "", F.concat(F.lit(":"), b["port"])).otherwise(""))
    path, query = F.regexp_extract(link, r"^([^?]*)", 1), F.regexp_extract(link, r"(\?.*)$", 1)

    def own(link: Column) -> Column:
        """A link with a host of its own."""
        host, rest = (F.regexp_extract(link, rf"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)({p})", 2 if p else 1) for p in ("", "[^?]*"))
        return F.concat(host, without_dots(rest), F.regexp_extract(link, r"(\?.*)$", 1))

    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), own(link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link == "", F.concat(root, b["path"], b["file"], b["query"]))
        .when(link.startswith("//"), own(F.concat(b["scheme"], F.lit(":"), link)))
        .when(link.startswith("?"), F.concat(root, b["path"], b["file"], link))
        .when(link.startswith("/"), F.concat(root, without_dots(path), query))
        .otherwise(F.concat(root, without_dots(F.concat(b["path"], path)), query))
    )


def escaped(text: Column) -> Column:
    """Percent escapes of everything but letters, digits and ``-_.~``."""
    out = F.url_encode(text)
    for sign, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """The reverse, where ``+`` is a space as in form data; a broken escape gives null."""
    return F.try_url_decode(text)


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def like_of(wildcards: Column) -> Column:
    """A LIKE pattern for ``*`` and ``?``, with LIKE's own signs escaped."""
    return F.translate(F.regexp_replace(wildcards, r"([\\%_])", r"\\$1"), "*?", "%_")


def prefixes(url: Column) -> Column:
    """The site and all directories of a URL, shortest first: what a longest-prefix join probes."""
    site = site_of(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    parts = F.split(path, "/")
    ends = F.sequence(F.lit(0), F.size(parts) - 1)
    return F.transform(ends, lambda n: F.when(n == 0, site).otherwise(F.concat(site, F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
