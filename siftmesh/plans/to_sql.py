"""The same trees as ANSI SQL over row-wise positions: what the DataFrame plans are checked against."""

from __future__ import annotations

from siftmesh.functions.text import stopwords
from siftmesh.plans.query_language import And, Empty, Forms, InSections, LinkTo, Or, Pattern, Phrase, SiteSet, Stop, Word

URLS = """u AS (SELECT url_id, min(seen_at) AS first_seen, coalesce(min(site_id), 0) AS site_id, min(url) AS url, min(status) AS status, max(deleted) AS deleted, min(crc) AS crc,
  min(origin) AS origin, min(redir) AS redir, min(referrer) AS referrer, min(hops) AS hops, min(tag) AS tag, min(next_index_time) AS next_index_time, min(last_index_time) AS last_index_time,
  min(last_modified) AS last_modified FROM urlword WHERE url_id IS NOT NULL GROUP BY url_id),
page AS (SELECT DISTINCT ON (url_id) * FROM urlwords WHERE url_id IS NOT NULL),
doc AS (SELECT page.*, u.site_id, u.url, u.status, u.crc FROM page JOIN u USING (url_id) WHERE u.deleted = 0)"""

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}0-9]+')"


def _section(column: str, section: int) -> str:
    return f"SELECT url_id, site_id, {section} AS section, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT url_id, site_id, {_WORDS.format(column)} AS w FROM doc)"


def postings(stop: list[str] | None = None) -> str:
    listed = ", ".join(f"'{w}'" for w in (stopwords("en") if stop is None else stop))
    parts = " UNION ALL ".join(_section(c, s) for c, s in (("title", 3), ("keywords", 2), ("description", 1), ("txt", 0)))
    where = "length(word) <= 32" + (f" AND word NOT IN ({listed})" if listed else "")
    return f"{URLS},\npostings AS (SELECT word, site_id, url_id, section, section * 16384 + p % 16384 AS pos FROM ({parts}) WHERE {where})"


class Sql:
    def __init__(self, distance: bool = True):
        self.distance = distance
        self.ctes: list[str] = []
        self.n = 0

    def add(self, body: str) -> str:
        self.n += 1
        self.ctes.append(f"n{self.n} AS ({body})")
        return f"n{self.n}"

    def _weigh(self, pos: str, form: int, keys: str = "url_id, site_id") -> str:
        best = f"SELECT {keys}, max(pos) // 16384 * 16384 AS best FROM {pos} GROUP BY ALL"
        first = f"SELECT {keys}, best, min(pos) AS first FROM {pos} JOIN ({best}) USING ({keys}) WHERE pos // 16384 * 16384 = best GROUP BY ALL"
        return self.add(f"SELECT {keys}, CASE WHEN best = 0 THEN {form} ELSE {form} | best // 2 | {'(8191 - first % 8192)' if self.distance else '8191'} END AS wp FROM ({first})")

    def node(self, tree, mask: int = 15, form: int = 0x8000) -> tuple[str, str | None]:
        """Names of the hits (url_id, site_id, wp) and of the positions (url_id, site_id, pos), if the node has any."""
        sections = ", ".join(str(s) for s in range(4) if mask >> s & 1)
        match tree:
            case Word(word):
                pos = self.add(f"SELECT url_id, site_id, pos FROM postings WHERE word = '{word}' AND section IN ({sections})")
                return self._weigh(pos, form), pos
            case Pattern(like, _):
                pos = self.add(f"SELECT word, url_id, site_id, pos FROM postings WHERE word LIKE '{like}' ESCAPE '\\' AND section IN ({sections})")
                each = self._weigh(pos, form, "word, url_id, site_id")
                return self._or([each]), self.add(f"SELECT DISTINCT url_id, site_id, pos FROM {pos}")
            case Forms(exact, others):
                nodes = [self.node(Word(w), mask, form if w == exact or not exact else 0) for w in [exact, *others] if w]
                return self._or([h for h, _ in nodes]), self.add(" UNION ALL ".join(f"SELECT url_id, site_id, pos FROM {p}" for _, p in nodes))
            case Or(terms):
                nodes = [self.node(t, mask, form) for t in terms]
                have = all(p for _, p in nodes)
                return self._or([h for h, _ in nodes]), self.add(" UNION ALL ".join(f"SELECT url_id, site_id, pos FROM {p}" for _, p in nodes)) if have else None
            case InSections(term, inner):
                return self.node(term, inner, 0)
            case Phrase(terms, offsets):
                nodes = [self.node(t, mask, form) for t in terms]
                joins = " ".join(f"JOIN {p} p{i} ON p{i}.url_id = p0.url_id AND p{i}.pos = p0.pos + {o} AND p{i}.pos // 16384 = p0.pos // 16384" for i, ((_, p), o) in enumerate(zip(nodes, offsets)) if i)
                start = f"SELECT p0.url_id, p0.site_id, max(p0.pos) AS s FROM {nodes[0][1]} p0 {joins} GROUP BY ALL"
                return self.add(f"SELECT url_id, site_id, CASE WHEN s >= 16384 THEN xor(s, 16383) ELSE 12288 END AS wp FROM ({start})"), None
            case And():
                return self._and(tree, mask, form)
            case LinkTo(url):
                full = url if "://" in url else f"http://{url}"
                names = f"'{full}', '{full}/'"
                return self.add(f"SELECT DISTINCT l.from_id AS url_id, u.site_id, 0 AS wp FROM links l JOIN u ON u.url_id = l.from_id WHERE l.to_id = (SELECT min(url_id) FROM u WHERE url IN ({names}))"), None
            case Empty() | Stop():
                return self.add("SELECT url_id, site_id, 0 AS wp FROM postings WHERE false"), None
        raise TypeError(tree)

    def _or(self, hits: list[str]) -> str:
        union = " UNION ALL ".join(f"SELECT url_id, site_id, wp FROM {h}" for h in hits)
        return self.add(f"SELECT url_id, site_id, max(wp & 32767) | bit_or(wp & 32768) AS wp FROM ({union}) GROUP BY ALL")

    def _and(self, tree: And, mask: int, form: int) -> tuple[str, str | None]:
        nodes = [self.node(t, mask, form) for t in tree.terms]
        if len(nodes) == 1:
            hits, pos = nodes[0]
        else:
            hits, pos = self._and_weight(nodes, tree.gaps), None
        for term in tree.without:
            other, _ = self.node(term, mask, form)
            hits = self.add(f"SELECT * FROM {hits} WHERE url_id NOT IN (SELECT url_id FROM {other})")
        for site in tree.sites:
            ids = " UNION ".join(f"SELECT site_id FROM sites WHERE contains('.' || lower(regexp_extract(site, '^[a-zA-Z]+://([^/:]+)', 1)) || '.', '.{s.host.strip('.')}.')"
                                 for s in (site.sites if isinstance(site, SiteSet) else [site]))
            hits = self.add(f"SELECT * FROM {hits} WHERE site_id {'IN' if site.include else 'NOT IN'} ({ids})")
        return hits, pos

    def _and_weight(self, nodes: list[tuple[str, str | None]], gaps: tuple[int, ...]) -> str:
        least, joins = [], []
        run: list[int] = []
        pieces: list[list[int]] = []
        for i, (_, pos) in enumerate(nodes):
            if pos:
                run.append(i)
            else:
                least.append(f"h{i}.wp & 32767")
                pieces.append(run)
                run = []
        pieces.append(run)
        for piece in pieces:
            if len(piece) == 1:
                least.append(f"h{piece[0]}.wp & 32767")
            elif piece:
                name = self._run_weight([nodes[i][1] for i in piece], [gaps[i] for i in piece])
                least.append(f"{name}.w")
                joins.append(f"JOIN {name} ON {name}.url_id = h0.url_id")
        hits = " ".join([f"FROM {nodes[0][0]} h0", *(f"JOIN {h} h{i} ON h{i}.url_id = h0.url_id" for i, (h, _) in enumerate(nodes) if i), *joins])
        forms = " & ".join(f"h{i}.wp" for i in range(len(nodes)))
        return self.add(f"SELECT h0.url_id, h0.site_id, least({', '.join(least)}) | ({forms} & 32768) AS wp {hits}")

    def _run_weight(self, positions: list[str], gaps: list[int]) -> str:
        before = self.add(f"SELECT url_id, pos, 1 AS n FROM {positions[0]}")
        longest = [before]
        for pos, gap in zip(positions[1:], gaps[1:]):
            before = self.add(f"SELECT b.url_id, b.pos, max(1 + coalesce(a.n, 0)) AS n FROM {pos} b LEFT JOIN {before} a ON a.url_id = b.url_id AND a.pos = b.pos - {gap} AND a.pos // 16384 = b.pos // 16384 GROUP BY ALL")
            longest.append(before)
        n = len(positions)
        ends = " UNION ALL ".join(f"SELECT url_id, max(n) AS n FROM {x} GROUP BY url_id" for x in longest)
        minima = " UNION ALL ".join(f"SELECT url_id, max(pos) AS last FROM {x} GROUP BY url_id" for x in positions)
        return self.add(
            f"SELECT url_id, (m & 49152) // 2 | CASE WHEN l = {n} THEN 6144 WHEN e > 1 THEN 4096 ELSE e * 2048 END | (2047 - m % 2048) AS w FROM "
            f"(SELECT url_id, max(n) AS l, count(*) FILTER (n >= 2) AS e FROM ({ends}) GROUP BY url_id) JOIN "
            f"(SELECT url_id, min(last) AS m FROM ({minima}) GROUP BY url_id HAVING count(*) = {n}) USING (url_id)"
        )


LINKS = "links AS (SELECT DISTINCT url_id AS from_id, unnest(hrefs) AS to_id FROM page)"


def query_sql(tree, select: str = "SELECT url_id, site_id, wp FROM hits", stop: list[str] | None = None, more: str = "", distance: bool = True) -> str:
    sql = Sql(distance)
    hits, _ = sql.node(tree)
    parts = [postings(stop), LINKS, *sql.ctes, f"hits AS (SELECT url_id, site_id, wp FROM {hits})", *([more] if more else [])]
    return "WITH " + ",\n".join(parts) + "\n" + select
