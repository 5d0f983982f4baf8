"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

from siftmesh.llm.bpe import document_ids, token_counts
from siftmesh.llm.components import redirect_groups
from siftmesh.llm.leaks import cleaned, leaked_items
from siftmesh.llm.near_duplicates import page_groups, page_pairs
from siftmesh.llm.stuffing import stuffed_pages, stuffing_report
from siftmesh.llm.subjects import document_subjects, subject_mixture
from siftmesh.llm.term_frequency import marked_words, word_frequencies

_FREQUENCY = """blocks AS (SELECT DISTINCT ON (block_id) lower(trim(word, ' ' || chr(9))) AS word, urls FROM wordurlu WHERE lower(trim(word, ' ' || chr(9))) <> ''),
each AS (SELECT word, unnest(CASE WHEN len(urls) > 0 THEN urls ELSE [NULL] END) AS u FROM blocks),
counted AS (SELECT word, count(u) AS n_listed, count(DISTINCT u) AS n_urls FROM each GROUP BY word),
marked AS (SELECT word, n_listed, n_urls, CASE WHEN n_urls <= 2 THEN 'rare' WHEN n_urls >= 0.25 * (SELECT count(DISTINCT url_id) FROM urlword) THEN 'common' END AS mark FROM counted)"""

QUERIES = {
    "p1_found": stuffed_pages, "p1_report": stuffing_report,
    "p3_found": redirect_groups,
    "p6_found": marked_words, "p6_words": word_frequencies,
    "p7_found": page_pairs, "p7_groups": page_groups,
    "p8_ids": document_ids, "p8_counts": token_counts,
    "p9_found": leaked_items, "p9_cleaned": cleaned,
    "p10_found": document_subjects, "p10_mixture": subject_mixture,
}

SQL = {
    "p7_groups": r"""WITH RECURSIVE s AS (SELECT DISTINCT url_id, list_sort(list_distinct(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+'))) AS w FROM urlwords WHERE url_id IS NOT NULL AND txt IS NOT NULL),
k AS (SELECT w, min(url_id) AS rep FROM s WHERE len(w) > 0 GROUP BY w), e AS (SELECT rep, len(w) AS n, unnest(w) AS x FROM k),
c AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS both_n, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
p AS (SELECT a, b FROM c WHERE common >= 0.6 * (both_n - common)), both_ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT rep AS node, rep AS label FROM k UNION SELECT b, label FROM reach JOIN both_ways ON a = node WHERE b > label),
g AS (SELECT node, min(label) AS group_id FROM reach GROUP BY node), l AS (SELECT a AS node, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT DISTINCT ON (s.url_id) s.url_id, k.rep AS class_id, g.group_id, coalesce(n_links, 0) AS n_links FROM s JOIN k USING (w) JOIN g ON g.node = k.rep LEFT JOIN l ON l.node = k.rep ORDER BY s.url_id, k.rep""",
    "p3_found": """WITH RECURSIVE u AS (SELECT url_id, min(redir) AS redir FROM urlword GROUP BY url_id),
e AS (SELECT url_id AS a, redir AS b FROM u WHERE redir <> 0 AND redir <> url_id AND redir IN (SELECT url_id FROM u)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS label FROM both_ways UNION SELECT b, label FROM reach JOIN both_ways ON a = node WHERE b > label)
SELECT min(label) AS group_id, node AS url_id FROM reach GROUP BY node""",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p6_found": f"WITH {_FREQUENCY} SELECT word, mark FROM marked WHERE mark IS NOT NULL",
    "p6_words": f"WITH {_FREQUENCY} SELECT * FROM marked",
    "p7_found": r"""WITH s AS (SELECT DISTINCT url_id, list_distinct(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) AS w FROM urlwords WHERE txt IS NOT NULL),
e AS (SELECT url_id, len(w) AS n, unnest(w) AS x FROM s),
c AS (SELECT a.url_id AS url_id_a, b.url_id AS url_id_b, a.n + b.n AS both_n, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.url_id < b.url_id GROUP BY ALL)
SELECT url_id_a, url_id_b FROM c WHERE common >= 0.6 * (both_n - common)""",
}
