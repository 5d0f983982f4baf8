"""Queries of the general data-processing operators with their SQL."""

from __future__ import annotations

from siftmesh.operators.hierarchy import link_descendant_pairs, link_descendants, link_faults, link_paths
from siftmesh.operators.orphans import crawl_orphans, orphan_report
from siftmesh.operators.skewed_keys import heavy_words, words

QUERIES = {
    "p2_found": heavy_words, "p2_words": words,
    "p4_found": crawl_orphans, "p4_report": orphan_report,
    "p5_found": link_faults, "p5_paths": link_paths, "p5_descendants": link_descendants,
    "p5_descendant_pairs": link_descendant_pairs,
}

_BLOCKS = r"""blocks AS (SELECT w AS word, block_id, max(n) AS listed, max(merged_at) AS merged_at FROM (
  SELECT lower(trim(word, ' ' || chr(9))) AS w, block_id, coalesce(len(urls), 0) AS n, merged_at FROM wordurlu)
  WHERE w <> '' AND block_id IS NOT NULL GROUP BY ALL)"""

_ORPHANS = """u AS (SELECT url_id, min(seen_at) AS first_seen, min(site_id) AS site_id, min(referrer) AS referrer, max(deleted) AS deleted FROM urlword GROUP BY url_id),
s AS (SELECT site_id, min(seen_at) AS first_seen FROM sites GROUP BY site_id),
h AS (SELECT url_id, target_id, min(parsed_at) AS rec_at FROM (SELECT url_id, parsed_at, unnest(hrefs) AS target_id FROM urlwords) WHERE target_id IS NOT NULL GROUP BY ALL),
refs AS (SELECT 'urlword.referrer' AS ref_field, 0 AS space, url_id, referrer AS target_id, first_seen AS rec_at FROM u WHERE referrer <> 0
  UNION ALL SELECT 'urlword.site_id', 1, url_id, site_id, first_seen FROM u WHERE site_id IS NOT NULL
  UNION ALL SELECT 'urlwords.hrefs', 0, url_id, target_id, rec_at FROM h),
parents AS (SELECT 0 AS space, url_id AS target_id, deleted, first_seen FROM u UNION ALL SELECT 1, site_id, 0, first_seen FROM s),
found AS (SELECT ref_field, url_id, refs.target_id, CASE WHEN p.target_id IS NULL THEN 'missing' WHEN deleted = 1 THEN 'deleted' WHEN p.first_seen > rec_at THEN 'late' END AS kind,
  strftime(rec_at, '%Y-%m') AS ref_month FROM refs LEFT JOIN parents p ON p.space = refs.space AND p.target_id = refs.target_id)"""

_TREE = """n AS (SELECT url_id, min(referrer) AS ref, min(hops) AS hops FROM urlword GROUP BY url_id),
up AS (SELECT url_id, CASE WHEN ref IS NULL OR ref = 0 THEN NULL ELSE ref END AS parent, hops FROM n),
walk AS (SELECT url_id, 0 AS depth, url_id AS root, [url_id] AS path FROM up WHERE parent IS NULL
  UNION ALL SELECT up.url_id, depth + 1, root, list_append(path, up.url_id) FROM walk JOIN up ON up.parent = walk.url_id),
open AS (SELECT url_id, [url_id] AS path FROM up WHERE parent IS NOT NULL AND parent NOT IN (SELECT url_id FROM up)
  UNION ALL SELECT up.url_id, list_append(path, up.url_id) FROM open JOIN up ON up.parent = open.url_id),
left_over AS (SELECT url_id, parent FROM up WHERE url_id NOT IN (SELECT url_id FROM walk) AND url_id NOT IN (SELECT url_id FROM open)),
trail AS (SELECT url_id AS start, parent AS rec_at FROM left_over UNION SELECT start, parent FROM trail JOIN left_over ON url_id = rec_at)"""

_TREE_KINDS = """SELECT url_id, 'root' AS kind, depth, root, path FROM walk UNION ALL SELECT url_id, 'broken', NULL, NULL, path FROM open
  UNION ALL SELECT url_id, CASE WHEN EXISTS (SELECT 1 FROM trail WHERE start = url_id AND rec_at = url_id) THEN 'cycle' ELSE 'below_cycle' END, NULL, NULL, NULL FROM left_over"""

SQL = {
    "p2_words": f"WITH {_BLOCKS} SELECT word, count(*) AS n_blocks, sum(listed)::BIGINT AS n_listed, max(listed) AS longest, min(merged_at) AS first_merged, max(merged_at) AS last_merged FROM blocks GROUP BY word",
    "p2_found": f"WITH {_BLOCKS} SELECT word FROM blocks GROUP BY word HAVING count(*) >= 0.01 * (SELECT count(*) FROM blocks)",
    "p4_found": f"WITH {_ORPHANS} SELECT * FROM found WHERE kind IS NOT NULL",
    "p4_report": f"WITH {_ORPHANS} SELECT ref_field, ref_month, kind, count(*) AS n_refs, count(DISTINCT target_id) AS n_targets FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p5_found": f"WITH RECURSIVE {_TREE}, kinds AS ({_TREE_KINDS}) SELECT url_id, CASE WHEN kind = 'root' THEN 'wrong_hops' ELSE kind END AS kind FROM kinds JOIN up USING (url_id) WHERE kind <> 'root' OR (hops IS NOT NULL AND hops <> depth)",
    "p5_paths": f"WITH RECURSIVE {_TREE}, kinds AS ({_TREE_KINDS}) SELECT url_id, kind, depth::BIGINT AS depth, root, array_to_string(path, '/') AS path FROM kinds",
    "p5_descendants": f"WITH RECURSIVE {_TREE}, p AS (SELECT url_id, path FROM walk UNION ALL SELECT url_id, path FROM open), pairs AS (SELECT unnest(path) AS above, len(path) - unnest(range(1, len(path) + 1)) AS distance FROM p) SELECT above AS url_id, count(*) - 1 AS n_descendants, max(distance)::BIGINT AS deepest FROM pairs GROUP BY above",
    "p5_descendant_pairs": f"WITH RECURSIVE {_TREE}, p AS (SELECT url_id, path FROM walk UNION ALL SELECT url_id, path FROM open), pairs AS (SELECT unnest(path) AS above, url_id, len(path) - unnest(range(1, len(path) + 1)) AS distance FROM p), around AS (SELECT url_id AS start, parent AS above, [parent] AS seen FROM left_over UNION ALL SELECT start, parent, list_append(seen, parent) FROM around JOIN left_over ON url_id = above WHERE NOT list_contains(seen, parent)) SELECT above AS url_id, url_id AS descendant_id, distance::BIGINT AS distance FROM pairs WHERE distance > 0 UNION ALL SELECT above, start, len(seen)::BIGINT FROM around WHERE above <> start",
}
