"""SQL that states the results of the training-data queries where SQL can."""

# Labels fall along the edges until none changes: every page ends with its group's least id.
_LABELS = """
WITH RECURSIVE pages AS (SELECT DISTINCT page_id FROM wiki_pages WHERE page_id IS NOT NULL),
pairs AS (SELECT DISTINCT src_page a, resolved b FROM links
          WHERE src_page <> resolved AND src_page IN (SELECT page_id FROM pages) AND resolved IN (SELECT page_id FROM pages)),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
label(node, least) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM both_ways
  UNION
  SELECT e.b, min(l.least) FROM label l JOIN both_ways e ON e.a = l.node JOIN recurring.label r ON r.node = e.b
  WHERE l.least < r.least GROUP BY e.b)
"""

_COUNTS = """
SELECT target_key, count(*) AS mentions, count(DISTINCT src_page) AS docs,
       CASE WHEN count(DISTINCT src_page) <= 2 THEN 'rare'
            WHEN count(DISTINCT src_page) > 0.05 * (SELECT count(DISTINCT src_page) FROM links) THEN 'common' END AS mark
FROM (SELECT DISTINCT link_id, target_key, src_page FROM links)
WHERE target_key IS NOT NULL AND target_key <> '' GROUP BY target_key
"""

_SCORED = """
g AS (SELECT page_id, n, unnest(shingles) h FROM f),
shared AS (SELECT a.page_id page_a, b.page_id page_b, any_value(a.n) na, any_value(b.n) nb, count(*) s
           FROM g a JOIN g b ON a.h = b.h AND a.page_id < b.page_id GROUP BY 1, 2 HAVING count(*) >= 24),
scored AS (SELECT *, s / (na + nb - s)::DOUBLE j, s / least(na, nb)::DOUBLE c, least(na, nb) / greatest(na, nb)::DOUBLE r FROM shared)
"""
_NEAR = "CASE WHEN r >= 0.6 THEN greatest(j, 0.95 * c) ELSE j END >= 0.82"

ORACLES: dict[str, str] = {
    "p2_found": _LABELS + "SELECT node AS page_id, least AS group_id FROM label",
    "p2_groups": _LABELS + "SELECT p.page_id, coalesce(l.least, p.page_id) AS group_id FROM pages p LEFT JOIN label l ON l.node = p.page_id",
    "p5_found": f"SELECT target_key, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p5_counts": _COUNTS,
    "p4_found": f"""
WITH f AS (SELECT DISTINCT page_id, shingles, len(shingles) n FROM fingerprints),
{_SCORED}
SELECT page_a, page_b FROM scored WHERE {_NEAR}
""",
    "p4_classes": f"""
WITH every AS (SELECT page_id, shingles, min(page_id) OVER (PARTITION BY shingles) AS class_id FROM (SELECT DISTINCT page_id, shingles FROM fingerprints WHERE len(shingles) > 0)),
f AS (SELECT page_id, shingles, len(shingles) n FROM every WHERE page_id = class_id),
{_SCORED},
ends AS (SELECT page_a AS class_id FROM scored WHERE {_NEAR} UNION ALL SELECT page_b FROM scored WHERE {_NEAR}),
linked AS (SELECT class_id, count(*) AS links FROM ends GROUP BY class_id)
SELECT e.page_id, e.class_id, coalesce(l.links, 0) AS links FROM every e LEFT JOIN linked l ON l.class_id = e.class_id
""",
}
