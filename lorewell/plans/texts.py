"""Queries over the texts of notes, and SQL that restates their grammar line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.functions.names import document_line
from lorewell.operators import duplicates, graph, resolve, rewrite
from lorewell.plans import catalogue
from lorewell.plans.catalogue import _LINKS, _PAIRS, ORACLES, SAMPLES, _prints, _wiki, query
from lorewell.session import Scratch, table

# Newest readable content of each page as lines; the front matter's length; body lines with the fence state.
_LINES = r"""
pg AS (SELECT page_id, vault, rel_file, content FROM files WHERE content IS NOT NULL AND page_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY received_at DESC) = 1),
ln AS (SELECT *, list_transform(string_split(regexp_replace(content, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r+$', '')) AS ls FROM pg),
fr AS (SELECT *, CASE WHEN ls[1] = '---' THEN coalesce(list_position(ls[2:], '---'), -1) + 1 ELSE 0 END AS fb FROM ln),
bd AS (SELECT page_id, vault, rel_file, content, ls, fb, CASE WHEN content = '' THEN [] ELSE ls[fb + 1:] END AS b FROM fr),
fn AS (SELECT *, list_reduce(b, lambda acc, x: struct_pack(
         f := CASE WHEN regexp_extract(trim(x, ' ' || chr(9)), '^(`{3,}|~{3,})') = '' THEN acc.f WHEN acc.f = '' THEN regexp_extract(trim(x, ' ' || chr(9)), '^(`{3,}|~{3,})')
                   WHEN acc.f[1] = regexp_extract(trim(x, ' ' || chr(9)), '^(`{3,}|~{3,})')[1] AND len(acc.f) <= len(regexp_extract(trim(x, ' ' || chr(9)), '^(`{3,}|~{3,})')) THEN '' ELSE acc.f END,
         s := list_append(acc.s, CASE WHEN regexp_extract(trim(x, ' ' || chr(9)), '^(`{3,}|~{3,})') <> '' THEN 'fence' WHEN acc.f <> '' THEN 'code' ELSE 'text' END)),
         struct_pack(f := '', s := list_value(''))).s[2:] AS states FROM bd),
line AS (SELECT page_id, vault, rel_file, fb, unnest(b) AS line, unnest(states) AS state, unnest(range(1, len(b) + 1)) AS pos FROM fn)
"""

_MARKUP = r"^(?:\s*(?:>|[-*+](?=\s)|[0-9]+[.)](?=\s)|\[[ xX]\](?=\s)|#{1,6}(?=\s|$)))+".replace("(?=\\s)", r"\s").replace(r"(?=\s|$)", r"(?:\s|$)")
_LINK = r"\[\[.*?\]\]|\[[^\]]*\]\([^)]*\)"


@query(rf"""
WITH {_LINES}, one AS (SELECT *, trim(line, ' ' || chr(9)) AS shown FROM line WHERE state = 'text'),
hit AS (SELECT *, regexp_extract_all(shown, '{_LINK}') AS found FROM one),
lone AS (SELECT * FROM hit WHERE len(found) = 1 AND NOT regexp_matches(shown, '!\[[^\]]*\]\(') AND NOT regexp_matches(found[1], '\]\((#|mailto:|[^)]*://)') AND NOT regexp_matches(found[1], '^\[\[\s*(#[^\]]*)?\]\]$'))
SELECT h.page_id, h.vault, w.name, (h.fb + h.pos)::INTEGER AS line, h.shown AS text FROM lone h JOIN wiki_pages w ON w.page_id = h.page_id
WHERE NOT regexp_matches(regexp_replace(regexp_replace(h.shown, '{_LINK}', ' '), '{_MARKUP}', ''), '[\p{{L}}\p{{N}}]')
""")
def link_only_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).link_only_lines


@query(f"""
SELECT s.*, coalesce(n, 0) AS link_only_lines FROM ({catalogue.LINT}) s LEFT JOIN (SELECT vault, count(*) AS n FROM ({ORACLES["link_only_lines"]}) GROUP BY vault) l ON l.vault = s.vault
""")
def lint_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).lint()


@query(f"""
WITH {_LINKS}, known AS (SELECT src_page, link_pos, max(context) AS context FROM links WHERE context IS NOT NULL GROUP BY src_page, link_pos)
SELECT k.src_page, k.link_pos, k.context FROM known k JOIN readable r ON r.page_id = k.src_page
""")
def link_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed contexts of the links of which the table of links holds one."""
    known = table(spark, folder, "links").where("context is not null").select("src_page", "link_pos").distinct()
    return _wiki(spark, folder).links.select("src_page", "link_pos", "context").join(known, ["src_page", "link_pos"], "left_semi")


# The rules of the formatter: headings, list markers and links of a line, then blank lines of the whole body.
_SCALAR = r"""(CASE WHEN {x} <> '' AND NOT contains('-{{}}[]&*#!|>@`', {x}[1]) AND NOT contains({x}, ': ') AND NOT contains({x}, ' #') AND NOT contains({x}, '[') AND NOT contains({x}, ']') AND NOT contains({x}, ',') THEN {x}
       ELSE '"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"' END)"""
_FORMAT = rf"""
{_LINES},
bare AS (SELECT page_id, pos, state, CASE WHEN state = 'text' THEN regexp_replace(line, '[\s\x{{a0}}]+$', '') ELSE line END AS t FROM line),
marked AS (SELECT page_id, pos, state, CASE WHEN state <> 'text' THEN t
    WHEN regexp_matches(t, '^\s*#{{1,6}}[ \t]') THEN rtrim(regexp_replace(regexp_replace(t, '^(\s*#{{1,6}})[ \t]+', '\1 '), '\s*#*$', ''), ' ' || chr(9))
    ELSE regexp_replace(t, '^(\s*)[*+][ \t]+', '\1- ') END AS t FROM bare),
spaced AS (SELECT page_id, pos, state, CASE WHEN state <> 'text' OR contains(t, '`') THEN t ELSE
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[\s*([^\]\[]*?)\s*\]\(\s*([^)]*?)\s*\)', '[\1](\2)', 'g'),
      '\[\[\s+', '[[', 'g'), '\s+\]\]', ']]', 'g'), '(\[\[[^\]|#]*?)\s*#\s*([^\]|]*?)(\s*\||\]\])', '\1#\2\3', 'g'), '(\[\[[^\]|]*?)\s*\|\s*([^\]]*\]\])', '\1|\2', 'g') END AS t FROM marked),
text AS (SELECT page_id, string_agg(CASE WHEN state = 'text' THEN t ELSE chr(1) || t END, chr(10) ORDER BY pos) AS t FROM spaced GROUP BY page_id),
body AS (SELECT page_id, replace(trim(regexp_replace(regexp_replace(regexp_replace(chr(10) || t || chr(10), '\n{{3,}}', chr(10) || chr(10), 'g'),
      '\n+([ \t]*#{{1,6}} [^\n]*)', chr(10) || chr(10) || '\1', 'g'), '(\n[ \t]*#{{1,6}} [^\n]*)\n+', '\1' || chr(10) || chr(10), 'g'), chr(10)), chr(1), '') AS body FROM text),
names AS (SELECT page_id, title, aliases FROM front_matter),
tagged AS (SELECT page_id, list_filter(ls[2:fb - 1], lambda x: starts_with(x, 'tags:'))[1] AS t FROM fr WHERE fb > 0),
tags AS (SELECT page_id, list_transform(string_split(regexp_extract(t, '\[(.*)\]', 1), ','), lambda x: trim(trim(x), '"')) AS every FROM tagged WHERE t IS NOT NULL),
tags_once AS (SELECT page_id, list_filter(every, lambda x, i: list_position(every, x) = i) AS tags FROM tags),
front AS (SELECT f.page_id, CASE WHEN f.fb = 0 THEN '' ELSE '---' || chr(10)
      || CASE WHEN coalesce(n.title, '') <> '' THEN 'title: ' || {_SCALAR.format(x="n.title")} || chr(10) ELSE '' END
      || CASE WHEN len(coalesce(n.aliases, [])) > 0 THEN 'aliases:' || chr(10) || array_to_string(list_transform(n.aliases, lambda x: '  - ' || {_SCALAR.format(x="x")}), chr(10)) || chr(10) ELSE '' END
      || CASE WHEN g.tags IS NOT NULL THEN 'tags:' || chr(10) || array_to_string(list_transform(g.tags, lambda x: '  - ' || {_SCALAR.format(x="x")}), chr(10)) || chr(10) ELSE '' END
      || '---' || chr(10) || chr(10) END AS front FROM fr f JOIN names n ON n.page_id = f.page_id LEFT JOIN tags_once g ON g.page_id = f.page_id)
"""


@query(rf"""
WITH {_FORMAT}, made AS (SELECT p.page_id, p.vault, p.rel_file, p.content, regexp_replace(f.front || coalesce(b.body, ''), '\n+$', '') || chr(10) AS new_content
                         FROM pg p JOIN front f ON f.page_id = p.page_id LEFT JOIN body b ON b.page_id = p.page_id)
SELECT page_id, vault, rel_file, new_content, content <> new_content AS changed FROM made
UNION ALL SELECT DISTINCT page_id, vault, rel_file, NULL, false FROM files WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM pg)
""")
def formatted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).formatted()


_NEW = "Renamed page"
# The page with most links to it, whose name has no signs that patterns read otherwise.
_OLD = f"""
old AS (SELECT d.page_id, d.vault, d.key, d.name, count(*) AS links FROM l JOIN docs d ON d.vault = l.vault AND d.key = l.tk WHERE regexp_matches(d.name, '^[A-Za-z0-9 ]+$')
        GROUP BY ALL ORDER BY links DESC, d.page_id LIMIT 1)
"""


def _most_linked(wiki) -> DataFrame:
    named = wiki.documents.where(F.col("name").rlike("^[A-Za-z0-9 ]+$")).select(F.col("page_id").alias("resolved"), "name", "vault")
    counted = wiki.links.groupBy("resolved").agg(F.count("*").alias("n")).join(named, "resolved")
    return counted.orderBy(F.desc("n"), "resolved")


def _renamed(spark: SparkSession, folder: str) -> DataFrame | None:
    wiki = _wiki(spark, folder)
    first = _most_linked(wiki).head(1)
    return wiki.renamed(first[0]["name"], _NEW, first[0]["vault"]) if first else None


_TOUCHED = rf"""
WITH {_LINKS}, {_LINES}, {_OLD},
changed AS (SELECT x.page_id, x.fb, x.pos, CASE WHEN x.state <> 'text' OR contains(x.line, '`') THEN x.line ELSE
    regexp_replace(regexp_replace(x.line, '(?i)\[\[\s*(?:\./)?' || o.name || '(\.md)?\s*(#[^\]|]*)?((?:\\)?\|[^\]]*)?\s*\]\]', '[[{_NEW}\1\2\3]]', 'g'),
      '(?i)(\]\([ \t]*<?(?:\./)?)' || o.name || '((?:\.md)?(?:#[^)>]*)?>?[^)]*\))', '\1{_NEW}\2', 'g') END AS line FROM line x JOIN old o ON o.vault = x.vault),
n AS (SELECT l.src_page AS page_id, count(*) AS links FROM l JOIN old ON l.vault = old.vault AND l.tk = old.key GROUP BY l.src_page),
body AS (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM changed GROUP BY page_id),
whole AS (SELECT p.page_id, p.rel_file, p.content, coalesce(n.links, 0) AS links, o.page_id = p.page_id AS renamed, coalesce(f.title = o.name AND o.page_id = p.page_id, false) AS retitled, o.name,
            array_to_string(r.ls[:r.fb], chr(10)) || CASE WHEN r.fb > 0 THEN chr(10) ELSE '' END AS head, coalesce(b.body, '') AS body
          FROM pg p JOIN old o ON o.vault = p.vault JOIN fr r ON r.page_id = p.page_id LEFT JOIN n ON n.page_id = p.page_id LEFT JOIN body b ON b.page_id = p.page_id LEFT JOIN front_matter f ON f.page_id = p.page_id)
"""


@query(rf"""
{_TOUCHED} SELECT page_id, rel_file, CASE WHEN renamed THEN '{_NEW}.md' ELSE rel_file END AS new_rel_file, links::INTEGER AS links, retitled,
  rtrim(CASE WHEN retitled THEN replace(replace(head, 'title: ' || name, 'title: {_NEW}'), 'title: "' || name || '"', 'title: "{_NEW}"') ELSE head END || body, chr(10)) AS new_content
FROM whole WHERE links > 0 OR renamed
""")
def renamed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every file that renaming the most linked page touches, with its new content (line ends as line feeds)."""
    found = _renamed(spark, folder)
    if found is None:
        return spark.createDataFrame([], "page_id long, rel_file string, new_rel_file string, links int, retitled boolean, new_content string")
    plain = F.regexp_replace(F.regexp_replace("new_content", "\r+\n", "\n"), "[\r\n]+$", "")
    return found.withColumn("new_content", plain)


@query(f"{_TOUCHED} SELECT greatest(count(*) FILTER (links > 0 OR retitled), 1) AS files_touched, coalesce(sum(links), 0)::BIGINT AS links_updated, coalesce(bool_or(retitled), false) AS title_updated FROM whole")
def rename_totals(spark: SparkSession, folder: str) -> DataFrame:
    found = _renamed(spark, folder)
    return rewrite.rename_totals(found if found is not None else renamed_pages(spark, folder))


@query(r"""
SELECT page_id, CASE WHEN p = '' THEN '[[' || name || ']]: (empty)' WHEN length(p) <= 140 THEN '[[' || name || ']]: ' || p ELSE '[[' || name || ']]: ' || regexp_replace(p[:137], '\s+$', '') || '...' END AS line
FROM (SELECT page_id, name, regexp_replace(coalesce(excerpt, ''), '^\s+|\s+$', '', 'g') AS p FROM wiki_pages)
""")
def previews(spark: SparkSession, folder: str) -> DataFrame:
    """Each page as one line of a report."""
    return table(spark, folder, "wiki_pages").select("page_id", document_line(F.col("name"), F.col("excerpt")).alias("line"))


@query(f"""
WITH i AS ({ORACLES["identifiers"]}), asked AS (SELECT DISTINCT vault, id_key FROM i UNION SELECT vault, key || ' nowhere' FROM wiki_pages),
own AS (SELECT vault, key, page_id FROM wiki_pages), many AS (SELECT vault, id_key, count(*) AS pages, min(page_id) AS page_id FROM i GROUP BY ALL)
SELECT a.vault, a.id_key, CASE WHEN o.page_id IS NOT NULL THEN 'found' WHEN m.pages IS NULL THEN 'not found' WHEN m.pages > 1 THEN 'ambiguous' ELSE 'found' END AS outcome,
       CASE WHEN o.page_id IS NOT NULL THEN o.page_id WHEN m.pages = 1 THEN m.page_id END AS page_id
FROM asked a LEFT JOIN own o ON o.vault = a.vault AND o.key = a.id_key LEFT JOIN many m ON m.vault = a.vault AND m.id_key = a.id_key
""")
def lookups(spark: SparkSession, folder: str) -> DataFrame:
    """What every identifier means, and some that mean nothing."""
    pages, front = table(spark, folder, "wiki_pages"), table(spark, folder, "front_matter")
    asked = resolve.identifiers(pages, front).select("vault", "id_key").unionByName(pages.select("vault", F.concat("key", F.lit(" nowhere")).alias("id_key")))
    return resolve.lookups(pages, front, asked.distinct())


@query(f"""
WITH {_PAIRS}, c AS (SELECT p.vault, a, b, len(list_intersect(x.shingles, y.shingles)) AS shared, len(x.shingles) AS m, len(y.shingles) AS n FROM p JOIN f x ON x.page_id = a JOIN f y ON y.page_id = b),
s AS (SELECT vault, a, b, shared, CASE WHEN least(m, n) / greatest(m, n)::DOUBLE >= 0.6 THEN greatest(shared / (m + n - shared)::DOUBLE, 0.95 * (shared / least(m, n)::DOUBLE)) ELSE shared / (m + n - shared)::DOUBLE END AS score FROM c)
SELECT vault, a, b, row_number() OVER (PARTITION BY vault ORDER BY score DESC, shared DESC, a, b)::INTEGER AS place FROM s WHERE score >= 0.82 AND shared >= 24 QUALIFY place <= 10
""")
def near_duplicates_top(spark: SparkSession, folder: str) -> DataFrame:
    prints = Scratch(spark).save(_prints(spark, folder))
    return duplicates.best(duplicates.near_duplicates(prints), 10).select("vault", "a", "b", "place")


@query(catalogue._SAMPLED + """,
walk(source, node, path, ids) AS (
  SELECT DISTINCT s.source, s.source, [lower(b.name)], [s.source] FROM far s JOIN docs b ON b.page_id = s.source
  UNION ALL
  SELECT * FROM (SELECT w.source, e.b AS node, min(w.path || [lower(n.name)]) AS path, arg_min(w.ids || [e.b], w.path || [lower(n.name)]) AS ids
  FROM walk w JOIN adj e ON e.a = w.node JOIN d x ON x.source = w.source AND x.node = w.node JOIN d y ON y.source = w.source AND y.node = e.b AND y.distance = x.distance + 1
  JOIN docs n ON n.page_id = e.b GROUP BY w.source, e.b)),
mean AS (SELECT vault, avg(distance) AS average FROM far GROUP BY vault),
shown AS (SELECT f.vault, f.source, f.target, f.distance, array_to_string(w.ids, '>') AS path, row_number() OVER (PARTITION BY f.vault ORDER BY f.distance DESC, w.path) AS place
          FROM far f JOIN mean m ON m.vault = f.vault JOIN walk w ON w.source = f.source AND w.node = f.target WHERE f.distance > m.average)
SELECT vault, source, target, distance, path, place::INTEGER AS place FROM shown WHERE place <= 5
""")
def longest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The five longest sampled paths of each vault that are longer than its average, by length and names."""
    wiki = _wiki(spark, folder)
    found = wiki.scratch.save(wiki.sampled_distances(SAMPLES, paths=True))
    longer = graph.longer_than_average(found)
    placed = graph.longest(longer, wiki.documents, 5)
    return placed.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
