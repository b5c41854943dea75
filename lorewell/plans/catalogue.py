"""Named queries over the test tables, and the SQL each is checked against.

Queries that parse start from ``files``; their SQL states the result from the tables that
hold the parsed forms, so parser and operators are checked against something they did not
produce. Graph and duplicate queries treat each vault as a collection of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.operators import duplicates, graph, lengths, resolve, wanted
from lorewell.plans.wiki import Wiki
from lorewell.session import Scratch, table

#: Sampled pairs a vault in the path statistics, the command's default; a feature of the operator, not a cap on its input.
SAMPLES = 500

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL of its result if SQL can state it."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


# The links of readable pages as SQL: keys are restated from the display target, as some are lost in the table.
_LINKS = """
readable AS (SELECT DISTINCT page_id FROM files WHERE content IS NOT NULL AND page_id IS NOT NULL),
docs AS (SELECT w.page_id, w.vault, w.rel_path, w.name, w.key, CASE WHEN r.page_id IS NULL THEN '' ELSE coalesce(w.excerpt, '') END AS excerpt
         FROM wiki_pages w LEFT JOIN readable r ON r.page_id = w.page_id),
l AS (SELECT DISTINCT src_page, vault, link_pos, kind, display_target, lower(nfc_normalize(split_part(display_target, '#', 1))) AS tk, raw_target
      FROM links WHERE src_page IN (SELECT page_id FROM readable)),
res AS (SELECT l.*, d.page_id AS resolved FROM l LEFT JOIN docs d ON d.vault = l.vault AND d.key = l.tk),
edge AS (SELECT DISTINCT vault, src_page AS src, resolved AS dst FROM res WHERE resolved <> src_page),
adj AS (SELECT vault, src AS a, dst AS b FROM edge UNION SELECT vault, dst, src FROM edge)
"""
_LABELS = f"""
WITH RECURSIVE {_LINKS},
label(node, least) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM adj
  UNION
  SELECT e.b, min(l.least) FROM label l JOIN adj e ON e.a = l.node JOIN recurring.label r ON r.node = e.b
  WHERE l.least < r.least GROUP BY e.b)
"""
_SIZES = """
sizes AS (SELECT d.vault, l.least AS component, count(*) AS pages, min(lower(d.name)) AS first_name
          FROM docs d JOIN label l ON l.node = d.page_id GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY pages DESC, first_name) AS place FROM sizes),
member AS (SELECT d.vault, d.page_id, d.name, l.least AS component, p.place
           FROM docs d JOIN label l ON l.node = d.page_id JOIN placed p ON p.component = l.least),
biggest AS (SELECT vault, page_id, name, row_number() OVER (PARTITION BY vault ORDER BY lower(name), page_id) AS place FROM member WHERE place = 1)
"""


def _wiki(spark: SparkSession, folder: str) -> Wiki:
    return Wiki.of_tables(spark, folder)


@query(f"WITH {_LINKS} SELECT page_id, vault, rel_path, name, key, excerpt FROM docs")
def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).documents


@query("""
SELECT f.page_id, CASE WHEN r.page_id IS NULL THEN false ELSE present END AS present, CASE WHEN r.page_id IS NULL THEN 0 ELSE body_offset END AS body_offset,
       CASE WHEN r.page_id IS NOT NULL THEN title END AS title, CASE WHEN r.page_id IS NULL THEN '' ELSE coalesce(array_to_string(aliases, ' | '), '') END AS aliases
FROM front_matter f LEFT JOIN (SELECT DISTINCT page_id FROM files WHERE content IS NOT NULL) r ON r.page_id = f.page_id
""")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).front_matter.withColumn("aliases", F.array_join("aliases", " | "))


@query(f"WITH {_LINKS} SELECT src_page, vault, link_pos, kind, display_target, tk AS target_key, raw_target FROM l")
def links_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).links.select("src_page", "vault", "link_pos", "kind", "display_target", "target_key", "raw_target")


@query(f"WITH {_LINKS} SELECT src_page, link_pos, tk AS target_key, resolved FROM res")
def links_resolved(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).links.select("src_page", "link_pos", "target_key", "resolved")


@query(f"WITH {_LINKS} SELECT vault, src, dst FROM edge")
def edges(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).edges


@query(f"""
WITH {_LINKS} SELECT d.page_id, (SELECT count(*) FROM edge WHERE src = d.page_id) AS outbound, (SELECT count(*) FROM edge WHERE dst = d.page_id) AS inbound FROM docs d
""")
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    wiki = _wiki(spark, folder)
    out = wiki.edges.groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("outbound"))
    into = wiki.edges.groupBy(F.col("dst").alias("page_id")).agg(F.count("*").alias("inbound"))
    return wiki.documents.select("page_id").join(out, "page_id", "left").join(into, "page_id", "left").fillna(0)


@query(f"""
WITH {_LINKS}, shown AS (SELECT r.vault, r.src_page, d.page_id IS NULL AS missing, coalesce(d.name, r.display_target) AS name, r.link_pos
                         FROM res r LEFT JOIN docs d ON d.page_id = r.resolved)
SELECT vault, src_page, missing, max_by(name, link_pos) AS name FROM shown GROUP BY vault, src_page, missing, lower(name)
""")
def outgoing_links(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).outgoing()


@query(f"WITH {_LINKS} SELECT e.vault, e.dst AS page_id, d.name AS source_name FROM edge e JOIN docs d ON d.page_id = e.src")
def incoming_links(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).incoming()


@query(f"WITH {_LINKS} SELECT src_page, link_pos, display_target FROM res WHERE resolved IS NULL")
def missing_links(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).links.where("resolved is null").select("src_page", "link_pos", "display_target")


@query(f"WITH {_LINKS} SELECT vault, page_id, name FROM docs WHERE page_id NOT IN (SELECT a FROM adj)")
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).orphans().select("vault", "page_id", "name")


@query(_LABELS + "SELECT node, least AS component FROM label")
def components(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).components


@query(f"{_LABELS}, {_SIZES} SELECT vault, component, pages, first_name, place::INTEGER AS place FROM placed")
def component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).component_sizes()


@query(f"{_LABELS}, {_SIZES} SELECT vault, page_id, name, component, place::INTEGER AS place FROM member WHERE place > 1")
def islands(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).islands()


#: The report of lint but for its lines with nothing but a link.
LINT = f"""
{_LABELS}, {_SIZES}, base AS (
  SELECT vault, count(*) AS documents, count(*) FILTER (trim(excerpt) <> '') AS covered, count(*) FILTER (page_id NOT IN (SELECT a FROM adj)) AS orphans FROM docs GROUP BY vault),
part AS (SELECT vault, max(pages) AS largest, count(*) - 1 AS islands FROM sizes GROUP BY vault)
SELECT b.vault, documents, covered, orphans, coalesce(islands, 0) AS islands, coalesce(largest, 1) AS largest, coalesce(largest, 1) / documents::DOUBLE AS largest_component_ratio,
       orphans / documents::DOUBLE AS orphan_rate, covered / documents::DOUBLE AS content_coverage
FROM base b LEFT JOIN part p ON p.vault = b.vault
"""


_DISTANCES = f"""
{_LABELS}, {_SIZES}, start AS (SELECT vault, page_id FROM biggest WHERE place = 1),
d(source, node, distance) USING KEY (source, node) AS (
  SELECT page_id, page_id, 0::BIGINT FROM start
  UNION
  SELECT d.source, e.b, min(d.distance) + 1 FROM d JOIN adj e ON e.a = d.node LEFT JOIN recurring.d r ON r.source = d.source AND r.node = e.b
  WHERE r.node IS NULL GROUP BY d.source, e.b)
"""


@query(_DISTANCES + "SELECT source, node AS target, distance FROM d")
def distances(spark: SparkSession, folder: str) -> DataFrame:
    """From the first page of each vault's largest component to all of it."""
    wiki = _wiki(spark, folder)
    largest = wiki.scratch.save(wiki.largest())
    pairs = largest.where("place = 1").select("vault", F.col("page_id").alias("source")).join(largest.select("vault", F.col("page_id").alias("target")), "vault")
    return graph.shortest(wiki.neighbours, wiki.documents, pairs, False, wiki.scratch)


@query(_DISTANCES + """,
goal AS (SELECT s.page_id AS source, b.page_id AS target FROM start s JOIN (SELECT vault, arg_max(page_id, place) AS page_id FROM biggest GROUP BY vault) b ON b.vault = s.vault),
walk(source, node, path, ids) AS (
  SELECT s.page_id, s.page_id, [lower(b.name)], [s.page_id] FROM start s JOIN docs b ON b.page_id = s.page_id
  UNION ALL
  SELECT * FROM (SELECT w.source, e.b AS node, min(w.path || [lower(n.name)]) AS path, arg_min(w.ids || [e.b], w.path || [lower(n.name)]) AS ids
  FROM walk w JOIN adj e ON e.a = w.node JOIN d x ON x.source = w.source AND x.node = w.node JOIN d y ON y.source = w.source AND y.node = e.b AND y.distance = x.distance + 1
  JOIN docs n ON n.page_id = e.b GROUP BY w.source, e.b))
SELECT g.source, g.target, len(w.ids) - 1 AS distance, array_to_string(w.ids, '>') AS path FROM goal g JOIN walk w ON w.source = g.source AND w.node = g.target
""")
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """From the first to the last page, by name, of each vault's largest component."""
    wiki = _wiki(spark, folder)
    ends = wiki.largest().groupBy("vault").agg(F.min_by("page_id", "place").alias("source"), F.max_by("page_id", "place").alias("target"))
    return wiki.paths(ends).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


_SAMPLED = f"""
{_LABELS}, {_SIZES}, n AS (SELECT vault, max(place) AS n, max(place) * (max(place) - 1) // 2 AS total FROM biggest GROUP BY vault HAVING max(place) > 1),
draw AS (SELECT vault, total, i, ('0x' || substr(md5(vault || '|1|' || i), 1, 15))::BIGINT AS h
         FROM (SELECT vault, total, unnest(range(CASE WHEN total <= {2 * SAMPLES} THEN total ELSE {3 * SAMPLES + 64} END)) AS i FROM n)),
numbered AS (SELECT vault, CASE WHEN total <= {2 * SAMPLES} THEN i ELSE h % total END AS r, min(CASE WHEN total <= {2 * SAMPLES} THEN h ELSE i END) AS o FROM draw GROUP BY ALL),
kept AS (SELECT vault, r FROM numbered QUALIFY row_number() OVER (PARTITION BY vault ORDER BY o, r) <= {SAMPLES}),
pair AS (SELECT k.vault, x.page_id AS source, y.page_id AS target FROM kept k JOIN biggest y ON y.vault = k.vault AND (y.place - 1) * (y.place - 2) // 2 <= k.r AND k.r < y.place * (y.place - 1) // 2
         JOIN biggest x ON x.vault = k.vault AND x.place - 1 = k.r - (y.place - 1) * (y.place - 2) // 2),
d(source, node, distance) USING KEY (source, node) AS (
  SELECT DISTINCT source, source, 0::BIGINT FROM pair
  UNION
  SELECT d.source, e.b, min(d.distance) + 1 FROM d JOIN adj e ON e.a = d.node LEFT JOIN recurring.d r ON r.source = d.source AND r.node = e.b
  WHERE r.node IS NULL GROUP BY d.source, e.b),
far AS (SELECT p.vault, p.source, p.target, d.distance FROM pair p JOIN d ON d.source = p.source AND d.node = p.target)
"""


@query(_SAMPLED + "SELECT source, target, distance FROM far")
def sampled_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).sampled_distances(SAMPLES).select("source", "target", "distance")


@query(_SAMPLED + "SELECT vault, count(*) AS pairs, round(avg(distance), 9) AS average, max(distance) AS longest FROM far GROUP BY vault")
def path_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Average shortest path and sampled diameter of each vault's largest component."""
    return graph.path_statistics(_wiki(spark, folder).sampled_distances(SAMPLES)).withColumn("average", F.round("average", 9))


# Wanted pages start from the table of links, whose rows arrive late and repeated.
_WANTED = """
once AS (SELECT DISTINCT link_id, vault, src_page, link_pos, display_target, target_key, context FROM links WHERE target_key IS NOT NULL AND target_key <> ''),
lost AS (SELECT o.*, regexp_replace(p.rel_path, '(?i)[.]md$', '') AS rel_path, p.name AS document, p.excerpt FROM once o LEFT JOIN wiki_pages w ON w.vault = o.vault AND w.key = o.target_key
         JOIN wiki_pages p ON p.page_id = o.src_page WHERE w.page_id IS NULL),
wanted_now AS (SELECT vault, target_key, arg_min(split_part(display_target, '#', 1), struct_pack(a := lower(rel_path), b := link_pos)) AS name, count(*) AS mentions, count(DISTINCT src_page) AS docs
           FROM lost GROUP BY vault, target_key),
places AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY mentions DESC, docs DESC, lower(name), target_key) AS place FROM wanted_now),
sources AS (SELECT vault, target_key, document, coalesce(nullif(context, ''), nullif(excerpt, ''), '(empty)') AS context, count(*) AS mentions FROM lost
            GROUP BY vault, target_key, src_page, document, coalesce(nullif(context, ''), nullif(excerpt, ''), '(empty)'))
"""


def _table_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, folder, "wiki_pages")
    once = table(spark, folder, "links").select("link_id", "vault", "src_page", "link_pos", "display_target", "target_key", "context").distinct()
    return resolve.resolve_flat(once, pages), pages


@query(f"WITH {_WANTED} SELECT * FROM wanted_now")
def wanted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return wanted.wanted_pages(*_table_links(spark, folder))


@query(f"WITH {_WANTED} SELECT vault, target_key, name, mentions, docs, place::INTEGER AS place FROM places WHERE place <= 10")
def wanted_top(spark: SparkSession, folder: str) -> DataFrame:
    return wanted.ranked(wanted.wanted_pages(*_table_links(spark, folder)), 10)


@query(f"WITH {_WANTED} SELECT * FROM sources")
def wanted_sources(spark: SparkSession, folder: str) -> DataFrame:
    return wanted.wanted_sources(*_table_links(spark, folder))


@query(f"""
WITH {_WANTED} SELECT vault, target_key, document, context, mentions FROM sources
QUALIFY row_number() OVER (PARTITION BY vault, target_key ORDER BY mentions DESC, lower(document), lower(context), context) <= 3
""")
def wanted_first_sources(spark: SparkSession, folder: str) -> DataFrame:
    return wanted.first_sources(wanted.wanted_sources(*_table_links(spark, folder)), 3)


@query("""
SELECT p.page_id, p.visible_lines, p.words, p.norm FROM page_stats p
""")
def page_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).statistics.select("page_id", "visible_lines", "words", "norm")


_STATS = "s AS (SELECT p.page_id, p.visible_lines, p.words, w.vault, regexp_replace(w.rel_path, '(?i)[.]md$', '') AS rel_path FROM page_stats p JOIN wiki_pages w ON w.page_id = p.page_id)"


@query(f"""
WITH {_STATS} SELECT vault, page_id, visible_lines, words, row_number() OVER (PARTITION BY vault ORDER BY words DESC, visible_lines DESC, lower(rel_path))::INTEGER AS place
FROM s WHERE visible_lines >= 40 OR words >= 400 QUALIFY place <= 10
""")
def long_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = _wiki(spark, folder).long_pages(lines=40, words=400)
    return found.select("vault", "page_id", "visible_lines", "words", "place")


@query(f"""
WITH {_STATS} SELECT vault, page_id, visible_lines, words, row_number() OVER (PARTITION BY vault ORDER BY words, visible_lines, lower(rel_path))::INTEGER AS place
FROM s WHERE words > 0 AND words <= 40 QUALIFY place <= 10
""")
def short_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _wiki(spark, folder).short_pages().select("vault", "page_id", "visible_lines", "words", "place")


@query(f"""
WITH {_STATS}, c AS (SELECT vault, count(*) AS pages, count(*) FILTER (visible_lines >= 120 OR words >= 1200) AS long_pages, count(*) FILTER (words > 0 AND words <= 40) AS short_pages FROM s GROUP BY vault)
SELECT *, long_pages / pages::DOUBLE AS long_rate, short_pages / pages::DOUBLE AS short_rate FROM c
""")
def length_rates(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.rates(_wiki(spark, folder).sizes)


@query("""
SELECT page_id, len(shingles)::INTEGER AS shingle_count, len(winnow)::INTEGER AS winnow_count, md5(array_to_string(shingles, ',')) AS shingles, md5(array_to_string(winnow, ',')) AS winnow FROM fingerprints
""")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints as digests of their lists."""
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return _wiki(spark, folder).fingerprints.select("page_id", F.size("shingles").alias("shingle_count"), F.size("winnow").alias("winnow_count"), digest("shingles"), digest("winnow"))


_PAIRS = """
f AS (SELECT f.page_id, w.vault, f.shingles, f.winnow FROM fingerprints f JOIN wiki_pages w ON w.page_id = f.page_id),
h AS (SELECT vault, page_id, unnest(winnow) AS h FROM f),
few AS (SELECT vault, h FROM h GROUP BY vault, h HAVING count(*) BETWEEN 2 AND 64),
p AS (SELECT x.vault, x.page_id AS a, y.page_id AS b, count(*) AS hits FROM few JOIN h x ON x.vault = few.vault AND x.h = few.h JOIN h y ON y.vault = few.vault AND y.h = few.h AND x.page_id < y.page_id
      GROUP BY ALL HAVING count(*) >= 3)
"""


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fingerprints").join(table(spark, folder, "wiki_pages").select("page_id", "vault"), "page_id")


@query(f"WITH {_PAIRS} SELECT vault, a, b, hits FROM p")
def duplicate_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.candidates(_prints(spark, folder))


@query(f"""
WITH {_PAIRS}, c AS (SELECT p.vault, a, b, len(list_intersect(x.shingles, y.shingles)) AS shared, len(x.shingles) AS m, len(y.shingles) AS n FROM p JOIN f x ON x.page_id = a JOIN f y ON y.page_id = b),
s AS (SELECT *, shared / (m + n - shared)::DOUBLE AS jaccard, shared / least(m, n)::DOUBLE AS containment, least(m, n) / greatest(m, n)::DOUBLE AS ratio FROM c),
t AS (SELECT vault, a, b, shared, jaccard, containment, CASE WHEN ratio >= 0.6 THEN greatest(jaccard, 0.95 * containment) ELSE jaccard END AS score FROM s)
SELECT vault, a, b, shared, jaccard, containment, score FROM t WHERE score >= 0.82 AND shared >= 24
""")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    prints = Scratch(spark).save(_prints(spark, folder))
    return duplicates.near_duplicates(prints)


@query(r"""
WITH ids AS (
  SELECT vault, page_id, name AS id FROM wiki_pages
  UNION ALL SELECT w.vault, w.page_id, f.title FROM wiki_pages w JOIN front_matter f ON f.page_id = w.page_id
  UNION ALL SELECT w.vault, w.page_id, unnest(f.aliases) FROM wiki_pages w JOIN front_matter f ON f.page_id = w.page_id)
SELECT DISTINCT vault, lower(nfc_normalize(regexp_replace(split_part(id, '#', 1), '(?i)\.md$', ''))) AS id_key, page_id FROM ids WHERE id IS NOT NULL AND id <> ''
""")
def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.identifiers(table(spark, folder, "wiki_pages"), table(spark, folder, "front_matter"))


@query(f"SELECT vault, id_key, count(*) AS pages FROM ({ORACLES['identifiers']}) GROUP BY vault, id_key HAVING count(*) > 1")
def ambiguous_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return identifiers(spark, folder).groupBy("vault", "id_key").agg(F.count("*").alias("pages")).where("pages > 1")


@query("SELECT key, count(*) AS vaults FROM wiki_pages GROUP BY key HAVING count(*) > 1")
def shared_names(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that would clash if all vaults were one."""
    return _wiki(spark, folder).documents.groupBy("key").agg(F.count("*").alias("vaults")).where("vaults > 1")


@query(f"""
WITH {_LINKS}, old AS (SELECT page_id, vault, key FROM docs ORDER BY page_id LIMIT 1), n AS (SELECT l.src_page AS page_id, count(*) AS links FROM l JOIN old ON l.vault = old.vault AND l.tk = old.key GROUP BY l.src_page)
SELECT coalesce(n.page_id, old.page_id) AS page_id, coalesce(n.links, 0)::INTEGER AS links FROM n FULL JOIN old ON n.page_id = old.page_id
""")
def rename_preview(spark: SparkSession, folder: str) -> DataFrame:
    """What renaming the first page would touch, and how many links in each file."""
    wiki = _wiki(spark, folder)
    first = wiki.documents.orderBy("page_id").head(1)
    if not first:
        return wiki.spark.createDataFrame([], "page_id long, links int")
    return wiki.renamed(first[0]["name"], "Renamed page", first[0]["vault"]).select("page_id", "links")


def nested_files(spark: SparkSession, folder: str) -> DataFrame:
    """A nested collection of nations and customers in folders by region, linked in every way a path can be."""
    region, nation, customer = (table(spark, folder, name) for name in ("region", "nation", "customer"))
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    top = places.select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("page_id"), F.concat("r_name", F.lit("/"), "n_name", F.lit(".md")).alias("rel_file"), F.concat(F.lit("About "), "n_name", F.lit(".\n")).alias("content"))
    people = customer.join(F.broadcast(places), customer["c_nationkey"] == places["n_nationkey"])
    kind = F.col("c_custkey") % 5
    link = (
        F.when(kind == 0, F.concat(F.lit("[["), "n_name", F.lit("]]"))).when(kind == 1, F.concat(F.lit("[["), "r_name", F.lit("/"), "n_name", F.lit("|home]]")))
        .when(kind == 2, F.concat(F.lit("[home](../"), "n_name", F.lit(".md)"))).when(kind == 3, F.concat(F.lit("[[../"), "n_name", F.lit("#people]]"))).otherwise(F.concat(F.lit("[home]("), "n_name", F.lit(".md)")))
    )
    path = F.concat("r_name", F.lit("/"), "n_name", F.lit("/Customer "), F.col("c_custkey").cast("string"), F.lit(".md"))
    low = people.select(F.col("c_custkey").alias("page_id"), path.alias("rel_file"), F.concat(F.lit("Lives in "), link, F.lit(".\n")).alias("content"))
    return top.unionByName(low).select("page_id", F.lit("nations").alias("vault"), "rel_file", "content", F.lit(None).cast("timestamp").alias("received_at"))


@query("SELECT c_custkey AS src_page, CASE WHEN c_custkey % 5 < 4 THEN c_nationkey + 1000000000::BIGINT END AS resolved FROM customer")
def nested_links(spark: SparkSession, folder: str) -> DataFrame:
    return Wiki(nested_files(spark, folder), nested=True).links.select("src_page", "resolved")


from lorewell.plans import texts  # noqa: E402, F401  (registers its queries)
