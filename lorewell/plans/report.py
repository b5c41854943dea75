"""Text reports over small result tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from lorewell.functions.names import document_line
from lorewell.operators import duplicates, graph, lengths, wanted
from lorewell.plans.wiki import Wiki

# Why each finding matters, how to mend it, and an example.
GUIDANCE = {
    "orphan": (
        "no resolved links connect these pages to the wiki graph, so readers and agents are unlikely to discover them.",
        "add a contextual link to or from a related page, or merge/delete the note if it has no durable role.",
        'add "Compare with [[Related page]] ..." from the orphan, or link to it from a relevant index page.',
    ),
    "island": (
        "this component links internally but is disconnected from the main wiki, so related knowledge is hard to reach.",
        "add one or two bridge links between a page below and a relevant page in the main component.",
        "connect the island's strongest overview page to one main-component page with a real relationship.",
    ),
    "link_only_line": (
        "a line with only one link gives no local context, and grep results become hard to interpret.",
        "add a short phrase explaining the relationship, or rewrite the link into a sentence.",
        "- [[Bayes theorem]] -> - See [[Bayes theorem]] for updating beliefs with evidence.",
    ),
    "sampled_diameter": (
        "these sampled paths are long, so related topics may only connect through many weak hops.",
        "inspect the endpoints and middle bridge pages; add contextual links or a bridge note where the relationship is real.",
        "if two endpoints are clearly related, add a sentence-level link from the stronger overview page.",
    ),
    "wanted_pressure": (
        "many notes point at these missing pages, so the wiki already depends on absent concepts.",
        "create the page, correct misspelled links, or consolidate equivalent names with a rename/redirect note.",
        "if [[Vector database]] is linked from many pages, create it as a hub or correct links to an existing page.",
    ),
    "long_pages": (
        "long pages often mix several concepts, making them harder to scan, link to, and maintain.",
        "split stable subtopics into separate pages, then leave a short summary with links.",
        'split "Machine learning" into "Supervised learning", "Evaluation metrics", and a short overview page.',
    ),
    "short_stubs": (
        "very short pages may add navigation cost without enough context to justify a separate note.",
        "expand the note, merge it into a stronger related page, or delete it if it is only a placeholder.",
        'merge "Backpropagation note" into [[Backpropagation]] unless it has a distinct role.',
    ),
    "near_duplicates": (
        "these pages share unusually similar text, which can split links and let two versions drift apart.",
        "compare both pages, merge the weaker one into the stronger one, then rename or update links as needed.",
        "keep the clearer page, move any unique detail into it, then update links from the weaker page.",
    ),
}
FILTERS = ("sampled-diameter", "wanted-pressure", "long-pages", "short-stubs", "near-duplicates")


def guidance(of: str) -> list[str]:
    return [f"// {label}: {text}" for label, text in zip(("why", "fix", "example"), GUIDANCE[of])]


def lines_for(wiki: Wiki) -> DataFrame:
    """(page_id, name, line): each page as one line of a report."""
    return wiki.documents.select("page_id", "name", document_line(F.col("name"), F.col("excerpt")).alias("line"))


def _shown(frame: DataFrame, wiki: Wiki, *order) -> list[str]:
    joined = frame.join(lines_for(wiki).drop("name"), "page_id")
    return [r["line"] for r in joined.orderBy(*order).select("line").toLocalIterator()]


def lint(wiki: Wiki) -> tuple[str, bool]:
    """The lint report of one vault, and whether it found anything."""
    rows = wiki.lint().collect()  # one row a vault
    if not rows:
        ratios = "largest_component_ratio=0.0000 orphan_rate=0.0000 content_coverage=0.0000"
        return f"// ok connected_graph documents=0 {ratios}", False
    r = rows[0]
    ratios = f"largest_component_ratio={r['largest_component_ratio']:.4f} orphan_rate={r['orphan_rate']:.4f} content_coverage={r['content_coverage']:.4f}"
    if not r["orphans"] and not r["islands"] and not r["link_only_lines"]:
        return f"// ok connected_graph documents={r['documents']} {ratios}", False
    out = [f"// lint_failed documents={r['documents']} orphans={r['orphans']} islands={r['islands']} link_only_lines={r['link_only_lines']} {ratios}"]
    if r["orphans"]:
        out += ["// orphan", *guidance("orphan"), *_shown(wiki.orphans().select("page_id", "name"), wiki, F.lower("name"))]
    if r["islands"]:
        island = 0
        for row in wiki.islands().join(lines_for(wiki).drop("name"), "page_id").orderBy("place", F.lower("name")).toLocalIterator():
            if row["place"] - 1 != island:
                island = row["place"] - 1
                out += [f"// island={island}", *(guidance("island") if island == 1 else [])]
            out.append(row["line"])
    if r["link_only_lines"]:
        out += ["// link_only_line", *guidance("link_only_line")]
        out += [f"[[{x['name']}]]:{x['line']}: {x['text']}" for x in wiki.link_only_lines.orderBy(F.lower("name"), "line").toLocalIterator()]
    return "\n".join(out), True


def links(wiki: Wiki, page_id: int) -> str:
    known = lines_for(wiki)
    out = ["// this page", *[r["line"] for r in known.where(F.col("page_id") == page_id).collect()], "// incoming links"]
    incoming = wiki.edges.where(F.col("dst") == page_id).select(F.col("src").alias("page_id")).join(known, "page_id").orderBy(F.lower("name"))
    out += [r["line"] for r in incoming.toLocalIterator()] or ["// none"]
    found = wiki.outgoing().where(F.col("src_page") == page_id)
    existing = found.where("not missing").join(known, "name").select("line", "missing", "name")
    missing = found.where("missing").select(F.concat(F.lit("[["), "name", F.lit("]]: (missing)")).alias("line"), "missing", "name")
    outgoing = existing.unionByName(missing).orderBy("missing", F.lower("name"))
    return "\n".join([*out, "// outgoing links", *([r["line"] for r in outgoing.toLocalIterator()] or ["// none"])])


def path(wiki: Wiki, source: int, target: int) -> str:
    """The pages of the shortest path; ``LookupError`` if there is none."""
    pair = wiki.spark.createDataFrame([(source, target)], "source long, target long")
    rows = wiki.paths(pair).collect()
    if not rows:
        names = {r["page_id"]: r["name"] for r in wiki.documents.where(F.col("page_id").isin(source, target)).collect()}
        raise LookupError(f'no path between "{names[source]}" and "{names[target]}"')
    return "\n".join(_path_lines(wiki, rows[0]["path"]))


def _path_lines(wiki: Wiki, pages: list[int]) -> list[str]:
    shown = {r["page_id"]: r["line"] for r in lines_for(wiki).where(F.col("page_id").isin(pages)).collect()}
    return [shown[p] for p in pages]


def _with_sources(wiki: Wiki, limit: int, sources: int) -> list[tuple]:
    """(wanted page, its first sources) of the first ``limit`` pages, by one job each; 0 gives all sources."""
    ranked = wiki.scratch.save(wiki.wanted_ranking(limit))
    pages = ranked.orderBy("place").collect()  # at most ``limit`` a vault
    mine = wiki.wanted_sources().join(F.broadcast(ranked.select("vault", "target_key", "place")), ["vault", "target_key"])
    mine = wanted.first_sources(mine.withColumnRenamed("place", "page"), sources)
    mine = mine.orderBy("page", F.desc("mentions"), F.lower("document"), F.lower("context"), "context")
    found = {page: list(rows) for page, rows in itertools.groupby(mine.toLocalIterator(), key=lambda r: r["page"])}
    return [(page, found.get(page["place"], [])) for page in pages]


def wanted_list(wiki: Wiki, limit: int = 10, sources: int = 10) -> str:
    blocks = []
    for page, rows in _with_sources(wiki, limit, sources + 1 if sources else 0):
        shown = rows[:sources] if sources else rows
        block = [f"[[{page['name']}]] ({page['mentions']} {'link' if page['mentions'] == 1 else 'links'})", "", *(f"- [[{s['document']}]]: {s['context']}" for s in shown)]
        blocks.append("\n".join(block + (["_ ..."] if len(rows) > len(shown) else [])))
    return "\n\n".join(blocks) or "_ none"


def average_path(wiki: Wiki, samples: int = 500, examples: int = 1, seed: int = 1) -> str:
    """Average path length of the largest component, with the longest paths above the average."""
    if samples < 1:
        raise ValueError("sample count must be positive")
    size = wiki.largest().count()
    if size < 2:
        raise ValueError("largest component must contain at least two documents")
    found = wiki.scratch.save(wiki.sampled_distances(samples, seed, paths=True))
    total = graph.path_statistics(found).first()
    out = [f"// avg_shortest_path component={size} samples={total['pairs']} avg={total['average']:.4f}"]
    return "\n".join(out + _shown_paths(wiki, graph.longest(graph.longer_than_average(found), wiki.documents, examples)))


def _shown_paths(wiki: Wiki, paths: DataFrame) -> list[str]:
    """The paths in their order with a line for each page, by one job."""
    steps = paths.select("place", "distance", F.posexplode("path").alias("at", "page_id")).join(lines_for(wiki), "page_id")
    out = []
    for row in steps.orderBy("place", "at").collect():  # a bounded number of paths
        out += [f"// path distance={row['distance']}"] if row["at"] == 0 else []
        out.append(row["line"])
    return out


def suggest(wiki: Wiki, filters: tuple[str, ...] = FILTERS, samples: int = 2000, paths: int = 5, limit: int = 10, seed: int = 1,
            long_lines: int = lengths.LONG_LINES, long_words: int = lengths.LONG_WORDS, short_words: int = lengths.SHORT_WORDS, threshold: float = duplicates.THRESHOLD) -> str:
    """Refactoring candidates; only the sections asked for are computed, in a fixed order."""
    out = [f"// suggest documents={wiki.documents.count()} filters={','.join(filters)}"]
    if "sampled-diameter" in filters:
        found = wiki.scratch.save(wiki.sampled_distances(samples, seed, paths=True)) if samples else None
        total = graph.path_statistics(found).head(1) if found is not None else []
        shown = _shown_paths(wiki, graph.longest(found, wiki.documents, paths)) if total else []
        count = sum(x.startswith("// path distance=") for x in shown)
        out.append(f"// sampled_diameter samples={total[0]['pairs'] if total else 0} sampled_diameter={total[0]['longest'] if total else 0} paths={count}")
        out += guidance("sampled_diameter") + shown
    if "wanted-pressure" in filters:
        pages = _with_sources(wiki, limit, 3)
        out += [f"// wanted_pressure pages={len(pages)}", *guidance("wanted_pressure"), *([] if pages else ["_ none"])]
        for page, rows in pages:
            out.append(f"[[{page['name']}]] mentions={page['mentions']} source_documents={page['docs']}")
            out += [f"- [[{s['document']}]]: {s['context']}" for s in rows]
    for name, label in (("long-pages", "long_pages"), ("short-stubs", "short_stubs")):
        if name not in filters:
            continue
        stats = wiki.sizes
        rates = lengths.rates(stats, long_lines, long_words, short_words).head(1)
        if name == "long-pages":
            hits, head = lengths.long_pages(stats, limit, long_lines, long_words), f"threshold_lines={long_lines} threshold_words={long_words} rate={rates[0]['long_rate'] if rates else 0:.4f}"
        else:
            hits, head = lengths.short_pages(stats, limit, short_words), f"threshold_words={short_words} rate={rates[0]['short_rate'] if rates else 0:.4f}"
        rows = hits.join(lines_for(wiki), "page_id").orderBy("place").collect()
        out += [f"// {label} {head} pages={len(rows)}", *guidance(label), *([] if rows else ["_ none"])]
        out += [f"{r['line']} lines={r['visible_lines']} words={r['words']}" for r in rows]
    if "near-duplicates" in filters:
        prints = wiki.scratch.save(fingerprints_for(wiki, short_words))
        pairs = wiki.scratch.save(duplicates.candidates(prints))
        scored = duplicates.scored(duplicates.possible(pairs, prints, threshold, duplicates.SHARED), prints).where((F.col("score") >= threshold) & (F.col("shared") >= duplicates.SHARED))
        rows = duplicates.best(scored, limit).orderBy("place").collect()
        out += [f"// near_duplicates threshold={threshold:.2f} candidates={pairs.count()} pairs={len(rows)}", *guidance("near_duplicates"), *([] if rows else ["_ none"])]
        shown = {r["page_id"]: r for r in lines_for(wiki).where(F.col("page_id").isin([p for r in rows for p in (r["a"], r["b"])])).collect()} if rows else {}
        for r in rows:
            a, b = shown[r["a"]], shown[r["b"]]
            out.append(f"[[{a['name']}]] <-> [[{b['name']}]] score={r['score']:.3f} containment={r['containment']:.3f} jaccard={r['jaccard']:.3f} shared_grams={r['shared']}")
            out += [f"- {a['line']}", f"- {b['line']}"]
    return "\n".join(out)


def fingerprints_for(wiki: Wiki, short_words: int) -> DataFrame:
    from lorewell.operators import parse

    return parse.fingerprints(wiki.statistics, max(short_words, 20))
