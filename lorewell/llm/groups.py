"""Problem 2: consolidate pairwise matches into groups (connected components).

Method: deterministic Borůvka hooking. Every component selects its smallest outgoing
edge under the total order (smaller end, larger end), the selected edges form trees that
collapse by pointer doubling, and the edges are relabelled and deduplicated until none
remain. Every round at least halves the number of components that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorewell.session import Scratch


def groups_of_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, group_id) for every node of a pair of two different nodes.

    ``pairs`` may hold repeats, both directions, self pairs and nulls (a pair with a null
    end joins nothing); other columns are ignored. ``group_id`` is the smallest node of
    the group. An empty input gives an empty result. Node type: any orderable integer.

    Scale: each round is a map-side combined minimum per component and joins of two long
    columns; no group is gathered anywhere, so one group may hold any share of all nodes.
    Hot components are split by the adaptive skew join.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark)
    edges = (
        pairs.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        .distinct()
    )
    edges = scratch.save(edges)
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        parents = _collapsed(scratch, _hooked(edges))
        levels.append(parents)
        to_u = parents.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = parents.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        relabelled = (
            edges.join(to_u, "u")
            .join(to_v, "v")
            .where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        following = scratch.save(relabelled)
        scratch.drop(edges)
        edges = following
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group_id")).where("false")
    # The trees of later rounds are far smaller: resolve them from the last round back.
    final = levels[-1]
    for parents in reversed(levels[:-1]):
        above = final.select(F.col("node").alias("root"), F.col("root").alias("top"))
        final = parents.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    final = scratch.save(final)
    smallest = final.groupBy("root").agg(F.min("node").alias("group_id"))
    return final.join(smallest, "root").select("node", "group_id")


def _hooked(edges: DataFrame) -> DataFrame:
    """Each component with the other end of its smallest edge; of a mutual pair the smaller is the root."""
    ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("node"))
    chosen = ends.groupBy("node").agg(F.min(F.struct("u", "v")).alias("e"))
    chosen = chosen.select("node", "e", F.when(F.col("node") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("root"))
    # Edge order is total, so the only cycles are mutual choices: two nodes that chose one edge.
    mutual = chosen.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e")
    roots = mutual.select(F.col("e.u").alias("node"), F.lit(True).alias("is_root"))
    return chosen.join(roots, "node", "left").select("node", F.when(F.col("is_root"), F.col("node")).otherwise(F.col("root")).alias("root"))


def _collapsed(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at its tree's root."""
    parents = scratch.save(parents)
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        doubled = scratch.save(parents.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        scratch.drop(parents)
        parents = doubled
        if parents.where("moved").isEmpty():
            return parents.select("node", "root")


def link_pairs(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(a, b) of every link between two different pages; both must be page ids of ``pages``."""
    ids = pages.select(F.col("page_id").alias("id")).where("id is not null").distinct()
    pairs = links.select(F.col("src_page").alias("a"), F.col("resolved").alias("b")).where("a <> b").distinct()
    return pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def page_groups(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, group_id) of every page in a group of two or more pages."""
    found = groups_of_pairs(link_pairs(links, pages))
    return found.select(F.col("node").alias("page_id"), "group_id")


def all_page_groups(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, group_id) of every page; an unlinked page is its own group."""
    found = page_groups(links, pages).withColumnRenamed("group_id", "g")
    every = pages.select("page_id").where("page_id is not null").distinct()
    return every.join(found, "page_id", "left").select("page_id", F.coalesce("g", "page_id").alias("group_id"))
