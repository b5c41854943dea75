"""Graph operators over (vault, a, b) neighbours: components, shortest paths, sampled pairs.

Loops run level by level on DataFrames; each level is written to the shared folder, so the
lineage stays short and no level is lost with an executor. Nothing but counts reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorewell.operators.resolve import ordered
from lorewell.session import Scratch


def components(neighbours: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): each linked node with the smallest node it is connected to.

    Alternating stars: larger neighbours move to a node's smallest neighbour, then smaller
    ones do, until nothing moves; the number of rounds grows with the logarithm of the size.
    """
    scratch = scratch or Scratch(neighbours.sparkSession)
    # Every edge from its larger to its smaller end.
    star = scratch.save(neighbours.where("a > b").select(F.col("a").alias("node"), F.col("b").alias("low")).distinct())
    digest = lambda frame: tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "low")), F.bit_xor(F.xxhash64("low", "node"))).first())
    before = digest(star)
    while True:
        both = star.select(F.explode(F.array(F.struct("node", F.col("low").alias("other")), F.struct(F.col("low").alias("node"), F.col("node").alias("other")))).alias("e")).select("e.*")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("low")).distinct()
        large = scratch.save(large)
        smallest = large.groupBy("node").agg(F.min("low").alias("least"))
        moved = large.join(smallest, "node").where("low <> least").select(F.col("low").alias("node"), F.col("least").alias("low"))
        following = scratch.save(moved.unionByName(smallest.select("node", F.col("least").alias("low"))).distinct())
        scratch.drop(large)
        scratch.drop(star)
        star, after = following, digest(following)
        if after == before:  # the same distinct edges, by count and two digests of 64 bits
            break
        before = after
    roots = star.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return star.select("node", F.col("low").alias("component")).unionByName(roots)


def component_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(vault, component, pages, first_name) of each component."""
    named = documents.select("vault", F.col("page_id").alias("node"), "name").join(labels, "node")
    return named.groupBy("vault", "component").agg(F.count("*").alias("pages"), F.min(F.lower("name")).alias("first_name"))


def component_sizes(documents: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(vault, component, pages, first_name, place) of each component, the largest of a vault first."""
    scratch = scratch or Scratch(documents.sparkSession)
    return ordered(component_counts(documents, labels), scratch, F.desc("pages"), F.asc("first_name"), F.asc("component"))


def largest_members(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(vault, page_id, name) of each vault's largest component; of equal ones the one whose name comes first."""
    first = component_counts(documents, labels).groupBy("vault").agg(F.min(F.struct(-F.col("pages"), "first_name", "component")).alias("c"))
    named = documents.select("vault", "page_id", "name").join(labels.withColumnRenamed("node", "page_id"), "page_id")
    return named.join(first.select(F.col("c.component").alias("component")), "component", "left_semi").select("vault", "page_id", "name")


def members(documents: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(vault, page_id, name, component, place) of the linked pages."""
    named = documents.select("vault", "page_id", "name").join(labels.withColumnRenamed("node", "page_id"), "page_id")
    return named.join(sizes.select("component", "place"), "component").select("vault", "page_id", "name", "component", "place")


def orphans(documents: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Pages without a neighbour."""
    return documents.join(neighbours.select(F.col("a").alias("page_id")).distinct(), "page_id", "left_anti")


def shortest(neighbours: DataFrame, names: DataFrame, pairs: DataFrame, paths: bool, scratch: Scratch | None = None) -> DataFrame:
    """(source, target, distance[, path]) of each reachable pair; ``path`` holds page ids.

    Of several shortest paths the one whose lower-case names come first is taken. Both ends
    of all pairs advance together, a level each a round, and a pair is done where its two
    levels meet: so each end sees half the way, not its whole component. In an undirected
    graph a new level can only repeat the two before it, so only those are kept apart.
    ``pairs`` is (source, target), ``names`` (page_id, name).
    """
    scratch = scratch or Scratch(neighbours.sparkSession)
    open_pairs = scratch.save(pairs.select("source", "target").distinct())
    graph = neighbours.select(F.col("a").alias("node"), F.col("b").alias("next"))
    if paths:
        graph = graph.join(names.select(F.col("page_id").alias("next"), F.lower("name").alias("next_name")), "next")
    graph = scratch.save(graph)

    def start(end: str) -> DataFrame:
        at = open_pairs.select(end).distinct().withColumn("node", F.col(end))
        if not paths:
            return at
        own = names.select(F.col("page_id").alias("node"), F.lower("name").alias("low"))
        return at.join(own, "node").select(end, "node", F.array(F.struct("low", F.col("node").alias("id"))).alias(f"from_{end}"))

    def grown(end: str, level: DataFrame, before: DataFrame | None, open_pairs: DataFrame) -> DataFrame:
        live = level.join(open_pairs.select(end).distinct(), end, "left_semi").join(graph, "node")
        if paths:
            here, way = F.array(F.struct(F.col("next_name").alias("low"), F.col("next").alias("id"))), F.col(f"from_{end}")
            longer = F.concat(way, here) if end == "source" else F.concat(here, way)
            step = live.select(end, F.col("next").alias("node"), longer.alias("way")).groupBy(end, "node").agg(F.min("way").alias(f"from_{end}"))
        else:
            step = live.select(end, F.col("next").alias("node")).distinct()
        seen = level.select(end, "node")
        if before is not None:
            seen = seen.unionByName(before.select(end, "node"))
        return scratch.save(step.join(seen, [end, "node"], "left_anti"))

    def met(open_pairs: DataFrame, ahead: DataFrame, behind: DataFrame, distance: int) -> DataFrame:
        meeting = open_pairs.join(ahead, "source").join(behind, ["target", "node"])
        columns = ["source", "target", F.lit(distance).cast("long").alias("distance")]
        if not paths:
            return meeting.select(*columns).distinct()
        rest = F.slice("from_target", 2, F.greatest(F.size("from_target") - 1, F.lit(0)))
        return meeting.select(*columns, F.concat("from_source", rest).alias("path")).groupBy("source", "target", "distance").agg(F.min("path").alias("path"))

    ahead, behind, ahead_before, behind_before = scratch.save(start("source")), scratch.save(start("target")), None, None
    found = scratch.save(met(open_pairs, ahead, behind, 0))
    results = [found]
    open_pairs = scratch.save(open_pairs.join(found, ["source", "target"], "left_anti"))
    distance = 0
    # Ends of open pairs that reach nothing new have no path; where that holds for all sources, the search is over.
    while not (open_pairs.isEmpty() or ahead.isEmpty()):
        following = grown("source", ahead, ahead_before, open_pairs)
        ahead_before, ahead = ahead, following
        following = grown("target", behind, behind_before, open_pairs)
        behind_before, behind = behind, following
        # Ends met after one step more of the source, or after one more of both.
        first, second = met(open_pairs, ahead, behind_before, distance + 1), met(open_pairs, ahead, behind, distance + 2)
        value = F.struct("distance", *(["path"] if paths else []))
        hits = first.unionByName(second).groupBy("source", "target").agg(F.min(value).alias("v")).select("source", "target", "v.*")
        state = scratch.save(open_pairs.join(hits, ["source", "target"], "left"))
        results.append(state.where("distance is not null"))
        open_pairs = state.where("distance is null").select("source", "target")
        distance += 2
    result = results[0]
    for part in results[1:]:
        result = result.unionByName(part)
    return result.select("source", "target", "distance", *([F.transform("path", lambda x: x["id"]).alias("path")] if paths else []))


def sampled_pairs(places: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """(source, target) of at most ``samples`` pairs per vault, uniformly without replacement.

    ``places`` is (vault, page_id, place) with places from 1 to the vault's number of pages.
    All pairs are taken where there are no more than ``samples``. Otherwise pair numbers are
    drawn by hash and repeats dropped; where the samples are over half of all pairs, all
    pair numbers are ordered by hash instead.
    """
    spark = places.sparkSession
    counts = places.groupBy("vault").agg(F.max("place").alias("n")).where("n > 1").withColumn("total", F.expr("cast(n as long) * (n - 1) div 2"))
    draws = 3 * samples + 64
    width = F.when(F.col("total") <= 2 * samples, F.col("total")).otherwise(draws)
    drawn = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), width - 1)))
    text = F.concat_ws("|", "vault", F.lit(str(seed)), F.col("i").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    drawn = drawn.withColumn("h", number).withColumn("r", F.when(F.col("total") <= 2 * samples, F.col("i")).otherwise(F.pmod("h", "total")))
    drawn = drawn.withColumn("order", F.when(F.col("total") <= 2 * samples, F.col("h")).otherwise(F.col("i")))
    unique = drawn.groupBy("vault", "r").agg(F.min("order").alias("order"))
    kept = unique.withColumn("k", F.row_number().over(Window.partitionBy("vault").orderBy("order", "r"))).where(F.col("k") <= samples)  # at most ``draws`` rows a vault
    # Pair r joins place i to a later place j, numbered by j and then i.
    j = F.floor((F.sqrt(8.0 * F.col("r") + 1) + 1) / 2).cast("long")
    kept = kept.withColumn("j", j).withColumn("j", F.expr("case when j * (j - 1) div 2 > r then j - 1 when j * (j + 1) div 2 <= r then j + 1 else j end"))
    kept = kept.withColumn("i", F.expr("r - j * (j - 1) div 2"))
    first = places.select("vault", (F.col("place") - 1).alias("i"), F.col("page_id").alias("source"))
    second = places.select("vault", (F.col("place") - 1).alias("j"), F.col("page_id").alias("target"))
    return kept.select("vault", "i", "j").join(first, ["vault", "i"]).join(second, ["vault", "j"]).select("vault", "source", "target")


def path_statistics(distances: DataFrame) -> DataFrame:
    """(vault, pairs, average, longest) over (vault, distance)."""
    return distances.groupBy("vault").agg(F.count("*").alias("pairs"), F.avg("distance").alias("average"), F.max("distance").alias("longest"))


def longer_than_average(found: DataFrame) -> DataFrame:
    """The rows of (vault, distance, ...) whose distance is above their vault's average."""
    mean = found.groupBy("vault").agg(F.avg("distance").alias("average"))
    return found.join(mean, "vault").where("distance > average").drop("average")


def longest(found: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(vault, source, target, distance, path, place): the longest paths of each vault; of equal ones those whose names come first."""
    low = names.select(F.col("page_id").alias("node"), F.lower("name").alias("low"))
    steps = found.select("vault", "source", "target", "distance", "path", F.posexplode("path").alias("at", "node")).join(low, "node")
    named = steps.groupBy("vault", "source", "target", "distance", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "low"))), lambda x: x["low"]).alias("names"))
    order = Window.partitionBy("vault").orderBy(F.desc("distance"), "names", "source", "target")  # a bounded sample
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("names")
