"""Link resolution and identifier lookup: equi-joins on keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lorewell.functions.names import clean_relative, folder_of, key_column, path_key, resolve_from
from lorewell.session import Scratch


def resolve_flat(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``links`` with ``resolved``, the page of the same vault with the link's key, or null."""
    keys = documents.select("vault", F.col("key").alias("target_key"), F.col("page_id").alias("resolved"))
    return links.drop("resolved").join(keys, ["vault", "target_key"], "left")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _path_keys(kind: pd.Series, raw: pd.Series, source: pd.Series) -> pd.Series:
    """Path keys a link may mean, the preferred first; none for a bare name."""

    def of(kind, raw, source):
        near = path_key(resolve_from(folder_of(source), raw))
        if kind == "markdown" or raw.startswith(("./", "../")):
            return [near]
        if "/" in raw or "\\" in raw:
            return [path_key(clean_relative(raw)), near]
        return []

    return pd.Series([of(*x) for x in zip(kind, raw, source)])


def resolve_nested(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Resolution in nested collections: Markdown and dotted links from the document's folder,
    paths from the root and then from the folder, bare names by the least deep document.

    ``links`` needs ``src_path``; ``documents`` is (vault, rel_path, key, base_key, page_id).
    """
    marked = links.drop("resolved").withColumn("paths", _path_keys("kind", "raw_target", "src_path"))
    keys = documents.select("vault", "key", "page_id")
    first = keys.select("vault", F.col("key").alias("k1"), F.col("page_id").alias("r1"))
    second = keys.select("vault", F.col("key").alias("k2"), F.col("page_id").alias("r2"))
    depth = F.size(F.split("rel_path", "/"))
    best = documents.groupBy("vault", "base_key").agg(F.min_by("page_id", F.struct(depth, F.lower("rel_path"))).alias("r3"))
    bare = best.select("vault", F.col("base_key").alias("k3"), "r3")
    keyed = marked.withColumn("k1", F.get("paths", F.lit(0))).withColumn("k2", F.get("paths", F.lit(1))).withColumn("k3", F.when(F.size("paths") == 0, F.col("target_key")))
    joined = keyed.join(first, ["vault", "k1"], "left").join(second, ["vault", "k2"], "left").join(bare, ["vault", "k3"], "left")
    return joined.withColumn("resolved", F.coalesce("r1", "r2", "r3")).drop("paths", "k1", "k2", "k3", "r1", "r2", "r3")


def identifiers(documents: DataFrame, front: DataFrame) -> DataFrame:
    """(vault, id_key, page_id): all keys under which a page can be looked up."""
    named = documents.select("vault", "page_id", F.col("name").alias("id"))
    titled = documents.select("vault", "page_id").join(front, "page_id")
    titles = titled.select("vault", "page_id", F.col("title").alias("id"))
    aliases = titled.select("vault", "page_id", F.explode("aliases").alias("id"))
    every = named.unionByName(titles).unionByName(aliases).where("id is not null").withColumn("id_key", key_column(F.col("id")))
    return every.where("id_key <> ''").select("vault", "id_key", "page_id").distinct()


def lookups(documents: DataFrame, front: DataFrame, asked: DataFrame) -> DataFrame:
    """(vault, id_key, outcome, page_id) of many (vault, id_key): 'found', 'not found' or 'ambiguous'.

    A page's own key comes before names, titles and aliases.
    """
    own = documents.select("vault", F.col("key").alias("id_key"), F.col("page_id").alias("own"))
    named = identifiers(documents, front).groupBy("vault", "id_key").agg(F.count("*").alias("pages"), F.min("page_id").alias("named"))
    joined = asked.select("vault", "id_key").distinct().join(own, ["vault", "id_key"], "left").join(named, ["vault", "id_key"], "left")
    page = F.coalesce("own", F.when(F.col("pages") == 1, F.col("named")))
    outcome = F.when(page.isNotNull(), "found").when(F.col("pages").isNull(), "not found").otherwise("ambiguous")
    return joined.select("vault", "id_key", outcome.alias("outcome"), page.alias("page_id"))


def lookup(documents: DataFrame, front: DataFrame, identifier: str, vault: str) -> int:
    """The page an identifier means in a vault: by its own key, else by name, title or alias.

    ``LookupError`` if there is none or several.
    """
    from lorewell.functions.names import document_key

    here = documents.where(F.col("vault") == vault)
    asked = documents.sparkSession.createDataFrame([(vault, document_key(identifier))], "vault string, id_key string").where("id_key <> ''")
    found = lookups(here, front, asked).head(1)
    if not found or found[0]["outcome"] == "not found":
        raise LookupError(f'document "{identifier}" not found')
    if found[0]["outcome"] == "ambiguous":
        raise LookupError(f'document identifier "{identifier}" is ambiguous')
    return found[0]["page_id"]


def duplicate_keys(documents: DataFrame) -> DataFrame:
    """(vault, key, pages, rel_path) of keys that several pages share, which a vault must not have.

    ``rel_path`` is the path, without extension, of the second page in the order of paths.
    """
    path = F.regexp_replace("rel_path", r"(?i)\.md$", "")
    rows = documents.select("vault", "key", F.struct(F.lower(path).alias("low"), path.alias("rel_path"), "page_id").alias("p"))
    first = rows.groupBy("vault", "key").agg(F.count("*").alias("pages"), F.min("p").alias("first")).where("pages > 1")
    later = rows.join(first, ["vault", "key"]).where("p <> first").groupBy("vault", "key", "pages").agg(F.min("p").alias("second"))
    return later.select("vault", "key", "pages", F.col("second.rel_path").alias("rel_path"))


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct directed (vault, src, dst) between different pages."""
    return resolved.where("resolved is not null and resolved <> src_page").select("vault", F.col("src_page").alias("src"), F.col("resolved").alias("dst")).distinct()


def neighbours(directed: DataFrame) -> DataFrame:
    """Distinct undirected (vault, a, b), in both directions."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return directed.select("vault", ends.alias("e")).select("vault", "e.a", "e.b").distinct()


def outgoing(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """(vault, src_page, missing, name): what each page links to, once per name, itself included.

    Existing pages go by their name, missing ones by the display target with its heading;
    of spellings that differ only in case the last one stands.
    """
    names = documents.select(F.col("page_id").alias("resolved"), F.col("name").alias("page_name"))
    named = resolved.join(names, "resolved", "left")
    named = named.withColumn("missing", F.col("page_name").isNull()).withColumn("shown", F.coalesce("page_name", "display_target"))
    grouped = named.groupBy("vault", "src_page", "missing", F.lower("shown").alias("low")).agg(F.max_by("shown", "link_pos").alias("name"))
    return grouped.select("vault", "src_page", "missing", "name")


def ordered(frame: DataFrame, scratch: Scratch, *order) -> DataFrame:
    """``frame`` with ``place`` from 1 in each vault, in the given order (a total one) or that of lower-case names.

    Rows are ranged over the partitions by vault and order, numbered inside each, and shifted
    by what the partitions before hold of their vault; no vault is sorted in one task.
    """
    order = order or (F.lower("name"), F.col("page_id"))
    ranged = scratch.save(frame.repartitionByRange("vault", *order).withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("k", F.row_number().over(Window.partitionBy("vault", "part").orderBy(*order)))
    held = ranged.groupBy("vault", "part").agg(F.count("*").alias("n"))
    before = held.withColumn("shift", F.sum("n").over(Window.partitionBy("vault").orderBy("part")) - F.col("n"))  # one row a partition
    placed = inside.join(before.select("vault", "part", "shift"), ["vault", "part"])
    return placed.withColumn("place", (F.col("shift") + F.col("k")).cast("int")).drop("part", "k", "shift")
