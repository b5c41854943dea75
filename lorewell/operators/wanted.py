"""Wanted pages: links to pages that do not exist, ranked by how often they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorewell.operators.resolve import ordered
from lorewell.session import Scratch


def wanted_pages(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """(vault, target_key, name, mentions, docs) of unresolved keys.

    ``name`` is the first display target, without its heading, in the order of documents and links.
    """
    order = F.struct(F.lower("rel_path"), F.col("link_pos"))
    missing = _missing(resolved, documents)
    return missing.groupBy("vault", "target_key").agg(
        F.min_by(F.substring_index("display_target", "#", 1), order).alias("name"), F.count("*").alias("mentions"), F.count_distinct("src_page").alias("docs")
    )


def _missing(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    path = F.regexp_replace("rel_path", r"(?i)\.md$", "").alias("rel_path")
    pages = documents.select(F.col("page_id").alias("src_page"), path, F.col("name").alias("document"), "excerpt")
    return resolved.where("resolved is null and target_key is not null and target_key <> ''").join(pages, "src_page")


def wanted_sources(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """(vault, target_key, document, context, mentions): where each wanted page is mentioned."""
    context = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.nullif(F.col("excerpt"), F.lit("")), F.lit("(empty)"))
    missing = _missing(resolved, documents).withColumn("context", context)
    return missing.groupBy("vault", "target_key", "src_page", "document", "context").agg(F.count("*").alias("mentions")).drop("src_page")


def ranked(wanted: DataFrame, limit: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``wanted`` with ``place`` in its vault: most mentions, then most documents, then name; at most ``limit`` a vault.

    A limited ranking keeps only so many rows of each task before any vault is put together;
    a whole one is ranged over all tasks.
    """
    order = [F.desc("mentions"), F.desc("docs"), F.lower("name"), F.asc("target_key")]
    if limit is None:
        return ordered(wanted, scratch or Scratch(wanted.sparkSession), *order)
    window = Window.partitionBy("vault").orderBy(*order)
    return wanted.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def first_sources(sources: DataFrame, limit: int) -> DataFrame:
    """The first sources of each wanted page: most mentions, then document, then context; 0 keeps all."""
    if limit == 0:
        return sources
    order = Window.partitionBy("vault", "target_key").orderBy(F.desc("mentions"), F.lower("document"), F.lower("context"), "context")
    return sources.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")
