"""Graph quality of each vault: orphans, islands, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorewell.operators import graph


def summary(documents: DataFrame, neighbours: DataFrame, link_only: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a vault: documents, covered documents, orphans, islands, link-only lines, the
    largest component's size (1 where all pages are orphans) and the ratios to all documents."""
    base = documents.groupBy("vault").agg(F.count("*").alias("documents"), F.count_if(F.trim(F.coalesce("excerpt", F.lit(""))) != "").alias("covered"))
    lone = graph.orphans(documents, neighbours).groupBy("vault").agg(F.count("*").alias("orphans"))
    sizes = graph.component_counts(documents, labels).groupBy("vault").agg(F.max("pages").alias("largest"), (F.count("*") - 1).alias("islands"))
    lines = link_only.groupBy("vault").agg(F.count("*").alias("link_only_lines"))
    rows = base.join(lone, "vault", "left").join(sizes, "vault", "left").join(lines, "vault", "left").fillna(0, ["orphans", "islands", "link_only_lines"])
    rows = rows.withColumn("largest", F.coalesce("largest", F.lit(1).cast("long")))
    for name, of in (("largest_component_ratio", "largest"), ("orphan_rate", "orphans"), ("content_coverage", "covered")):
        rows = rows.withColumn(name, F.col(of) / F.col("documents"))
    return rows
