"""Queries of the training-data problems, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm import frequency, groups, lookalike, markup, mixing, neardup, quality, tokens, truncation, variants
from lorewell.llm.oracles import ORACLES  # noqa: F401
from lorewell.session import Scratch, table


def _page_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = quality.page_quality(table(spark, folder, "files"), table(spark, folder, "common_words"))
    stats = Scratch(spark).save(stats)
    return quality.scored(stats, quality.fit(stats, table(spark, folder, "page_labels")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _page_quality(spark, folder).where("chance > 0.5").select("page_id")


def p1_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _page_quality(spark, folder)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.page_groups(table(spark, folder, "links"), table(spark, folder, "wiki_pages"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.all_page_groups(table(spark, folder, "links"), table(spark, folder, "wiki_pages"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.look_alike_links(table(spark, folder, "links"), table(spark, folder, "wiki_pages"))


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical_names(table(spark, folder, "links"), table(spark, folder, "wiki_pages"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_pairs(table(spark, folder, "fingerprints"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_classes(table(spark, folder, "fingerprints"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.link_target_counts(table(spark, folder, "links")).where("mark is not null").select("target_key", "mark")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.link_target_counts(table(spark, folder, "links"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_links(*(table(spark, folder, name) for name in ("links", "wiki_pages", "front_matter")))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    known = variants.entities(table(spark, folder, "wiki_pages"), table(spark, folder, "front_matter"))
    return known.select("vault", "page_id", "kind", F.array_join("words", " ").alias("words"), F.array_join(F.array_sort("nicknames"), " ").alias("nicknames"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.marked_fields(table(spark, folder, "wiki_pages"), table(spark, folder, "page_stats"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_fields(table(spark, folder, "wiki_pages"), table(spark, folder, "page_stats"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"))


def _sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counted = tokens.encoded(docs.select(F.struct("doc_id", "source").alias("key"), "text"), "key")
    sized = counted.select("key.doc_id", "key.source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("tokens"))
    return Scratch(spark).save(sized)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_sized_documents(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs, targets = _sized_documents(spark, folder), table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mixture(docs, targets), docs, targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.decided(table(spark, folder, "documents"), Scratch(spark)).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.source_rates(truncation.decided(table(spark, folder, "documents"), Scratch(spark)))


def p10_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.decided(table(spark, folder, "documents"), Scratch(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_stats, p2_found, p2_groups, p3_found, p3_forms, p4_found, p4_classes, p5_found, p5_counts, p6_found, p6_entities, p7_found, p7_clean, p8_ids, p9_mixture, p9_shares, p10_found, p10_rates, p10_reasons)
}
