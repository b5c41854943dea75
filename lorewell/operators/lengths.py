"""Unusually long and short pages, and how frequent they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LONG_LINES, LONG_WORDS, SHORT_WORDS = 120, 1200, 40


def is_long(lines: int = LONG_LINES, words: int = LONG_WORDS) -> Column:
    return (F.col("visible_lines") >= lines) | (F.col("words") >= words)


def is_short(words: int = SHORT_WORDS) -> Column:
    return (F.col("words") > 0) & (F.col("words") <= words)


def _first(pages: DataFrame, order: list[Column], limit: int) -> DataFrame:
    window = Window.partitionBy("vault").orderBy(*order, F.lower("rel_path"))
    return pages.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def long_pages(stats: DataFrame, limit: int = 10, lines: int = LONG_LINES, words: int = LONG_WORDS) -> DataFrame:
    """The longest pages of each vault: most words, then most lines, then path."""
    return _first(stats.where(is_long(lines, words)), [F.desc("words"), F.desc("visible_lines")], limit)


def short_pages(stats: DataFrame, limit: int = 10, words: int = SHORT_WORDS) -> DataFrame:
    """The shortest pages with words of each vault: fewest words, then fewest lines, then path."""
    return _first(stats.where(is_short(words)), [F.asc("words"), F.asc("visible_lines")], limit)


def rates(stats: DataFrame, lines: int = LONG_LINES, words: int = LONG_WORDS, short: int = SHORT_WORDS) -> DataFrame:
    """(vault, pages, long_pages, short_pages, long_rate, short_rate) over all pages of each vault."""
    counted = stats.groupBy("vault").agg(F.count("*").alias("pages"), F.count_if(is_long(lines, words)).alias("long_pages"), F.count_if(is_short(short)).alias("short_pages"))
    return counted.withColumn("long_rate", F.col("long_pages") / F.col("pages")).withColumn("short_rate", F.col("short_pages") / F.col("pages"))
