"""Streams of delivered files and links: statistics as they arrive, counts of wanted pages by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.operators import parse


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def statistics_stream(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Statistics of every delivered content once; a page delivered again within ``delay`` is dropped."""
    timed = files.where("content is not null and received_at is not null").withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay)
    fresh = timed.withColumn("digest", F.xxhash64("content")).dropDuplicatesWithinWatermark(["page_id", "digest"])
    return parse.statistics(fresh.select("page_id", "vault", "rel_file", "content"))


def missing_link_windows(links: DataFrame, window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(window, vault, target_key, mentions) of unresolved links by the time they were seen; late rows count until ``delay``."""
    timed = links.where("resolved is null and target_key <> '' and seen_at is not null").withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", delay)
    once = timed.dropDuplicatesWithinWatermark(["link_id"])
    return once.groupBy(F.window("seen_at", window), "vault", "target_key").agg(F.count("*").alias("mentions"))
