"""Near-duplicate pages of one vault: an inverted index of winnowed hashes, then exact scores."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

POSTINGS, SUPPORT, THRESHOLD, SHARED = 64, 3, 0.82, 24


def candidates(prints: DataFrame, postings: int = POSTINGS, support: int = SUPPORT) -> DataFrame:
    """(vault, a, b, hits) of pairs that share at least ``support`` winnowed hashes.

    A hash that more than ``postings`` pages of the vault hold proposes nothing; that is the
    operator's definition and bounds what one hash can emit. ``prints`` is (vault, page_id,
    shingles, winnow).
    """
    held = prints.select("vault", "page_id", F.explode("winnow").alias("h"))
    # One row a hash with its bounded list; longer lists are counted, never gathered.
    common = held.groupBy("vault", "h").agg(F.count("*").alias("n")).where(F.col("n").between(2, postings)).select("vault", "h")
    lists = held.join(common, ["vault", "h"], "left_semi").groupBy("vault", "h").agg(F.array_sort(F.collect_list("page_id")).alias("pages"))
    firsts = lists.select("vault", "pages", F.posexplode("pages").alias("at", "a"))
    pairs = firsts.select("vault", "a", F.explode(F.slice("pages", F.col("at") + 2, F.size("pages"))).alias("b"))
    return pairs.groupBy("vault", "a", "b").agg(F.count("*").alias("hits")).where(F.col("hits") >= support)


#: Long words of the bit map of a shingle set.
WORDS = 32


def bit_maps(prints: DataFrame) -> DataFrame:
    """(page_id, size, w0, w1, ...): each shingle set as a map of ``64 * WORDS`` bits, set by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(1)
            sizes = np.diff(np.asarray(sets.offsets))
            mixed = np.asarray(sets.flatten()).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bit = mixed >> np.uint64(64 - (64 * WORDS).bit_length() + 1)
            words = np.zeros((len(sizes), WORDS), np.uint64)
            np.bitwise_or.at(words, (np.repeat(np.arange(len(sizes)), sizes), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            columns = [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *columns], ["page_id", "size", *[f"w{i}" for i in range(WORDS)]])

    schema = "page_id long, size int, " + ", ".join(f"w{i} long" for i in range(WORDS))
    return prints.select(F.col("page_id").cast("long"), "shingles").where("shingles is not null").mapInArrow(run, schema)


def possible(pairs: DataFrame, prints: DataFrame, threshold: float, least_shared: int) -> DataFrame:
    """The pairs that can reach the threshold; an exact filter, which reads a bit map of each set.

    A bit that only one of two sets has stands for at least one shingle the other lacks, so
    the bits of one set without the other bound from above what both share.
    """
    maps = bit_maps(prints)
    side = lambda page, size, mark: maps.select(F.col("page_id").alias(page), F.col("size").alias(size), *[F.col(f"w{i}").alias(f"{mark}{i}") for i in range(WORDS)])
    joined = pairs.select("vault", "a", "b").join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    small, large = F.least("m", "n"), F.greatest("m", "n")
    by_jaccard = F.ceil(threshold / (1 + threshold) * (F.col("m") + F.col("n")) - 1e-9)
    by_containment = F.ceil(threshold / 0.95 * small - 1e-9)
    needed = F.greatest(F.lit(least_shared), F.when(small / large >= 0.6, F.least(by_jaccard, by_containment)).otherwise(by_jaccard)).cast("int")
    lacks = lambda one, other: reduce(operator.add, [F.bit_count(F.col(f"{one}{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}{i}")))) for i in range(WORDS)])
    fits = (F.col("needed") <= small) & (lacks("x", "y") <= F.col("m") - F.col("needed")) & (lacks("y", "x") <= F.col("n") - F.col("needed"))
    return joined.withColumn("needed", needed).where(fits).select("vault", "a", "b")


def scored(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(vault, a, b, shared, jaccard, containment, score) of candidate pairs."""
    left = prints.select(F.col("page_id").alias("a"), F.col("shingles").alias("x"))
    right = prints.select(F.col("page_id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("vault", "a", "b").join(left, "a").join(right, "b")
    counts = joined.select("vault", "a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.size("x").alias("m"), F.size("y").alias("n"))
    counts = counts.withColumn("jaccard", F.col("shared") / (F.col("m") + F.col("n") - F.col("shared"))).withColumn("containment", F.col("shared") / F.least("m", "n"))
    near = F.least("m", "n") / F.greatest("m", "n") >= 0.6
    return counts.withColumn("score", F.when(near, F.greatest("jaccard", 0.95 * F.col("containment"))).otherwise(F.col("jaccard"))).drop("m", "n")


def near_duplicates(prints: DataFrame, threshold: float = THRESHOLD, least_shared: int = SHARED) -> DataFrame:
    """Scored pairs of each vault that reach the threshold and share enough."""
    kept = possible(candidates(prints), prints, threshold, least_shared)
    return scored(kept, prints).where((F.col("score") >= threshold) & (F.col("shared") >= least_shared))


def best(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """The first pairs of each vault: highest score, most shared, then the pages."""
    order = Window.partitionBy("vault").orderBy(F.desc("score"), F.desc("shared"), "a", "b")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
