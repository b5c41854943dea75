"""Problem 4: near-duplicate pages with small edits.

Method: sequential Bayesian verification. Exact copies are folded into one representative.
Each representative's shingle set is min-hashed; bands of the signature propose candidate
pairs, and inside a band bucket the pair's remaining signature is compared batch by batch.
After each batch the pair is dropped once the posterior probability that its similarity
still reaches the least one that could score is below the chosen miss probability. Every
survivor is verified exactly on the full shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.session import Scratch

#: Signature: BANDS bands of ROWS minima each, made in passes that split a set into BINS bins.
ROWS, BANDS, BINS = 5, 160, 64
#: Verification batches: BATCHES of BATCH one-byte minima, independent of the bands. Few bins
#: a pass, so that they are filled by small sets too and the minima stay independent.
BATCH, BATCHES, CHECK_BINS = 16, 4, 4
#: Probability with which one pair that reaches its least similarity may be dropped at a batch.
MISS = 1e-4
#: Rows of one bucket compared by one task; larger buckets are split into block pairs.
BLOCK = 1024

THRESHOLD, CONTAINED, RATIO, SHARED = 0.82, 0.95, 0.6, 24


def score_of(shared, size_a, size_b):
    """Score column of a pair: max(j, 0.95 c) if the sizes' ratio is at least 0.6, else j."""
    j = shared / (size_a + size_b - shared)
    small, large = F.least(size_a, size_b), F.greatest(size_a, size_b)
    return F.when(small / large >= RATIO, F.greatest(j, CONTAINED * shared / small)).otherwise(j)


def least_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, least_shared: int = SHARED) -> np.ndarray:
    """The smallest Jaccard similarity with which sets of these sizes can still score."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    by_containment = np.ceil(np.maximum(least_shared, threshold / CONTAINED * small) - 1e-9)
    j = by_containment / np.maximum(a + b - by_containment, 1e-9)
    j = np.where(small / large >= RATIO, np.minimum(threshold, j), threshold)
    return np.where(small >= least_shared, j, 2.0)


@functools.lru_cache(maxsize=8)
def needed_matches(miss: float) -> np.ndarray:
    """[batch, similarity in 1/100]: least number of matches with which a pair survives.

    With a uniform prior and m of n matches the posterior of the match probability is
    Beta(m + 1, n - m + 1), so P(similarity >= t) = P(Binomial(n + 1, p) <= m) with p the
    match probability at t; one byte minima also match by chance once in 256.
    """
    table = np.zeros((BATCHES, 101), dtype=np.int32)
    for batch in range(BATCHES):
        n = BATCH * (batch + 1)
        for step in range(101):
            t = step / 100
            p = t + (1 - t) / 256
            below, m = 0.0, 0
            while m <= n:
                below += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
                if below >= miss:
                    break
                m += 1
            table[batch, step] = m
    return table


@functools.lru_cache(maxsize=4)
def _seeds(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=(n, 2), dtype=np.uint64) | np.uint64(1)


def _minima(values: np.ndarray, owner: np.ndarray, docs: int, multiplier: np.uint64, shift: np.uint64, bins: int = BINS) -> np.ndarray:
    """One pass: each document's set split into bins (a power of two) by a hash, the least value per bin.

    An empty bin borrows from the next filled one, mixed with the distance, so equal sets
    stay equal and collision probabilities stay those of min-hashing.
    """
    mixed = (values + shift) * multiplier
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    cell = owner * bins + (mixed >> np.uint64(58)).astype(np.int64) % bins
    out = np.full(docs * bins, np.uint64(2**64 - 1))
    np.minimum.at(out, cell, mixed & np.uint64((1 << 58) - 1))
    out = out.reshape(docs, bins)
    empty = out == np.uint64(2**64 - 1)
    if empty.any():
        source, hollow = out.copy(), empty.copy()
        for step in range(1, bins):
            take = empty & ~np.roll(hollow, -step, axis=1)
            out[take] = np.roll(source, -step, axis=1)[take] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)
            empty &= ~take
            if not empty.any():
                break
    return out


def signatures(values: np.ndarray, offsets: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(band keys [docs, BANDS] uint64, check bytes [docs, BATCH * BATCHES]) of many sets."""
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets))
    values = values.astype(np.int64).view(np.uint64)
    passes, checks = -(-ROWS * BANDS // BINS), BATCH * BATCHES // CHECK_BINS
    seeds = _seeds(seed, passes + checks)
    rows = np.concatenate([_minima(values, owner, docs, *seeds[i]) for i in range(passes)], axis=1)
    # A pass's bins are taken in turn, so one band mixes minima of different passes.
    rows = rows.reshape(docs, passes, BINS).transpose(0, 2, 1).reshape(docs, passes * BINS)[:, : BANDS * ROWS].reshape(docs, BANDS, ROWS)
    keys = np.zeros((docs, BANDS), dtype=np.uint64)
    for i in range(ROWS):
        keys = (keys ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    keys ^= np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    check = np.concatenate([_minima(values, owner, docs, *seeds[passes + i], bins=CHECK_BINS) for i in range(checks)], axis=1)
    check = (check * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
    return keys, check.astype(np.uint8)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, size, bands, signature) of (id, digest, items): each set is hashed once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = part.column(2)
            values = np.asarray(sets.flatten())
            offsets = np.asarray(sets.offsets) - sets.offsets[0].as_py()
            keys, check = signatures(values, offsets)
            n = len(offsets) - 1
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            check_bytes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BATCH * BATCHES), n, [None, pa.py_buffer(check.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offsets).astype(np.int32)), bands, check_bytes], ["id", "digest", "size", "bands", "signature"])


def _pairs_in_runs(miss: float, threshold: float, least_shared: int):
    """Compare all rows of equal (band, block_a, block_b) in batches ordered by key and size."""
    table = needed_matches(miss)
    ratio = min(RATIO, threshold) - 1e-9  # no pair of less equal sizes can score

    def compare(band: np.ndarray, ids: np.ndarray, size: np.ndarray, side: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rows of a bucket come in the order of their sizes: a row meets those after it until their sets are too large for it.
        found_a, found_b = [], []
        run = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        remaining = np.repeat(np.r_[run[1:], len(band)], np.diff(np.r_[run, len(band)])) - np.arange(len(band)) - 1
        step, live = 1, np.flatnonzero(remaining >= 1)
        while len(live):
            live = live[size[live] >= ratio * size[live + step]]
            i, j = live, live + step
            fit = (ids[i] != ids[j]) & ((side[i] == 0) | (side[i] != side[j]))
            i, j = i[fit], j[fit]
            least = least_similarity(size[i].astype(np.int64), size[j].astype(np.int64), threshold, least_shared)
            fit = least <= 1
            i, j, least = i[fit], j[fit], np.floor(least[fit] * 100).astype(np.int64)
            matches = np.zeros(len(i), dtype=np.int32)
            for batch in range(BATCHES):
                at = slice(batch * BATCH, (batch + 1) * BATCH)
                matches += (check[i, at] == check[j, at]).sum(axis=1, dtype=np.int32)
                keep = matches >= table[batch, least]
                i, j, least, matches = i[keep], j[keep], least[keep], matches[keep]
            found_a.append(np.minimum(ids[i], ids[j]))
            found_b.append(np.maximum(ids[i], ids[j]))
            step += 1
            live = live[remaining[live] >= step]
        if not found_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
        return pairs[0], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            check = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, BATCH * BATCHES)
            columns = [np.asarray(batch.column(i)) for i in range(4)] + [check]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            # The last key may go on in the next batch.
            last = np.searchsorted(columns[0], columns[0][-1])
            held = [x[last:] for x in columns]
            a, b = compare(*[x[:last] for x in columns]) if last else ((), ())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held is not None:
            a, b = compare(*held)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


_SIGNED = "id long, digest struct<size:int,h:bigint,g:int,k:bigint>, size int, bands array<long>, signature binary"


def digested(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(id, items, digest) of the rows with a key and a set; equal digests stand for equal sets."""
    # Filtered before the sort: above it, the filter would be pushed below and sort each set a second time.
    # sort_array is compiled; array_sort calls an interpreted comparator.
    rows = sets.select(F.col(key).cast("long").alias("id"), F.col(items).alias("items")).where("id is not null and size(items) > 0").withColumn("items", F.sort_array("items"))
    return rows.withColumn("digest", F.struct(F.size("items").alias("size"), F.xxhash64("items").alias("h"), F.hash("items").alias("g"), F.xxhash64(F.lit(7), "items").alias("k")))


def signed_sets(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``digested`` rows with their signatures instead of their sets, hashed where they are read and written once."""
    return scratch.save(rows.select("id", "digest", "items").mapInArrow(_signed, _SIGNED))


def candidate_pairs(signed: DataFrame, miss: float = MISS, threshold: float = THRESHOLD, least_shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of ids that share a band and survive the posterior bounds; one row an id."""
    blocked = split_buckets(signed.select("id", "size", "signature", F.explode("bands").alias("band")), block)
    ordered = blocked.repartition("bucket").sortWithinPartitions("bucket", "size")
    pairs = ordered.select("bucket", "id", "size", "side", "signature").mapInArrow(_pairs_in_runs(miss, threshold, least_shared), "a long, b long")
    return pairs.distinct()


def split_buckets(bands: DataFrame, block: int) -> DataFrame:
    """Rows with ``bucket`` and ``side``: buckets of more than ``block`` rows become block pairs.

    A large bucket's rows are hashed into blocks; every pair of blocks is a bucket of its
    own, and in the bucket of two blocks only rows of different sides meet. Together they
    compare what the one bucket would. Bucket sizes are counted from the band keys alone,
    and only keys of large buckets are joined back.
    """
    large = bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("band", F.ceil(F.col("n") / (block // 2)).cast("int").alias("blocks"))
    joined = bands.join(large, "band", "left")
    alone = F.array(F.struct(F.col("band").alias("bucket"), F.lit(0).alias("side")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(
            F.xxhash64("band", F.least(x, own), F.greatest(x, own)).alias("bucket"),
            F.when(x == own, 0).when(own < x, 1).otherwise(2).alias("side"),
        ),
    )
    placed = joined.withColumn("place", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(met)))
    return placed.select("place.bucket", "id", "size", "place.side", "signature")


def near_duplicates(prints: DataFrame, key: str = "page_id", items: str = "shingles", threshold: float = THRESHOLD, least_shared: int = SHARED, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes). ``pairs``: (a, b, score, shared) of representatives, a < b.
    ``classes``: (key, rep) of every row with a set; copies of one set share a representative.

    Null keys, null and empty sets are left out. A repeated key counts once, with its largest
    set (of equally large ones, the one with the greatest hash). Sets must be free of repeats.
    """
    scratch = Scratch(prints.sparkSession)
    rows = digested(prints, key, items)
    signed = signed_sets(rows, scratch)
    chosen = signed.groupBy("id").agg(F.max("digest").alias("digest"))
    heads = chosen.groupBy("digest").agg(F.min("id").alias("rep"))
    classes = scratch.save(chosen.join(heads, "digest").select("id", "rep", F.col("digest.size").alias("size")))
    reps = classes.where("id = rep").select("id")
    # Rows of one id are reduced before they move, so an id may have any share of all rows.
    once = signed.groupBy("id").agg(F.max_by(F.struct("size", "bands", "signature"), "digest").alias("s")).select("id", "s.*")
    pairs = scratch.save(candidate_pairs(scratch.save(once.join(reps, "id", "left_semi")), miss, threshold, least_shared))
    # Only sets that are part of a candidate travel to the exact check, each once.
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = rows.join(needed, "id", "left_semi").groupBy("id").agg(F.max_by("items", "digest").alias("items"))
    left = full.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = full.select(F.col("id").alias("b"), F.col("items").alias("y"))
    checked = pairs.join(left, "a").join(right, "b")
    checked = checked.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size("x").alias("na"), F.size("y").alias("nb"))
    checked = checked.withColumn("score", score_of(F.col("shared"), F.col("na"), F.col("nb")))
    scored = checked.where((F.col("shared") >= least_shared) & (F.col("score") >= threshold)).select("a", "b", "score", "shared")
    return scored, classes.withColumnRenamed("id", key)


def duplicate_pairs(prints: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_a, page_b) of all near-duplicate pages, copies expanded into their pairs."""
    pairs, classes = near_duplicates(prints, key)
    member = classes.select(F.col("rep"), F.col(key).alias("id"), "size")
    first, second = member.select(F.col("rep").alias("a"), F.col("id").alias("x")), member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.join(first, "a").join(second, "b").select(F.least("x", "y").alias("page_a"), F.greatest("x", "y").alias("page_b"))
    copies = member.where(F.col("size") >= SHARED)
    same = copies.select("rep", F.col("id").alias("page_a")).join(copies.select("rep", F.col("id").alias("page_b")), "rep").where("page_a < page_b")
    return across.unionByName(same.select("page_a", "page_b"))


def duplicate_classes(prints: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page: its copies' representative and how many other texts are near it."""
    pairs, classes = near_duplicates(prints, key)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return classes.join(ends, "rep", "left").select(key, F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
