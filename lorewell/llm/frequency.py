"""Problem 5: occurrences and record counts of every distinct term.

Method: a global dictionary gives every distinct term a dense integer, encoded terms are
counted blockwise into arrays (occurrences and record presence), and the arrays are
summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Identifiers per counted range: the length of one count array.
RANGE = 256
#: Buckets of the dictionary at least; a bucket's ids are contiguous.
BUCKETS = 1024

_COUNTS = "range_no long, occurrences array<long>, records array<long>"


def dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, id) of every distinct non-null term; ids are 0, 1, 2, ... without gaps.

    Terms are hashed into buckets, numbered inside a bucket, and shifted by the sizes of
    the buckets before; only the fixed number of bucket sizes is broadcast. The number of
    buckets is a multiple of the shuffle partitions, so all terms of a bucket meet in one
    partition of a join on the term and their ids form a dense run there.
    """
    partitions = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * -(-BUCKETS // partitions)
    distinct = terms.select(F.col(term).alias("term")).where("term is not null").distinct()
    distinct = distinct.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
    sizes = distinct.groupBy("bucket").agg(F.count("*").alias("size"))
    before = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("shift"))  # one row a bucket
    numbered = distinct.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("term")))
    return numbered.join(F.broadcast(before), "bucket").select("term", (F.col("shift") + F.col("k") - 1).alias("id"))


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays of each block of (id, n), one row per identifier range it touches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        ranges, at = np.unique(ids // RANGE, return_inverse=True)
        slot = at * RANGE + ids % RANGE
        size = len(ranges) * RANGE
        occurrences = np.bincount(slot, weights=n, minlength=size).astype(np.int64)
        records = np.bincount(slot, minlength=size).astype(np.int64)
        offsets = pa.array(np.arange(len(ranges) + 1, dtype=np.int32) * RANGE)
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (occurrences, records)]
        yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), *arrays], ["range_no", "occurrences", "records"])


def _sum_range(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    occurrences, records = np.sum(np.stack(part["occurrences"]), axis=0), np.sum(np.stack(part["records"]), axis=0)
    used = np.flatnonzero(records)
    return pd.DataFrame({"id": key[0] * RANGE + used, "occurrences": occurrences[used], "records": records[used]})


def term_counts(rows: DataFrame, term: str = "term", record: str = "record") -> DataFrame:
    """(term, occurrences, records): rows holding the term, and distinct records among them.

    Null terms are not counted, a null record counts as an occurrence of no record. Rows
    are combined to (term, record) before any join, so a term or record that holds a third
    of the rows costs no more than its distinct records. The empty string is a term.
    """
    rows = rows.select(F.col(term).alias("term"), F.col(record).alias("record")).where("term is not null")
    combined = rows.groupBy("term", "record").agg(F.count("*").alias("n"))
    known = dictionary(combined)
    encoded = combined.join(known, "term").select("id", "n", F.col("record").isNotNull().cast("int").alias("here"))
    present = encoded.where("here = 1").select("id", "n").sortWithinPartitions("id")
    blocks = present.mapInArrow(_count_blocks, _COUNTS)
    counted = blocks.groupBy("range_no").applyInPandas(_sum_range, "id long, occurrences long, records long")
    unrecorded = encoded.where("here = 0").select("id", F.col("n").alias("extra"))
    total = known.join(counted, "id", "left").join(unrecorded, "id", "left")
    return total.select(
        "term",
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("occurrences"),
        F.coalesce("records", F.lit(0)).cast("long").alias("records"),
    )


def marked(counts: DataFrame, total: int, rare: int = 2, common: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: 'rare' (at most ``rare`` records), else 'common' (more than
    ``common`` of all ``total`` records), else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common")
    return counts.select("term", "occurrences", "records", mark.cast(T.StringType()).alias("mark"))


def link_target_counts(links: DataFrame, rare: int = 2, common: float = 0.05) -> DataFrame:
    """(target_key, mentions, docs, mark) over all vaults; a link_id counts once."""
    once = links.select("link_id", "target_key", "src_page").distinct()
    usable = once.where("target_key is not null and target_key <> ''")
    total = links.agg(F.count_distinct("src_page").alias("total")).first()["total"]
    counts = marked(term_counts(usable, "target_key", "src_page"), total, rare, common)
    return counts.select(F.col("term").alias("target_key"), F.col("occurrences").alias("mentions"), F.col("records").alias("docs"), "mark")
