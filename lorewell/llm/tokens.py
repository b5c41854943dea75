"""Problem 8: encode a corpus with a public byte-level BPE tokenizer.

Method: overlapping chunk encoding. A text is cut into overlapping windows that are
pre-tokenised independently; two neighbours are stitched at the first boundary inside
their overlap that both of them found, and the pieces between stitches are encoded in
parallel. The pattern never looks behind, so from a boundary that both windows share their
splits are the same; a boundary counts only where the pattern's lookahead has seen text on,
and after a sign that is no white space, so that a piece splits as it does inside the text.
Decoding concatenates the raw bytes of the tokens.

Defined ids: a null text has null ids, an empty text the empty list.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Characters of a window's own part, and of the part it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10

# Fixed value: the pre-token pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_folder() -> str:
    """The installed folder of public vocabulary files; ``PUBLIC_TOKENIZERS`` overrides it."""
    named = os.environ.get("PUBLIC_TOKENIZERS")
    if named:
        return named
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(found.origin) if found and found.origin else "/opt/tokenizers"


def rank_file(name: str = "byte_bpe_50k") -> str:
    return os.path.join(vocabulary_folder(), f"{name}.tiktoken")


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The encoding of a rank file, loaded once per Python worker."""
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def decode(ids: list[int] | None, path: str | None = None) -> str | None:
    """The text of a list of ids; null for null."""
    if ids is None:
        return None
    return encoder(path or rank_file()).decode_bytes(list(ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def boundaries(window: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of a window. Unless the window ends the text, the last two
    starts are left out: what follows the window could still change them."""
    starts = [m.start() for m in _splitter().finditer(window)]
    return starts if last else starts[:-2]


def stitch_points(window: str, last: bool) -> list[int]:
    """Boundaries at which a text may be cut: those after a sign that is no white space.

    A piece that ended in white space would lose what its lookahead sees.
    """
    return [x for x in boundaries(window, last) if x and not window[x - 1].isspace()]


def windows(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each window over a text of ``length`` characters."""
    if length <= chunk + overlap:
        return [(0, length)]
    begins = range(0, length - overlap, chunk)
    return [(b, min(length, b + chunk + overlap)) for b in begins]


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [None if x is None else encode.encode_ordinary(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(ids)], ["key", "ids"])

    return run


def _id_lists(ids: list[list[int] | None]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum([len(x) if x is not None else 0 for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids if x for i in x), dtype=np.int32, count=offsets[-1])
    mask = pa.array([x is None for x in ids])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=mask)


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in batch.itertuples(index=False, name=None):
                spans = windows(len(text), chunk, overlap)
                for at in range(0, len(spans), 64):
                    part = [(key, at + i, b, e == len(text), text[b:e]) for i, (b, e) in enumerate(spans[at : at + 64])]
                    yield pd.DataFrame(part, columns=["key", "k", "begin", "last", "window"])

    return run


def _window_edges(chunk: int, overlap: int):
    """Absolute boundaries each window found in the overlaps with its neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, k, begin, last, window in batch.itertuples(index=False, name=None):
                found = np.asarray(stitch_points(window, last), dtype=np.int64) + begin
                rows.append((key, k, found[found < begin + overlap].tolist(), found[found >= begin + chunk].tolist()))
            yield pd.DataFrame(rows, columns=["key", "k", "head", "tail"])

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids = [encode.encode_ordinary(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _id_lists(ids)], ["key", "k", "ids"])

    return run


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of every row; null text gives null ids, empty text an empty list.

    A text of one window needs no stitch and never leaves its task. Longer texts become one
    row per window, so no task pre-tokenises or encodes more than a window. If an overlap
    holds no shared boundary (a single pre-token longer than it), the windows on both sides
    are joined into one piece, which is exact; only such a run grows with its pre-token.
    Keys must be unique and not null; other columns are ignored.
    """
    path = path or rank_file()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    one = F.coalesce(F.length("text"), F.lit(0)) <= chunk + overlap
    short = rows.where(one).mapInArrow(_encode_short(path), f"key {kind}, ids array<int>")
    long = _long(rows.where(~one), kind, path, chunk, overlap)
    return short.unionByName(long).withColumnRenamed("key", key)


def _long(rows: DataFrame, kind: str, path: str, chunk: int, overlap: int) -> DataFrame:
    cut = rows.select("key", "text").mapInPandas(_cut(chunk, overlap), f"key {kind}, k int, begin long, last boolean, window string").repartition("key", "k")
    # Only the boundaries of the overlaps travel here, not the windows.
    edges = cut.mapInPandas(_window_edges(chunk, overlap), f"key {kind}, k int, head array<long>, tail array<long>")
    order = Window.partitionBy("key").orderBy("k")
    stitched = edges.withColumn("next", F.lead("head").over(order)).select("key", "k", F.array_min(F.array_intersect("tail", "next")).alias("stop"))
    stitched = stitched.withColumn("start", F.lag("stop").over(order))
    # Windows without a stitch between them share a piece, numbered by the stitches before.
    stitched = stitched.withColumn("piece", F.sum(F.when((F.col("k") > 0) & F.col("start").isNotNull(), 1).otherwise(0)).over(order))
    own = cut.join(stitched.select("key", "k", "start", "stop", "piece"), ["key", "k"])
    own = own.withColumn("from", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.coalesce(F.col("start") - F.col("begin"), F.lit(0))))
    own = own.withColumn("upto", F.when(F.col("last"), F.length("window")).otherwise(F.coalesce(F.col("stop") - F.col("begin"), F.lit(chunk))))
    own = own.select("key", "k", "piece", F.expr("substring(window, int(from) + 1, int(upto - from))").alias("part"))
    pieces = own.groupBy("key", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"))
    parts = pieces.select("key", "piece", "text").mapInArrow(_encode_pieces(path), f"key {kind}, k long, ids array<int>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    return parts.groupBy("key").agg(joined.alias("ids"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens) of every row; null and empty texts have none."""
    return encoded(docs, key, text, path).select(key, F.coalesce(F.size("ids"), F.lit(0)).alias("tokens"))
