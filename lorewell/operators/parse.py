"""From files to documents, links, lines and statistics.

A text is parsed where it is read: one narrow Arrow projection, no shuffle. Files delivered
several times are reduced to their newest readable delivery first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.functions import grammar
from lorewell.functions.fingerprint import fingerprint
from lorewell.functions.names import document_key, path_key, without_extension

NOTE = (
    "page_id long, vault string, rel_path string, name string, key string, excerpt string, present boolean, body_offset int, title string, "
    "aliases array<string>, links array<struct<kind:string,display_target:string,target_key:string,raw_target:string,context:string>>, "
    "link_only array<struct<line:int,text:string>>"
)
STATS = "page_id long, vault string, rel_path string, visible_lines int, words int, norm string"
PRINT = "page_id long, vault string, shingles array<long>, winnow array<long>"


def latest(files: DataFrame) -> DataFrame:
    """(page_id, vault, rel_file, content): the newest readable delivery of each page.

    Null ids are left out; a page that was never readable keeps one row with null content.
    """
    order = F.struct(F.col("content").isNotNull(), F.col("received_at"), F.xxhash64("content"))
    row = F.max_by(F.struct("vault", "rel_file", "content"), order)
    return files.where("page_id is not null").groupBy("page_id").agg(row.alias("r")).select("page_id", "r.*")


def notes(pages: DataFrame, nested: bool = False) -> DataFrame:
    """Documents with front matter, excerpt, links and link-only lines; unreadable pages are empty notes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, vault, file, content in batch.itertuples(index=False, name=None):
                note = grammar.parse(content or "")
                path = without_extension(file)
                name, key = (path, path_key(path)) if nested else (path.rsplit("/", 1)[-1], document_key(file))
                rows.append((page, vault, file, name, key, note.excerpt, note.front.present, note.front.body_offset, note.front.title or None,
                             list(note.front.aliases), [link._asdict() for link in note.links], [{"line": n, "text": t} for n, t in note.link_only]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NOTE.split(", ")])

    return pages.select(F.col("page_id").cast("long"), "vault", "rel_file", "content").mapInPandas(run, NOTE)


def links_of(parsed: DataFrame) -> DataFrame:
    """One row a link, in reading order."""
    return parsed.select(F.col("page_id").alias("src_page"), "vault", F.posexplode("links").alias("link_pos", "l")).select("src_page", "vault", "link_pos", "l.*")


def link_only_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "vault", "name", F.explode("link_only").alias("o")).select("page_id", "vault", "name", "o.line", "o.text")


def statistics(pages: DataFrame) -> DataFrame:
    """Visible lines, words and normalised text; unreadable pages have none of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, vault, without_extension(file), *(grammar.statistics(text) if text is not None else (None, None, None))) for page, vault, file, text in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")]).astype({"visible_lines": "Int32", "words": "Int32"})

    return pages.select(F.col("page_id").cast("long"), "vault", "rel_file", "content").mapInPandas(run, STATS)


def sizes(files: DataFrame) -> DataFrame:
    """(page_id, vault, rel_path, visible_lines, words) of the newest readable delivery of each page.

    Every delivery is measured where it is read; only the measures are shuffled to find the newest.
    """
    schema = f"page_id long, vault string, rel_path string, visible_lines int, words int, readable boolean, received_at {files.schema['received_at'].dataType.simpleString()}, digest long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            measured = [grammar.sizes(x) if x is not None else (None, None) for x in batch["content"]]
            out = batch[["page_id", "vault"]].assign(rel_path=batch["rel_file"].map(without_extension))
            out["visible_lines"], out["words"] = (pd.array([m[i] for m in measured], "Int32") for i in (0, 1))
            yield out.assign(readable=batch["content"].notna(), received_at=batch["received_at"], digest=batch["digest"])

    rows = files.where("page_id is not null").select(F.col("page_id").cast("long"), "vault", "rel_file", "received_at", "content", F.xxhash64("content").alias("digest"))
    newest = F.max_by(F.struct("vault", "rel_path", "visible_lines", "words"), F.struct("readable", "received_at", "digest"))
    return rows.mapInPandas(run, schema).groupBy("page_id").agg(newest.alias("r")).select("page_id", "r.*")


def fingerprints(stats: DataFrame, least_words: int = 40, least_shingles: int = 24) -> DataFrame:
    """Shingle and winnow hashes of the pages long enough to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, shingles, winnow = [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                grams, least = fingerprint(text)
                if len(grams) >= least_shingles:
                    kept.append(at)
                    shingles.append(grams)
                    winnow.append(least)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (shingles, winnow)]
            own = [batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *lists], ["page_id", "vault", "shingles", "winnow"])

    eligible = stats.where((F.col("words") >= max(least_words, 20)) & F.col("norm").isNotNull())
    return eligible.select(F.col("page_id").cast("long"), "vault", "norm").mapInArrow(run, PRINT)
