"""Rewrites of whole collections: computed as columns, written by a sink if wanted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorewell.functions import rewriting
from lorewell.functions.names import document_key


def formatted(pages: DataFrame) -> DataFrame:
    """(page_id, vault, rel_file, new_content, changed) in the default style; unreadable pages stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = batch["content"].map(lambda x: None if x is None else rewriting.format_note(x))
            yield pd.DataFrame({"page_id": batch["page_id"], "vault": batch["vault"], "rel_file": batch["rel_file"], "new_content": new, "changed": [a is not None and a != b for a, b in zip(batch["content"], new)]})

    schema = "page_id long, vault string, rel_file string, new_content string, changed boolean"
    return pages.select(F.col("page_id").cast("long"), "vault", "rel_file", "content").mapInPandas(run, schema)


def renamed(pages: DataFrame, page_id: int, old_name: str, wanted: str, nested: bool = False) -> DataFrame:
    """(page_id, rel_file, new_rel_file, new_content, links, retitled) of the files a rename touches.

    ``pages`` are those of one vault. Links go by the key of the old name; the renamed page
    also gets a new title where its title was its name. ``ValueError`` for an impossible name.
    """
    key, name = document_key(old_name), rewriting.new_name(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, file, content in batch.itertuples(index=False, name=None):
                text, count = rewriting.retarget(content or "", key, name)
                title = False
                new_file = file
                if page == page_id:
                    text, title = rewriting.retitle(text, old_name, name)
                    new_file = rewriting.renamed_path(file, wanted, nested) + ".md"
                if count or title or page == page_id:
                    rows.append((page, file, new_file, text, count, title))
            yield pd.DataFrame(rows, columns=["page_id", "rel_file", "new_rel_file", "new_content", "links", "retitled"])

    schema = "page_id long, rel_file string, new_rel_file string, new_content string, links int, retitled boolean"
    return pages.select(F.col("page_id").cast("long"), "rel_file", "content").mapInPandas(run, schema)


def rename_totals(touched: DataFrame) -> DataFrame:
    """One row: files touched (the renamed one always is), links updated, whether a title was."""
    return touched.agg(
        F.greatest(F.count_if((F.col("links") > 0) | F.col("retitled")), F.lit(1).cast("long")).alias("files_touched"),
        F.coalesce(F.sum("links"), F.lit(0).cast("long")).alias("links_updated"),
        F.coalesce(F.bool_or("retitled"), F.lit(False)).alias("title_updated"),
    )
