"""Directories of notes as tables of files, and sinks for rewritten notes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: folders a nested collection leaves out, besides those that begin with a dot.
IGNORED = frozenset({"node_modules", "target", "vendor"})
FILES = "page_id long, vault string, rel_file string, content string, received_at timestamp"


def list_notes(root: str, nested: bool = False) -> list[str]:
    """Relative paths of the regular ``.md`` files of a folder, or of its tree; links are not followed.

    ``FileNotFoundError`` if the folder is missing. A file called just ``.md`` has no
    extension and is left out; ``_x.md`` and ``.x.md`` are notes.
    """
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    found, open_folders = [], [""]
    while open_folders:
        folder = open_folders.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if nested and not entry.name.startswith(".") and entry.name not in IGNORED:
                        open_folders.append(path)
                elif entry.is_file(follow_symlinks=False) and os.path.splitext(entry.name)[1].lower() == ".md":
                    found.append(path)
    return sorted(found, key=lambda p: (p[:-3].lower(), p))


def _read(root: str, vault: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, path in batch.itertuples(index=False, name=None):
                with open(os.path.join(root, path), encoding="utf-8", newline="") as file:
                    rows.append((page, vault, path, file.read(), pd.NaT))
            yield pd.DataFrame(rows, columns=["page_id", "vault", "rel_file", "content", "received_at"])

    return run


def read_folder(spark: SparkSession, root: str, nested: bool = False, vault: str = "") -> DataFrame:
    """A folder as a table of files: names are listed once, contents read by the executors.

    The folder must be visible to all executors; page ids follow the order of lower-case paths. A file that
    is not UTF-8 fails the query.
    """
    paths = list(enumerate(list_notes(root, nested)))
    root = os.path.realpath(root)
    listed = spark.createDataFrame(paths, "page_id long, rel_file string")
    if len(paths) > 1000:
        listed = listed.repartition(-(-len(paths) // 1000))
    return listed.mapInPandas(_read(root, vault or os.path.basename(root)), FILES)


def read_object_store(spark: SparkSession, root: str, nested: bool = False, vault: str = "") -> DataFrame:
    """The same through Spark's file index, for stores without a mounted folder.

    Spark's index hides names that begin with a dot or an underscore. Where the store holds
    such notes a ``ValueError`` says so, so that none is lost unseen. Ids are hashes of the paths.
    """
    hidden = [p for p in _listed(spark, root, nested) if p.rpartition("/")[2][0] in "._"]
    if hidden:
        raise ValueError(f"{len(hidden)} notes have names that Spark's file index hides, the first is {hidden[0]}")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", str(nested).lower()).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    rel = F.expr(f"substring(p, {len(base) + 2})")
    rows = found.withColumn("p", path).withColumn("rel_file", rel)
    folders = F.slice(F.split("rel_file", "/"), 1, F.size(F.split("rel_file", "/")) - 1)
    rows = rows.where(~F.exists(folders, lambda x: x.startswith(".") | x.isin(sorted(IGNORED))))
    return rows.select(F.xxhash64("rel_file").alias("page_id"), F.lit(vault or base).alias("vault"), "rel_file", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("received_at"))


def _listed(spark: SparkSession, root: str, nested: bool) -> list[str]:
    """Paths of the notes below a root by the store's own listing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found, files = system.makeQualified(path).toString().rstrip("/") + "/", [], system.listFiles(path, nested)
    while files.hasNext():
        rel = files.next().getPath().toString().removeprefix(base)
        *folders, name = rel.split("/")
        if name[:-3] and name[-3:].lower() == ".md" and not any(f.startswith(".") or f in IGNORED for f in folders):
            found.append(rel)
    return sorted(found)


def write_table(rewritten: DataFrame, path: str) -> None:
    """The changed files as a parquet table (rel_file, new_content)."""
    rewritten.write.parquet(path)


def _write(root: str, moves: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                target = row.new_rel_file if moves else row.rel_file
                path = os.path.join(root, target)
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                # A whole file replaces the old one at once, so a task that is run again does no harm.
                beside = f"{path}.{uuid.uuid4().hex}"
                with open(beside, "w", encoding="utf-8", newline="") as file:
                    file.write(row.new_content)
                os.replace(beside, path)
                old = os.path.join(root, row.rel_file)
                if target != row.rel_file and os.path.exists(old) and not os.path.samefile(old, path):
                    os.remove(old)
            yield pd.DataFrame({"written": [len(batch)]})

    return run


def apply_changes(rewritten: DataFrame, root: str) -> int:
    """Write changed files back to a folder all executors see, by the executors; returns how many.

    Rows are (rel_file, new_content) and, for a rename, new_rel_file.
    """
    found = rewritten.mapInPandas(_write(os.path.realpath(root), "new_rel_file" in rewritten.columns), "written long")
    return found.agg(F.sum("written")).first()[0] or 0
