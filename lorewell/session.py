"""Session helpers: conf lookups, table reading and lineage cutting.

Nothing here changes a session the caller owns, except that a checkpoint folder is set
when a session on a local master names none (as in tests on one machine).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context, unless their path has it."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if getattr(context, "_lorewell_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lorewell-"), "lorewell.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._lorewell_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh temporary one on a local master.

    A cluster whose session names no folder gets a ``ValueError``: on a folder of one machine
    each executor would write to its own disk and readers would see a part of the rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    if current.isEmpty():
        master = spark.sparkContext.master
        if not is_local(master):
            raise ValueError(f"spark.checkpoint.dir must name a folder all executors share (master {master})")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorewell-"))
        current = context.getCheckpointDir()
    return current.get().rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` starts executors of its own."""
    return master == "local" or master.startswith("local[")


#: Folders of intermediate tables that have not been removed yet, by application.
_open: dict[str, set[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application and return how many folders that were.

    For use between queries, once results are written: what a lazy result still reads must
    stay. Folders nobody released are deleted when the application ends.
    """
    folders = _open.pop(spark.sparkContext.applicationId, set())
    for folder in folders:
        _delete(spark, folder)
    return len(folders)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


class Scratch:
    """Written intermediate tables. Each cuts lineage and survives the loss of any executor.

    ``save`` writes a DataFrame as parquet and reads it back; ``drop`` deletes what a loop
    no longer needs. Tables a lazily evaluated result still reads must not be dropped. The
    folder goes with ``close`` or ``release``, at the latest when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/lorewell-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, frame: DataFrame) -> DataFrame:
        if not self.count:
            path, system = _path(self.spark, self.folder)
            system.mkdirs(path)
            system.deleteOnExit(path)
            _open.setdefault(self.spark.sparkContext.applicationId, set()).add(self.folder)
        self.count += 1
        path = f"{self.folder}/{self.count}"
        frame.write.parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved._lorewell_path = path
        return saved

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _delete(self.spark, frame._lorewell_path)

    def close(self) -> None:
        _delete(self.spark, self.folder)
        _open.get(self.spark.sparkContext.applicationId, set()).discard(self.folder)
