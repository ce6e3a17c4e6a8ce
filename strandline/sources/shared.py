"""Folders in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under the session's checkpoint folder. Without either only a local master gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(folder: str, name: str, content: bytes) -> None:
    """Writes one file beside its final place and moves it there, so that a repeated task leaves one whole file. Runs in tasks."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    files, root = (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    aside = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as out:
        out.write(content)
    files.move(aside, f"{root}/{name}")


def write_files(files: DataFrame, folder: str) -> None:
    """Each row's ``content`` as the file ``name`` of the folder; rows are written where they lie."""

    def write(rows) -> None:
        for r in rows:
            store(folder, r["name"], bytes(r["content"]))

    files.select("name", "content").foreachPartition(write)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, as a note that something is done."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()


class Steps:
    """Tables of an iteration, written to the shared folder so that plans stay short and lost executors cost one step; old steps are deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, new_folder(spark, name), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
