"""What several text operators need: the word class, folds, joins on hot keys, and tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but ASCII white space. ``bytes.split()`` splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in SPREAD of all rows is dealt to several tasks, so fewer than SPREAD such keys exist; parts of PART rows are small enough.
SPREAD, PART = 1000, 256
#: Steps of an octave in which counts are put to find the most frequent.
STEPS = 64


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def free_prefix(columns: list[str], prefix: str = "__") -> str:
    """A prefix that none of the columns begins with, whatever their case."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def spread_join(rows: DataFrame, table: DataFrame, key: str, salt: list[str], total: int, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, where a key may hold any share of the ``total`` rows.

    The rows of a hot key go to as many parts as keep each below 1 in SPREAD of all rows
    (or PART rows), by a hash of the columns ``salt``; the other side's rows of that key are
    copied to each part. The broadcast table of hot keys has fewer than SPREAD rows.
    ``sizes`` may give the rows of each key as ``n``.
    """
    if total <= PART:
        return rows.join(table, key, how)
    part = max(PART, total / SPREAD)
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = F.broadcast(sizes.select(key, F.ceil(F.col("n") / F.lit(part)).cast("int").alias("__parts")).where("__parts > 1"))
    parts = F.coalesce("__parts", F.lit(1))
    one = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*salt, F.lit(17)), parts).cast("int")).drop("__parts")
    other = table.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return one.join(other, [key, "__part"], how).drop("__part")


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of largest ``count``, ``most`` of them or all; those that tie at the end are drawn by a hash of their other columns.

    Counts below STEPS are told apart exactly, larger ones to one part in STEPS. The driver gets a row for each step.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * STEPS).cast("int")
    held, least = 0, None
    there = counts.where(F.col(count) > 0)
    for r in sorted(there.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if held + r["n"] > most:
            drawn = least_drawn(there.where(step == r["step"]), F.xxhash64(*[c for c in counts.columns if c != count], F.lit(11)), most - held)
            return drawn if least is None else there.where(step >= least).unionByName(drawn)
        held += r["n"]
        least = r["step"]
    return there


def least_drawn(df: DataFrame, draw: Column, most: int) -> DataFrame:
    """The ``most`` rows of least ``draw``, a 64-bit hash. Only about twice as many rows are sorted or leave their tasks."""
    rows = df.count()
    if rows > 2 * most:
        df = df.where(draw <= F.lit(int((2 * most / rows) * 2.0**64 - 2.0**63)).cast("long"))
    return df.orderBy(draw, *df.columns[:1]).limit(most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, only a local master gets a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_swept: list[list[Scratch]] = []


@contextmanager
def swept() -> Iterator[None]:
    """Deletes at its end all scratch tables of operators that began within it; what they return must be written by then."""
    made: list[Scratch] = []
    _swept.append(made)
    try:
        yield
    finally:
        _swept.remove(made)
        for scratch in made:
            scratch.drop(*list(scratch.paths))


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    ``keep`` writes a DataFrame as Parquet and reads it back; ``drop`` deletes such a
    table once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        for made in _swept:
            made.append(self)

    def folder(self, name: str) -> str:
        """A new folder's path, for files that tasks write themselves."""
        path = self.paths[name] = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of finished plans, which it does once the driver has collected them as garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
