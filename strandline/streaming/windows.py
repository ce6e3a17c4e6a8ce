"""Streams: windows with watermarks, sessions, deduplication, stateful filters and joins of two streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.sources.shared import exists, mark, new_folder, store


def source(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, with the schema of the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and gives what it wrote; sink and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    path, log = new_folder(spark, name), new_folder(spark, f"{name}-log")
    running = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def one_pole(stream: DataFrame, key: str, order: str, v: str, share: float) -> DataFrame:
    """(key, order, y): y = share * v + (1 - share) * y before, with y kept as state between batches.

    Rows of one batch are put in order; rows of a later batch follow those before, as in a
    filter that runs block by block. The first value starts the filter.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        y = state.get[0] if state.exists else None
        out = []
        for x in rows[v]:
            y = x if y is None else share * x + (1 - share) * y
            out.append(y)
        state.update((y,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "y": out})

    picked = stream.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(v).cast("double").alias(v))
    return picked.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, y double", "y double", "append", "NoTimeout")


def publish(stream: DataFrame, send: Callable[[list[tuple[str, str]]], None], log: str, every: str | None = "3 seconds", mode: str = "append", rows: int = 500):
    """Starts a query that sends each batch's rows as (key, JSON text) in lists of at most ``rows``, from the executors, and gives it.

    A batch is first written to ``log`` under its number, with a key for each row, and sent
    from there; a note says that it has been sent. A query started again with the same ``log``
    skips batches with a note and sends one without from what was written, under the same
    keys, so a receiver that knows its keys gets each row once. ``every`` None takes what is
    there and ends.
    """

    def batch(found: DataFrame, number: int) -> None:
        spark, kept, note = found.sparkSession, f"{log}/batch-{number}", f"{log}/sent/{number}"
        if exists(spark, note):
            return
        if not exists(spark, f"{kept}/_SUCCESS"):
            key = F.concat_ws("-", F.lit(number), F.monotonically_increasing_id())
            found.select(key.alias("key"), F.to_json(F.struct("*")).alias("payload")).write.mode("overwrite").parquet(kept)

        def part(messages) -> None:
            texts = ((r["key"], r["payload"]) for r in messages)
            while some := list(islice(texts, rows)):
                send(some)

        spark.read.schema("key string, payload string").parquet(kept).foreachPartition(part)
        mark(spark, note)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{log}/checkpoint").foreachBatch(batch).trigger(**trigger).start()


class Inbox:
    """A receiver that keeps each row's text in a folder, as a file named by its key: what comes twice lies there once."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, messages: list[tuple[str, str]]) -> None:
        for key, text in messages:
            store(self.folder, f"{key}.json", text.encode())
