"""Readers of measured data: raw samples, sidecars, sound, dumps and parameter files, each a DataFrame by Spark's own file scan."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

STEM = r"([^/]+?)(?:\.[^./]*)?$"
#: Samples of one row batch of a decoded file.
CHUNK = 1_000_000


def _stem() -> F.Column:
    return F.regexp_extract("path", STEM, 1)


def raw_int16(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(series, i, v) of little-endian 16-bit files without header, in chunks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select(_stem().alias("series"), "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["series"], frame["content"]):
                v = np.frombuffer(content[: len(content) // 2 * 2], "<i2")
                for at in range(0, len(v), CHUNK):
                    part = v[at : at + CHUNK]
                    yield pd.DataFrame({"series": name, "i": np.arange(at, at + len(part)), "v": part.astype(float)})

    return files.mapInPandas(decode, "series string, i long, v double")


def sidecar(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """(series, start, end, duration) of text files whose third and fourth lines name start and end after a colon."""
    files = spark.read.option("pathGlobFilter", suffix).text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), STEM, 1).alias("series"), F.split("value", "\n").alias("line"))
    number = lambda n: F.trim(F.regexp_extract(F.get("line", F.lit(n)), ":(.*)", 1)).cast("double")
    return files.select("series", number(2).alias("start"), number(3).alias("end")).withColumn("duration", F.round(F.col("end") - F.col("start"), 9))


def trial_signals(samples: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Samples with their time: a file's duration over its number of samples is its step."""
    steps = samples.groupBy("series").agg(F.count("*").alias("n")).join(sidecars, "series").select("series", (F.col("duration") / F.col("n")).alias("step"))
    return samples.join(steps, "series").select("series", "i", (F.col("i") * F.col("step")).alias("t"), "v")


def sound(spark: SparkSession, path: str, suffix: str = "*.wav") -> DataFrame:
    """(series, rate, channel, i, v) of 16-bit sound files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select(_stem().alias("series"), "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["series"], frame["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    rate, channels, at = w.getframerate(), w.getnchannels(), 0
                    while raw := w.readframes(CHUNK // channels):
                        v = np.frombuffer(raw, "<i2").reshape(-1, channels)
                        for c in range(channels):
                            yield pd.DataFrame({"series": name, "rate": rate, "channel": c, "i": np.arange(at, at + len(v)), "v": v[:, c].astype(int)})
                        at += len(v)

    return files.mapInPandas(decode, "series string, rate int, channel int, i long, v int")


def logger_csv(spark: SparkSession, path: str, signals: list[str]) -> DataFrame:
    """Time, rounded to six digits, and the named signals of a data logger's tables; other columns are not parsed."""
    with_header = spark.read.option("header", True).csv(path)
    return with_header.select(F.round(F.col("Time_s").cast("double"), 6).alias("t"), *[F.col(f"`{s}`").cast("double").alias(s) for s in signals])


def two_row_header(names: list[str], units: list[str], drop: int, last: str) -> list[str]:
    """Column names of two header rows, joined; one column drops out and the last has a new name."""
    joined = [f"{a}_{b}" if b else a for a, b in zip(names, units)]
    return [*[n for i, n in enumerate(joined) if i != drop][:-1], last]


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """(name, magnitude, unit) of JSON files whose keys hold both."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<magnitude:double,unit:string>>")
    return text.select(F.explode(entries).alias("name", "p")).select("name", "p.magnitude", "p.unit")


def xml_tags(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """The first text of each tag, one row a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(*[F.regexp_extract("value", f"<{t}[^>]*>([^<]*)</{t}>", 1).alias(t) for t in tags])


def text_dump(spark: SparkSession, path: str) -> DataFrame:
    """(row, v) of the numeric lines of a dump; comment lines drop out. Order is that of the file's lines."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.monotonically_increasing_id().alias("row"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("v"))


def thermal(spark: SparkSession, path: str, width: int, height: int, kind: str = "<u2", suffix: str = "*") -> DataFrame:
    """(series, frame, x, y, v) of flat files with the width fastest, then the height, then frames; one frame at a time."""
    return frames(contents(spark, path, suffix), width, height, kind)


def contents(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(series, content) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select(_stem().alias("series"), "content")


def frames(files: DataFrame, width: int, height: int, kind: str = "<u2") -> DataFrame:
    """(series, frame, x, y, v) of files that are there as (series, content)."""
    y, x = (g.ravel() for g in np.mgrid[:height, :width])

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["series"], part["content"]):
                v = np.frombuffer(content, kind).reshape(-1, width * height)
                for i, one in enumerate(v):
                    yield pd.DataFrame({"series": name, "frame": i, "x": x, "y": y, "v": one.astype(float)})

    return files.mapInPandas(decode, "series string, frame int, x int, y int, v double")


def serpentine(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """(number, column, row) of a scan that turns around in every other column."""
    grid = spark.range(columns * rows).select((F.col("id") + 1).alias("number"), F.floor(F.col("id") / rows).alias("column"), (F.col("id") % rows).alias("place"))
    return grid.select("number", "column", F.when(F.col("column") % 2 == 1, rows - 1 - F.col("place")).otherwise(F.col("place")).alias("row"))


def grid_files(files: DataFrame, grid: DataFrame, name: str = "path") -> DataFrame:
    """Files with their place in the grid, by the number in parentheses in their name."""
    number = F.expr(f"try_cast(regexp_extract({name}, '\\\\(([0-9]+)\\\\)', 1) AS BIGINT)")
    return files.withColumn("number", number).join(F.broadcast(grid), "number")
