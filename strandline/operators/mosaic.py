"""Mosaics of overlapping tiles; how tiles are loaded and processed are functions from DataFrame to DataFrame that the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Columns that loaders and processors give: the mosaic, the tile's place in it, the pixel's place in the tile, its value.
PIXELS = {"series": "string", "row": "bigint", "col": "bigint", "y": "bigint", "x": "bigint", "v": "double"}
TILE = ["series", "row", "col"]


@dataclass(frozen=True)
class Layout:
    """Tiles of ``height`` x ``width`` pixels whose corners are ``down`` and ``right`` apart."""

    height: int
    width: int
    down: int
    right: int

    def ramp(self, edge: int) -> Column:
        """A weight that falls linearly over the outer ``edge`` pixels of a tile."""
        side = lambda c, n: F.least(F.lit(1.0), (F.col(c) + 1) / edge, (n - F.col(c)) / edge)
        return side("y", self.height) * side("x", self.width)


def checked(pixels: DataFrame, step: str) -> DataFrame:
    """The pixels, if their columns are those of ``PIXELS`` in any order; else a ValueError that names the step."""
    found = {f.name: f.dataType.simpleString() for f in pixels.schema}
    if found != PIXELS or len(pixels.columns) != len(PIXELS):
        raise ValueError(f"{step} gives {found}, but pixels are {PIXELS}")
    return pixels.select(*PIXELS)


def stitch(files: DataFrame, load: Callable[[DataFrame], DataFrame], process: Callable[[DataFrame], DataFrame], layout: Layout, weight: Column | None = None, average: bool = False, normalise: bool = False) -> DataFrame:
    """(series, gy, gx, v, n): the values of all tiles' pixels, processed and weighted, summed on the grid of each mosaic.

    ``weight`` is a column of a pixel's (row, col, y, x), so masks at the border are weights of
    zero; a pixel's ``n`` tiles count with weight zero too. ``average`` divides by the sum of
    weights, ``normalise`` first divides a tile by its largest absolute value. Null values
    count as no pixel; a pixel whose weights are all zero is 0. A pixel outside its tile raises.
    """
    pixels = checked(process(checked(load(files), "load")), "process").where(F.col("v").isNotNull())
    if normalise:
        pixels = pixels.withColumn("__top", F.max(F.abs("v")).over(Window.partitionBy(*TILE)))  # a tile is of fixed size
        pixels = pixels.withColumn("v", F.when(F.col("__top") > 0, F.col("v") / F.col("__top")).otherwise(F.lit(0.0)))
    inside = F.col("y").between(0, layout.height - 1) & F.col("x").between(0, layout.width - 1)
    w = F.when(inside, (F.lit(1.0) if weight is None else weight).cast("double")).otherwise(F.raise_error("a pixel lies outside its tile").cast("double"))
    placed = pixels.withColumn("w", w).select("series", (F.col("row") * layout.down + F.col("y")).alias("gy"), (F.col("col") * layout.right + F.col("x")).alias("gx"), "w", (F.col("v") * F.col("w")).alias("p"))
    sums = placed.groupBy("series", "gy", "gx").agg(F.sum("p").alias("p"), F.sum("w").alias("w"), F.count("*").alias("n"))
    v = F.when(F.col("w") != 0, F.col("p") / F.col("w")).otherwise(F.lit(0.0)) if average else F.col("p")
    return sums.select("series", "gy", "gx", v.alias("v"), "n")
