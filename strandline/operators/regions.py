"""Regions of an image around given seeds, grown along the lines through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def grown_along(cells: DataFrame, seeds: DataFrame, keys: list[str], line: str, along: str, v: str, threshold: float) -> DataFrame:
    """(keys, line, along) of the cells that are connected to a seed of their line.

    A line's cells of at least ``threshold`` times its largest value form runs, which a cell
    below it or a missing place ends; the running sum of such ends numbers them. Runs with a
    seed stay. Only lines that have seeds are read on, and a line is as long as the image.
    """
    lines = seeds.select(*keys, line).distinct()
    own = cells.join(lines, [*keys, line]).join(seeds.select(*keys, line, along, F.lit(1).alias("__seed")).distinct(), [*keys, line, along], "left")
    whole = Window.partitionBy(*keys, line)
    high = own.withColumn("__top", F.max(v).over(whole)).where(F.col(v) >= threshold * F.col("__top"))
    order = whole.orderBy(along)
    begins = F.when(F.col(along) - F.lag(along).over(order) == 1, 0).otherwise(1)
    runs = high.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seeded = F.max("__seed").over(Window.partitionBy(*keys, line, "__run"))
    return runs.withColumn("__with", seeded).where("__with = 1").select(*keys, line, along)


def grow(cells: DataFrame, seeds: DataFrame, keys: list[str], x: str = "x", y: str = "y", v: str = "v", threshold: float = 0.5) -> DataFrame:
    """(keys, x, y): the cells grown from the seeds along rows and along columns, each once. A seed whose own cell is too low grows nothing."""
    one, other = grown_along(cells, seeds, keys, y, x, v, threshold), grown_along(cells, seeds, keys, x, y, v, threshold)
    return one.select(*keys, x, y).unionByName(other.select(*keys, x, y)).distinct()
