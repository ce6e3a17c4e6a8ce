"""Block kriging by frequency: traces of all unsampled cells of a batch from those sampled, and the error by bin."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.kernels import block_weights


def spectrum(v: Column, length: int) -> Column:
    """Array of (k, re, im) for the bins 0 to ``length`` / 2 of an array of so many samples."""
    turn = lambda i, k: i * k * (-2 * math.pi / length)
    part = lambda f, k: F.aggregate(F.transform(v, lambda x, i: x * f(turn(i, k))), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(length // 2)), lambda k: F.struct(k.alias("k"), part(F.cos, k).alias("re"), part(F.sin, k).alias("im")))


def samples_of(bins: Column, length: int) -> Column:
    """The samples whose spectrum is ``bins``, an array of (k, re, im)."""
    weight = lambda b: F.when((b["k"] == 0) | (b["k"] * 2 == length), 1.0).otherwise(2.0) / length
    angle = lambda b, n: b["k"] * n * (2 * math.pi / length)
    one = lambda n: F.aggregate(F.transform(bins, lambda b: weight(b) * (b["re"] * F.cos(angle(b, n)) - b["im"] * F.sin(angle(b, n)))), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), one)


def block_weight_rows(cells: DataFrame, batch: str, grid: int, reach: DataFrame, nugget: float) -> DataFrame:
    """(batch, k, x, y, sx, sy, w, sigma): the weight of every sampled cell (sx, sy) for every other cell of the batch, by bin.

    ``cells`` has the batch and x, y of its sampled cells, ``reach`` has k and reach. A batch and bin is one system of at
    most ``grid`` squared equations, solved for all its cells at once.
    """
    every = np.array([(x, y) for x in range(grid) for y in range(grid)], float)
    kind = cells.schema[batch].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        own = rows[["x", "y"]].to_numpy(float)
        rest = every[~(every[:, None, :] == own[None, :, :]).all(axis=2).any(axis=1)]
        w, sigma = block_weights(rest, own, float(rows["reach"].iloc[0]), nugget)
        n, m = w.shape
        to, of = np.repeat(rest, m, axis=0).astype(int), np.tile(own, (n, 1)).astype(int)
        return pd.DataFrame({batch: rows[batch].iloc[0], "k": rows["k"].iloc[0], "x": to[:, 0], "y": to[:, 1], "sx": of[:, 0], "sy": of[:, 1], "w": w.ravel(), "sigma": np.repeat(sigma, m)})

    met = cells.select(batch, "x", "y").distinct().crossJoin(F.broadcast(reach))
    return met.groupBy(batch, "k").applyInPandas(solve, f"{batch} {kind}, k int, x long, y long, sx long, sy long, w double, sigma double")


def block_kriging(samples: DataFrame, batch: str, grid: int, length: int, reach: Callable[[int], float], nugget: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """((batch, x, y, v), (batch, x, y, k, sigma)): traces of the unsampled cells, and the error of each bin.

    ``samples`` has the batch, x, y from 0 to ``grid`` - 1, each cell once, and v, an array of ``length`` samples. Every bin
    has a covariance of its own ``reach``. Spectra meet the weights on equal keys and are
    added up, then turned back to samples.
    """
    spark = samples.sparkSession
    bins = spark.createDataFrame([(k, float(reach(k))) for k in range(length // 2 + 1)], "k int, reach double")
    spectra = samples.select(batch, F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(spectrum(F.col("v"), length)).alias("__bin")).select(batch, "sx", "sy", "__bin.*")
    weights = block_weight_rows(samples, batch, grid, bins, nugget)
    summed = weights.join(spectra, [batch, "k", "sx", "sy"]).groupBy(batch, "x", "y", "k").agg(F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"), F.first("sigma").alias("sigma"))
    traces = summed.groupBy(batch, "x", "y").agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("__bins")).select(batch, "x", "y", samples_of(F.col("__bins"), length).alias("v"))
    return traces, summed.select(batch, "x", "y", "k", "sigma")
