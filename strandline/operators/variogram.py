"""Sums over all pairs of positions within a lag limit, in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandline.sources.shared import Steps

#: Positions of a block at most, about; a task compares two blocks at a time.
BLOCK = 1024


def lag_sums(a: list[np.ndarray], b: list[np.ndarray] | None, radius: float, width: float) -> np.ndarray:
    """(bins, 3): pairs, pairs whose values are both there, and their squared differences, by lag; ``b`` None pairs ``a`` with itself."""
    (i, x, y, v, k), (j, s, t, w, m) = a, a if b is None else b
    d = np.sqrt((x[:, None] - s[None, :]) ** 2 + (y[:, None] - t[None, :]) ** 2)
    near = (d <= radius) & (i[:, None] != j[None, :])
    if b is None:
        near &= np.arange(len(i))[:, None] < np.arange(len(j))[None, :]
    lag, q = np.floor(d[near] / width).astype(int), ((v[:, None] - w[None, :]) ** 2)[near]
    held, bins = (k[:, None] & m[None, :])[near], math.floor(radius / width) + 2
    return np.stack([np.bincount(lag, minlength=bins), np.bincount(lag[held], minlength=bins), np.bincount(lag[held], weights=q[held], minlength=bins)], axis=1)


def pair_lags(df: DataFrame, key: str, radius: float, width: float) -> DataFrame:
    """(key, bin, n, held, total) over all pairs of different ids of one key that are no further apart than ``radius``.

    ``df`` has key, id, x, y and v. ``n`` counts the pairs, ``held`` those with both values, ``total`` sums their
    squared differences. Positions are dealt to cells of the radius and, there, to blocks; a block
    meets itself and each other block of its cell and the next ones once. Only sums leave the task that
    compares two blocks, so memory is bounded; the number of pairs compared is that of the near ones.
    """
    steps = Steps(df.sparkSession, "lags")
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    limit = radius * 2**52
    rows = df.where(F.col(key).isNotNull() & F.col("id").isNotNull() & (F.abs("x") < limit) & (F.abs("y") < limit)).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    place = [key, "cx", "cy"]
    sizes = rows.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("id", F.lit(23)), F.col("parts")).cast("int"))
    held = F.collect_list(F.struct("id", "x", "y", F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNotNull().alias("known")))
    blocks = steps.keep(dealt.groupBy(*place, "part").agg(held.alias("s"), F.first("parts").alias("parts")), "blocks")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    there = blocks.select(*place, "parts").distinct()
    wanted = blocks.select(*place, "part", around.alias("to")).select(key, (F.col("cx") + F.col("to.i")).alias("cx"), (F.col("cy") + F.col("to.j")).alias("cy"), F.col("cx").alias("from_x"), F.col("cy").alias("from_y"), F.col("part").alias("from"), ((F.col("to.i") == 0) & (F.col("to.j") == 0)).alias("same"))
    pairs = wanted.join(there, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("not same or `from` <= part").drop("parts")
    a = blocks.select(key, F.col("cx").alias("from_x"), F.col("cy").alias("from_y"), F.col("part").alias("from"), F.col("s").alias("a"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work
    met = pairs.repartition(tasks, key, "from_x", "from_y", "from", "part").join(a, [key, "from_x", "from_y", "from"]).join(blocks.select(*place, "part", F.col("s").alias("b")), [*place, "part"])
    own = F.col("same") & (F.col("from") == F.col("part"))

    @F.pandas_udf("array<struct<n: double, held: double, total: double>>")
    def sums(own: pd.Series, *columns: pd.Series) -> pd.Series:
        rows = zip(own, zip(*columns[:5]), zip(*columns[5:]))
        found = [lag_sums(a, None if o else b, radius, width) for o, a, b in rows]
        return pd.Series([[{"n": n, "held": h, "total": t} for n, h, t in f] for f in found])

    parts = [F.col(f"{side}.{c}") for side in "ab" for c in ("id", "x", "y", "v", "known")]
    each = met.select(key, F.posexplode(sums(own, *parts)).alias("bin", "r")).where("r.n > 0")
    # a sum that is no number comes back as null
    added = F.sum(F.coalesce("r.total", F.lit(float("nan")))).alias("total")
    total = each.groupBy(key, F.col("bin").cast("long").alias("bin")).agg(F.sum("r.n").alias("n"), F.sum("r.held").alias("held"), added)
    return total.select(key, "bin", F.col("n").cast("long").alias("n"), F.nullif(F.col("held"), F.lit(0.0)).alias("held"), "total")
