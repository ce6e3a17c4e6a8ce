"""Sampled series: windows, framing, quantiles and outliers along a series.

A series is a set of rows (series key, i, v) with i counting from 0. Every function
partitions by the key, so series are independent and long tables of series scale out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number(df: DataFrame, key: str, order: list[str], to: str = "i") -> DataFrame:
    """Adds the place of each row in its series, from 0."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def frame(key: str, before: int, after: int, order: str = "i") -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(-before, after)


def moving_average(df: DataFrame, key: str, length: int, v: str = "v", to: str = "smooth") -> DataFrame:
    """Centred mean of ``length`` samples that shrinks at the edges; odd lengths."""
    half = length // 2
    return df.withColumn(to, F.avg(v).over(frame(key, half, half)))


def moving_average_even(df: DataFrame, key: str, length: int, v: str = "v", to: str = "smooth") -> DataFrame:
    """The even-length form: samples -L/2 to L/2 - 1, the first L/2 sums over one more than they hold."""
    half = length // 2
    n = F.count("*").over(Window.partitionBy(key))
    held = F.least(F.col("i"), F.lit(half)) + F.least(n - F.col("i"), F.lit(half))
    return df.withColumn(to, F.sum(v).over(frame(key, half, half - 1)) / F.when(F.col("i") < half, held + 1).otherwise(held))


def reflected(df: DataFrame, key: str, half: int, v: str = "v") -> DataFrame:
    """The series with ``half`` samples mirrored before its start and after its end."""
    n = F.count("*").over(Window.partitionBy(key))
    d = df.select(key, "i", v, n.alias("n"))
    head = d.where(F.col("i") < half).select(key, (-1 - F.col("i")).alias("i"), v)
    tail = d.where(F.col("i") >= F.col("n") - half).select(key, (2 * F.col("n") - 1 - F.col("i")).alias("i"), v)
    return d.select(key, "i", v).unionByName(head).unionByName(tail)


def rolling_median(df: DataFrame, key: str, length: int, v: str = "v", to: str = "median") -> DataFrame:
    half = length // 2
    n = F.count("*").over(Window.partitionBy(key))
    base = df.select(key, "i", v).withColumn("n", n)
    wide = reflected(df, key, half, v).withColumn(to, F.percentile(v, F.lit(0.5)).over(frame(key, half, half)))
    return wide.join(base.select(key, "i"), [key, "i"])


def mad_outliers(df: DataFrame, key: str, length: int, k: float, v: str = "v") -> DataFrame:
    """Deviation from the rolling median, the rolling median of it, and whether it exceeds ``k`` times that."""
    centred = rolling_median(df, key, length, v).withColumn("dev", F.abs(F.col(v) - F.col("median")))
    mad = rolling_median(centred.select(key, "i", F.col("dev")), key, length, "dev", "mad")
    return centred.join(mad.select(key, "i", "mad"), [key, "i"]).withColumn("outlier", F.col("dev") > k * F.col("mad"))


def cumulative_trapezoid(df: DataFrame, key: str, v: str = "v", to: str = "integral") -> DataFrame:
    w = Window.partitionBy(key).orderBy("i")
    step = F.coalesce((F.col(v) + F.lag(v).over(w)) / 2, F.lit(0.0))
    return df.withColumn("__step", step).withColumn(to, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def sliding_slope(df: DataFrame, key: str, length: int, stride: int, v: str = "v", to: str = "slope") -> DataFrame:
    """Least-squares slope over ``length`` samples from every ``stride``-th sample on; partial windows drop out."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(0, length - 1)
    held = df.withColumn("__n", F.count("*").over(w)).withColumn(to, F.regr_slope(v, F.col("i").cast("double")).over(w))
    return held.where((F.col("__n") == length) & (F.col("i") % stride == 0)).drop("__n")


def frames(df: DataFrame, key: str, length: int, hop: int) -> DataFrame:
    """Adds frame and place in it; a sample falls in ``length / hop`` frames. Frames that run past the end drop out."""
    n = F.count("*").over(Window.partitionBy(key))
    last = F.floor(F.col("i") / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - length + 1) / hop))
    out = df.withColumn("__n", n).withColumn("frame", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return out.withColumn("n_in", F.col("i") - F.col("frame") * hop).where(F.col("frame") * hop + length <= F.col("__n")).drop("__n")


def dft(df: DataFrame, keys: list[str], place: str, length: int, bins: list[int], v: str = "v", window: bool = False) -> DataFrame:
    """Real and imaginary part of the given bins of a discrete Fourier transform of ``length`` places."""
    x = F.col(v) * (0.5 - 0.5 * F.cos(F.col(place) * (2 * 3.141592653589793 / length))) if window else F.col(v)
    turned = df.withColumn("k", F.explode(F.array(*[F.lit(b) for b in bins])))
    angle = F.col("k") * F.col(place) * (-2 * 3.141592653589793 / length)
    return turned.groupBy(*keys, "k").agg(F.sum(x * F.cos(angle)).alias("re"), F.sum(x * F.sin(angle)).alias("im"))


def unwrap(df: DataFrame, key: str, phase: str, order: str, to: str = "unwrapped") -> DataFrame:
    """Adds whole turns so that neighbouring phases differ by half a turn at most."""
    turn = 2 * 3.141592653589793
    w = Window.partitionBy(key).orderBy(order)
    jump = F.coalesce(F.col(phase) - F.lag(phase).over(w), F.lit(0.0))
    turns = df.withColumn("__turns", F.round(jump / turn).cast("long"))
    return turns.withColumn(to, F.col(phase) - turn * F.sum("__turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turns")


def quantile_unbiased(df: DataFrame, keys: list[str], v: str, shares: list[float]) -> DataFrame:
    """Median-unbiased quantiles (type 8): place (n + 1/3) p + 1/3, between neighbours linearly."""
    w = Window.partitionBy(*keys).orderBy(v, *[c for c in df.columns if c not in (*keys, v)])
    ranked = df.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    wanted = ranked.withColumn("p", F.explode(F.array(*[F.lit(p) for p in shares])))
    place = F.least(F.greatest((F.col("n") + 1 / 3) * F.col("p") + 1 / 3, F.lit(1.0)), F.col("n").cast("double"))
    low = F.floor(place)
    share = F.when(F.col("r") == low, 1 - (place - low)).when(F.col("r") == low + 1, place - low)
    return wanted.withColumn("__share", share).where(F.col("__share").isNotNull()).groupBy(*keys, "p").agg(F.sum(F.col("__share") * F.col(v)).alias("q"))


def resample_linear(df: DataFrame, key: str, t: str, v: str, step: float) -> DataFrame:
    """Values at every whole multiple of ``step`` within the series, between neighbours linearly."""
    w = Window.partitionBy(key).orderBy(t)
    pairs = df.withColumn("__t1", F.lead(t).over(w)).withColumn("__v1", F.lead(v).over(w)).where(F.col("__t1") > F.col(t))
    first, last = F.ceil(F.col(t) / step), F.ceil(F.col("__t1") / step) - 1
    grid = pairs.where(first <= last).withColumn("m", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    at = F.col("m") * step
    return grid.select(key, "m", (F.col(v) + (F.col("__v1") - F.col(v)) * (at - F.col(t)) / (F.col("__t1") - F.col(t))).alias("v"))


def convolve(df: DataFrame, keys: list[str], place: str, v: str, kernel: list[float], crop: int) -> DataFrame:
    """Full convolution with a short kernel, places 0 to crop - 1."""
    taps = F.posexplode(F.array(*[F.lit(float(x)) for x in kernel])).alias("m", "h")
    spread = df.select(*keys, place, v, taps)
    return spread.groupBy(*keys, (F.col(place) + F.col("m")).alias(place)).agg(F.sum(F.col(v) * F.col("h")).alias("y")).where(F.col(place) < crop)


def first_slope_above_mean(df: DataFrame, key: str, slope: str) -> DataFrame:
    """The first place whose slope exceeds the mean slope of its series (the knee)."""
    mean = F.avg(slope).over(Window.partitionBy(key))
    return df.withColumn("__m", mean).where(F.col(slope) > F.col("__m")).groupBy(key).agg(F.min("i").alias("knee"))


def is_peak(v: str, key: str) -> Column:
    return F.abs(F.col(v)) == F.max(F.abs(F.col(v))).over(Window.partitionBy(key))
