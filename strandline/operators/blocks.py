"""Series of any length in blocks: recursive filters, kernels with short reach, and Fourier transforms.

A series is rows (key, i, v) with i from 0. No task holds a series: samples meet in
blocks of bounded size, and what one block must know of another is a few numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.kernels import lowpass_coefficients
from strandline.sources.shared import Steps

#: Samples of a block, and blocks that one step of the scan puts together.
BLOCK, FAN = 4096, 256


class Cascade:
    """Filter sections in a row as one linear system: the state is that of all sections."""

    def __init__(self, sections: list[tuple[np.ndarray, np.ndarray]]):
        self.sections = sections
        self.order = sum(len(a) - 1 for _, a in sections)
        self.steady = np.concatenate([[sum(b[k + 1 :]) - sum(a[k + 1 :]) for k in range(len(a) - 1)] for b, a in sections])

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and states after the last column of ``x``, a row for each block; all blocks go through a sample together."""
        out, at, ends = x, 0, []
        for b, a in self.sections:
            n = len(a) - 1
            z = np.zeros((len(x), n + 1))
            z[:, :n] = state[:, at : at + n]
            y = np.empty_like(out)
            for i in range(out.shape[1]):
                v = out[:, i]
                y[:, i] = b[0] * v + z[:, 0]
                z[:, :n] = z[:, 1:] + v[:, None] * b[1:] - y[:, i, None] * a[1:]
            out, at = y, at + n
            ends.append(z[:, :n])
        return out, np.concatenate(ends, axis=1)

    def natural(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Without input: outputs (length, order) and the states after, by the states before."""
        out, after = self.run(np.zeros((self.order, length)), np.eye(self.order))
        return out.T, after.T


def _by_length(values: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the arrays of each length."""
    size = values.map(len).to_numpy()
    return [(places, np.stack(values.to_numpy()[places])) for n in np.unique(size) if len(places := np.nonzero(size == n)[0])]


def in_blocks(df: DataFrame, key: str, v: str, block: int) -> DataFrame:
    """(key, block, x): the samples of each block in order."""
    held = F.array_sort(F.collect_list(F.struct("i", F.col(v).cast("double").alias("x"))))
    return df.groupBy(key, F.floor(F.col("i") / block).alias("block")).agg(F.transform(held, lambda s: s["x"]).alias("x"))


def entry_states(exits: DataFrame, key: str, step: np.ndarray, steps: Steps, name: str, level: int = 0) -> DataFrame:
    """(key, place, entry): the state in which each block begins.

    ``exits`` has, for places from 0, the state after the block if it began from zero (for place 0 the true
    one); ``step`` is what a block makes of the state before it. The maps of FAN blocks
    are put together, the scan goes on over those, and its results go back down; a key of
    any length takes as many levels as its logarithm.
    """
    m = len(step)
    after = lambda s, c: F.array(*[sum((float(step[r, j]) * s[j] for j in range(m)), c[r]) for r in range(m)])
    zero = F.array(*[F.lit(0.0)] * m)
    group = exits.groupBy(key, F.floor(F.col("place") / FAN).alias("group")).agg(F.array_sort(F.collect_list(F.struct("place", "exit"))).alias("own"))
    states = F.aggregate("own", F.struct(zero.alias("s"), F.array(zero).alias("all")), lambda acc, c: F.struct(after(acc["s"], c["exit"]).alias("s"), F.concat(acc["all"], F.array(after(acc["s"], c["exit"]))).alias("all")))
    local = steps.keep(group.select(key, "group", "own", states.alias("run")), f"{name}_local{level}")
    each = local.select(key, "group", F.posexplode("own").alias("nth", "c"), "run").select(key, "group", "nth", F.col("c.place").alias("place"), F.get("run.all", F.col("nth")).alias("entry"))
    if not local.where("group > 0").limit(1).count():
        return each.select(key, "place", "entry")
    over = np.linalg.matrix_power(step, FAN)
    before = entry_states(local.select(key, F.col("group").alias("place"), F.col("run.s").alias("exit")), key, over, steps, name, level + 1)
    powers = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in np.linalg.matrix_power(step, k)]) for k in range(FAN)])
    met = each.join(before.select(key, F.col("place").alias("group"), F.col("entry").alias("over")), [key, "group"])
    moved = F.transform(F.get(powers, F.col("nth")), lambda row: F.aggregate(F.zip_with(row, "over", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return met.select(key, "place", F.zip_with("entry", moved, lambda a, b: a + b).alias("entry"))


def _filtered(blocks: DataFrame, key: str, cascade: Cascade, block: int, steps: Steps, name: str) -> DataFrame:
    """``blocks`` (key, place, x) through the filter in the order of their places, from a steady first value; all but the first and last are whole."""
    order = cascade.order

    @F.pandas_udf("out array<double>, exit array<double>")
    def alone(x: pd.Series, first: pd.Series) -> pd.DataFrame:
        out, ends = [None] * len(x), [None] * len(x)
        for places, rows in _by_length(x):
            begin = first.to_numpy()[places][:, None] * rows[:, :1] * cascade.steady
            y, z = cascade.run(rows, begin)
            for p, a, b in zip(places, y, z):
                out[p], ends[p] = a, b
        return pd.DataFrame({"out": out, "exit": ends})

    run = steps.keep(blocks.withColumn("r", alone("x", (F.col("place") == 0).cast("double"))).select(key, "place", "r.out", "r.exit"), f"{name}_run")
    natural, step = cascade.natural(block)
    entries = entry_states(run.select(key, "place", "exit"), key, step, steps, name)

    @F.pandas_udf("array<double>")
    def settled(out: pd.Series, entry: pd.Series, first: pd.Series) -> pd.Series:
        got = [None] * len(out)
        begin = np.stack(entry.to_numpy()) * (1 - first.to_numpy())[:, None] if len(out) else np.zeros((0, order))
        for places, rows in _by_length(out):
            for p, y in zip(places, rows + begin[places] @ natural[: rows.shape[1]].T):
                got[p] = y
        return pd.Series(got)

    met = run.join(entries, [key, "place"])
    return steps.keep(met.select(key, "place", settled("out", "entry", (F.col("place") == 0).cast("double")).alias("x")), name)


def zero_phase(df: DataFrame, key: str, v: str, cutoff: float, order: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, i, v) through a low-pass forward and backward, the ends continued as odd mirror images.

    Each block runs once from a state of zero, the blocks' exits are put together by a scan
    of affine maps, and each block adds what its entry state brings; then the same
    backward over the same blocks.
    """
    steps, cascade, pad = Steps(df.sparkSession, "filter"), Cascade(lowpass_coefficients(cutoff, order)), 3 * (order + 1)
    ends = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by(v, "i").alias("head"), F.max_by(v, "i").alias("tail")).withColumn("pad", F.least(F.lit(pad), F.col("n") - 1))
    met = df.select(key, "i", F.col(v).cast("double").alias("v")).join(ends, key)
    # each row deals out its own mirror images: a union of three reads may meet a join with partitions of its own number
    place = lambda i, value: F.struct(i.cast("long").alias("i"), value.cast("double").alias("v"))
    own = place(F.col("pad") + F.col("i"), F.col("v"))
    before = F.when((F.col("i") >= 1) & (F.col("i") <= F.col("pad")), place(F.col("pad") - F.col("i"), 2 * F.col("head") - F.col("v")))
    behind = F.when((F.col("i") < F.col("n") - 1) & (F.col("i") >= F.col("n") - 1 - F.col("pad")), place(F.col("pad") + 2 * (F.col("n") - 1) - F.col("i"), 2 * F.col("tail") - F.col("v")))
    wide = met.select(key, F.inline(F.array_compact(F.array(own, before, behind))))
    forth = _filtered(in_blocks(wide, key, "v", block).withColumnRenamed("block", "place"), key, cascade, block, steps, "forth")
    last = F.floor((F.col("n") + 2 * F.col("pad") - 1) / block)
    turned = forth.join(ends.select(key, "n", "pad"), key).select(key, (last - F.col("place")).alias("place"), F.reverse("x").alias("x"))
    back = _filtered(turned, key, cascade, block, steps, "back")
    rows = back.join(ends.select(key, "n", "pad", "head"), key).select(key, "n", "pad", "head", (last - F.col("place")).alias("place"), F.posexplode(F.reverse("x")).alias("nth", "v"))
    found = rows.withColumn("i", F.col("place") * block + F.col("nth") - F.col("pad")).where("i >= 0 and i < n")
    return found.select(key, "i", F.when(F.col("n") == 1, F.col("head").cast("double")).otherwise(F.col("v")).alias("v"))


def smoothed(df: DataFrame, key: str, v: str, kernel: np.ndarray, block: int = BLOCK, zeros: bool = False) -> DataFrame:
    """(key, i, v): the mean by an odd ``kernel``, over what of it lies within the series, or with places outside as zeros. A block gets its neighbours' samples within reach."""
    half = len(kernel) // 2
    own = F.floor(F.col("i") / block)
    spread = df.select(key, "i", F.col(v).cast("double").alias("v"), F.explode(F.sequence(F.floor((F.col("i") - half) / block), F.floor((F.col("i") + half) / block))).alias("block"), own.alias("home")).where("block >= 0")
    held = spread.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.max(F.when(F.col("home") == F.col("block"), F.col("i"))).alias("last")).where("last is not null")

    @F.pandas_udf("array<double>")
    def mean(x: pd.Series) -> pd.Series:
        got = [None] * len(x)
        for places, rows in _by_length(x):
            wide = np.pad(rows, ((0, 0), (half, half)))
            there = np.pad(np.ones(rows.shape[1]), half)
            n = rows.shape[1]
            total = sum(kernel[j] * wide[:, j : j + n] for j in range(len(kernel)))
            mass = kernel.sum() if zeros else sum(kernel[j] * there[j : j + n] for j in range(len(kernel)))
            for p, y in zip(places, total / mass):
                got[p] = y
        return pd.Series(got)

    done = held.select(key, "block", "last", F.col("s.i").alias("at"), mean(F.transform("s", lambda s: s["v"])).alias("y"))
    rows = done.select(key, "block", F.explode(F.arrays_zip("at", "y")).alias("r")).select(key, "block", F.col("r.at").alias("i"), F.col("r.y").alias("v"))
    return rows.where(F.floor(F.col("i") / block) == F.col("block")).select(key, "i", "v")


def _transformed(df: DataFrame, keys: list[str], place: str, pairs: list[str], twiddle: Column | None, sign: int) -> DataFrame:
    """Fourier transforms of ``size`` places over ``place`` for each of ``keys``: (keys, size, nth, pairs), missing places being zero. ``twiddle`` gives the second factor's index of each group."""
    held = F.collect_list(F.struct(F.col(place).cast("int").alias("at"), *pairs))
    group = df.groupBy(*keys, "size").agg(held.alias("s"))
    schema = ", ".join(f"{p} array<double>" for p in pairs)

    @F.pandas_udf(schema)
    def fft(size: pd.Series, turn: pd.Series, at: pd.Series, *values: pd.Series) -> pd.DataFrame:
        out = {p: [None] * len(size) for p in pairs}
        lengths, counts = size.to_numpy(), at.map(len).to_numpy()
        for r in np.unique(lengths):
            rows = np.nonzero(lengths == r)[0]
            flat = lambda x: np.concatenate(x.to_numpy()[rows])
            places = np.repeat(np.arange(len(rows)), counts[rows]), flat(at)
            for re, im, x, y in zip(pairs[::2], pairs[1::2], values[::2], values[1::2]):
                z = np.zeros((len(rows), r), complex)
                z[places] = flat(x) + 1j * flat(y)
                z = np.fft.fft(z, axis=1) if sign < 0 else np.fft.ifft(z, axis=1)
                z *= np.exp(sign * 2j * np.pi * turn.to_numpy()[rows][:, None] * np.arange(r) / (r * r))
                for i, row in zip(rows, z):
                    out[re][i], out[im][i] = row.real, row.imag
        return pd.DataFrame(out)

    turn = F.lit(0).cast("long") if twiddle is None else twiddle
    done = group.withColumn("f", fft("size", turn, "s.at", *[f"s.{p}" for p in pairs])).select(*keys, "size", "f.*")
    zipped = done.select(*keys, "size", F.posexplode(F.arrays_zip(*pairs)).alias("nth", "r"))
    return zipped.select(*keys, "size", F.col("nth").cast("long").alias("nth"), *[F.col(f"r.{p}").alias(p) for p in pairs])


def fourier(df: DataFrame, key: str, pairs: list[str], inverse: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """The discrete Fourier transform of series of ``size`` squared places: (key, carried, size, i, pairs).

    ``df`` has key, size (a power of two), i and the real and imaginary columns named in ``pairs``, two for each
    signal. Place size * a + b is first transformed over a, turned by b times the new
    index, then over b: two shuffles of the series' rows, groups of ``size`` rows each, and n log n work.
    ``carried`` names columns that are one value a key and stay with its rows: Spark takes unpacked
    blocks for a few rows, so a join after a transform would broadcast all samples through the driver.
    """
    sign = 1 if inverse else -1
    keys = [key, *carried]
    split = df.select(*keys, "size", (F.floor(F.col("i") / F.col("size"))).alias("a"), (F.col("i") % F.col("size")).alias("b"), *pairs)
    first = _transformed(split, [*keys, "b"], "a", pairs, F.col("b"), sign).withColumnRenamed("nth", "k1")
    second = _transformed(first, [*keys, "k1"], "b", pairs, None, sign)
    return second.select(*keys, "size", (F.col("k1") + F.col("size") * F.col("nth")).alias("i"), *pairs)


def analytic(df: DataFrame, key: str, v: str) -> DataFrame:
    """(key, i, re, im): the samples and their Hilbert transform over the whole series.

    A circular convolution with the transform's closed kernel: row i carries its sample and the
    kernel at i and at i - n, so rows stay linear in n and no group holds more than ``fourier``'s.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    size = F.pow(F.lit(2), F.ceil(F.log2(2.0 * F.col("n")) / 2)).cast("long")
    met = df.select(key, "i", F.col(v).cast("double").alias("v")).join(n.select(key, "n", size.alias("size")), key)
    odd, turn = F.col("i") % 2 == 1, F.lit(np.pi) * F.col("i") / F.col("n")
    even_series = F.when(odd, 2 * F.cot(turn)).otherwise(0.0)
    odd_series = F.when(odd, F.cot(turn / 2)).otherwise(-F.tan(turn / 2))
    h = F.when(F.col("i") == 0, 0.0).otherwise(F.when(F.col("n") % 2 == 0, even_series).otherwise(odd_series) / F.col("n"))
    zero = F.lit(0.0)
    own = F.struct(F.col("i").cast("long").alias("i"), F.col("v").alias("ar"), zero.alias("ai"), (F.col("i") == 0).cast("double").alias("br"), h.alias("bi"))
    around = F.struct((F.col("size") * F.col("size") + F.col("i") - F.col("n")).cast("long").alias("i"), zero.alias("ar"), zero.alias("ai"), zero.alias("br"), h.alias("bi"))
    wide = met.select(key, "n", "size", F.explode(F.when(F.col("i") == 0, F.array(own)).otherwise(F.array(own, around))).alias("r")).select(key, "n", "size", "r.*")
    s = fourier(wide, key, ["ar", "ai", "br", "bi"], carried=("n",))
    product = s.select(key, "n", "size", "i", (F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")).alias("re"), (F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")).alias("im"))
    return fourier(product, key, ["re", "im"], inverse=True, carried=("n",)).where("i < n").select(key, "i", "re", "im")


def envelope(df: DataFrame, key: str, v: str) -> DataFrame:
    """(key, i, v): the modulus of the analytic signal."""
    return analytic(df, key, v).select(key, "i", F.hypot("re", "im").alias("v"))


def band_envelope(df: DataFrame, key: str, v: str, cutoff: float, width: int) -> DataFrame:
    """(key, i, v): less its mean, through a zero-phase low-pass, its envelope, the mean of ``width`` (odd) places around each, places outside being zero."""
    ends = df.groupBy(key).agg(F.avg(v).alias("mean"))
    centred = zero_phase(df.join(ends, key).select(key, "i", (F.col(v) - F.col("mean")).alias("v")), key, "v", cutoff)
    low = Steps(df.sparkSession, "low").keep(centred, "low")  # read twice
    return smoothed(envelope(low, key, "v"), key, "v", np.ones(width), zeros=True)


def _correlated(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, n, scale, lag, c): the correlation at every lag, with the length and the product of norms of each series."""
    own = df.groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.sum(F.pow(a, F.lit(2))) * F.sum(F.pow(b, F.lit(2)))).alias("scale"))
    size = F.pow(F.lit(2), F.ceil(F.log2(2.0 * F.col("n")) / 2)).cast("long")
    zero, carried = F.lit(0.0), ("n", "scale")
    wide = df.select(key, "i", F.col(a).cast("double").alias("ar"), zero.alias("ai"), F.col(b).cast("double").alias("br"), zero.alias("bi")).join(own.withColumn("size", size), key)
    s = fourier(wide, key, ["ar", "ai", "br", "bi"], carried=carried)
    product = s.select(key, *carried, "size", "i", (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("cr"), (F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("ci"))
    back = fourier(product, key, ["cr", "ci"], inverse=True, carried=carried)
    lag = F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(F.col("i") - F.col("size") * F.col("size"))
    return back.withColumn("lag", lag).where(F.col("lag") > -F.col("n")).select(key, *carried, "lag", F.col("cr").alias("c"))


def correlation(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, lag, c): the sum of a[i + lag] * b[i] at every lag, by spectra of the padded series; n log n work and rows linear in n."""
    return _correlated(df, key, a, b).select(key, "lag", "c")


def best_lag(df: DataFrame, key: str, a: str, b: str, low: Column, high: Column, digits: int = 4) -> DataFrame:
    """(key, lag, c): the first lag from ``low`` to ``high``, expressions of n, whose correlation is largest to ``digits`` digits.

    The spectra name the lags that come near the largest; those alone are added up anew,
    sample by sample.
    """
    steps = Steps(df.sparkSession, "lags")
    c = _correlated(df, key, a, b).where((F.col("lag") >= low) & (F.col("lag") <= high))
    near = c.withColumn("top", F.max("c").over(Window.partitionBy(key))).where(F.col("c") >= F.col("top") - F.col("scale") * 1e-9 - 10.0**-digits)
    lags = steps.keep(near.select(key, "lag"), "near")
    shifted = df.select(key, "i", F.col(b).alias("__b")).join(lags, key).withColumn("i", F.col("i") + F.col("lag"))
    exact = df.select(key, "i", F.col(a).alias("__a")).join(shifted, [key, "i"]).groupBy(key, "lag").agg(F.round(F.sum(F.col("__a") * F.col("__b")), digits).alias("c"))
    return exact.groupBy(key).agg(F.min_by("lag", F.struct(-F.col("c"), F.col("lag"))).alias("lag"), F.max("c").alias("c"))
