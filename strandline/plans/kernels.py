"""Queries whose groups go through NumPy kernels: one block, trace or batch a group.

A block, trace or batch has a bounded size.

Results are rows without an SQL twin; tests hold the kernels against closed forms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandline.functions import kernels as k
from strandline.operators import blocks
from strandline.plans.registry import S, query, series, table

#: Distances of the batch grids in cells, and the variogram that kriging uses.
GRID, REACH = 10, 4.0


def gaussian(h):
    return 1 - np.exp(-((h / REACH) ** 2))


def per_trace(spark, d, f, result: str) -> DataFrame:
    """``f`` of each embedding as a trace, in Arrow batches and without a shuffle; f gives an array of doubles."""
    make = F.pandas_udf(lambda column: column.map(lambda v: np.round(f(np.asarray(v, float)), 6)), "array<double>")
    return table(spark, d, "embeddings").select("vec_id", make("embedding").alias(result))


TRACES = {
    "k05_wavelet_packet": (lambda v: k.haar_packet(v, 3), "energy"),
    "k10_fourier_resample": (lambda v: k.fourier_resample(v, 32), "samples"),
    "k21_spectral_lowpass": (lambda v: k.spectral_lowpass(v, 9), "samples"),
    "k22_phase_rotation": (lambda v: k.rotate_phase(v, np.pi / 4), "samples"),
}
for name, (f, column) in TRACES.items():
    query(name)(lambda spark, d, f=f, column=column: per_trace(spark, d, f, column))


@query("k01_zero_phase_lowpass")
def zero_phase(spark, d):
    """Every user's series forward and backward through a low-pass, block by block."""
    return blocks.zero_phase(series(spark, d), "user_id", "v", 0.1).select("user_id", "i", F.round("v", 6).alias("smooth"))


@query("k02_envelope")
def envelope(spark, d):
    """The modulus of every user's analytic signal, by transforms in blocks."""
    return blocks.envelope(series(spark, d), "user_id", "v").select("user_id", "i", F.round("v", 6).alias("envelope"))


@query("k48_band_envelope_mean")
def band_envelope_mean(spark, d):
    """One channel's chain: mean taken away, low-pass, envelope, mean of five samples."""
    return blocks.band_envelope(series(spark, d), "user_id", "v", 0.2, 5).select("user_id", "i", F.round("v", 6).alias("smooth"))


@query("w10_gaussian_smooth", f"""WITH {S}, g AS (SELECT unnest(range(-15, 16)) AS m)
 SELECT a.user_id, a.i, round(sum(exp(-0.5 * (m / 5.0) * (m / 5.0)) * b.v) / sum(exp(-0.5 * (m / 5.0) * (m / 5.0))), 6) AS smooth FROM s a, g JOIN s b ON b.user_id = a.user_id AND b.i = a.i + m GROUP BY a.user_id, a.i""")
def gaussian_smooth(spark, d):
    """The mean of the 31 samples around each by a Gaussian, over what lies within the series."""
    weight = np.exp(-0.5 * (np.arange(-15, 16) / 5.0) ** 2)
    return blocks.smoothed(series(spark, d), "user_id", "v", weight).select("user_id", "i", F.round("v", 6).alias("smooth"))


def batches(spark, d) -> DataFrame:
    """Parts as samples of 10 by 10 cells, one mean value for each cell sampled; a batch is a brand and has 100 cells at most."""
    p = table(spark, d, "part").where("p_partkey % 3 = 0")
    return p.groupBy("p_brand", (F.col("p_partkey") % GRID).alias("x"), (F.floor(F.col("p_partkey") / GRID) % GRID).alias("y")).agg(F.avg("p_retailprice").alias("v"))


@query("k15_point_kriging")
def point_kriging(spark, d):
    """Values of the unsampled cells of each batch, with standard deviation; fewer than six samples give zero and -1."""
    every = np.array([(x, y) for x in range(GRID) for y in range(GRID)], float)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        own = rows[["x", "y"]].to_numpy(float)
        rest = every[~(every[:, None, :] == own[None, :, :]).all(axis=2).any(axis=1)]
        if len(own) < 6 or not len(rest):
            v, s = np.zeros(len(rest)), np.full(len(rest), -1.0)
        else:
            v, s = k.krige(rest, own, rows["v"].to_numpy(float), gaussian)
        return pd.DataFrame({"p_brand": rows["p_brand"].iloc[0], "x": rest[:, 0].astype(int), "y": rest[:, 1].astype(int), "v": np.round(v, 6), "sigma": np.round(s, 6)})

    return batches(spark, d).groupBy("p_brand").applyInPandas(group, "p_brand string, x long, y long, v double, sigma double")


@query("k16_block_error")
def block_error(spark, d):
    """Sum of kriging variances of each batch, an error map folded to one figure."""
    return point_kriging(spark, d).groupBy("p_brand").agg(F.count("*").alias("cells"), F.round(F.sum(F.pow("sigma", F.lit(2))), 4).alias("error"))


@query("k13_variogram_polynomial")
def variogram_polynomial(spark, d):
    """Variogram of each series for lags 1 to 8, made smooth by a cubic. The sums are Spark's; a group has eight rows."""
    s = series(spark, d).select("user_id", "i", "v")
    ahead = s.select("user_id", "i", F.col("v").alias("w")).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("user_id", (F.col("i") - F.col("lag")).alias("i"), "w", "lag")
    raw = s.join(ahead, ["user_id", "i"]).groupBy("user_id", "lag").agg(F.avg(F.pow(F.col("v") - F.col("w"), 2)).alias("g"))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        return rows.assign(g=np.round(k.smooth_polynomial(rows["lag"].to_numpy(float), rows["g"].to_numpy(), 3), 4))[["user_id", "lag", "g"]]

    return raw.groupBy("user_id").applyInPandas(group, "user_id long, lag int, g double")


#: Sixteen neighbouring vectors make a matrix.
BLOCK = 16


@query("k20_svd_denoise")
def svd_denoise(spark, d):
    """Rank-4 form of matrices of 16 neighbouring vectors."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        m = k.low_rank(np.stack(rows["embedding"].to_list()).astype(float), 4)
        return pd.DataFrame({"vec_id": rows["vec_id"], "embedding": list(np.round(m, 5))})

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.groupBy(F.floor(F.col("vec_id") / BLOCK).alias("block")).applyInPandas(group, "vec_id long, embedding array<double>")


def pulses(n: int = 64) -> np.ndarray:
    """A dictionary of shifted pulses."""
    t = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.exp(-((t / 2.0) ** 2)) * np.cos(2 * np.pi * 0.2 * t)


def _sparse(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-9, 0.0, x)


query("k25_sparse_recovery")(lambda spark, d: per_trace(spark, d, lambda v: _sparse(k.fista(pulses(len(v)), v, 0.5)), "reflectivity"))
query("k26_matching_pursuit")(lambda spark, d: per_trace(spark, d, lambda v: k.matching_pursuit(pulses(len(v)), v, 5), "reflectivity"))
query("k27_parabola")(lambda spark, d: per_trace(spark, d, lambda v: k.total_least_squares_parabola(np.linspace(-1, 1, len(v)), v), "coefficients"))


@query("k28_position_correction")
def position_correction(spark, d):
    """The shift of each customer's orders against their nation's mean price: Newton steps whose sums are Spark's, six rounds."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", (F.col("o_totalprice") / 1e5).alias("v"))
    at = o.groupBy("c_nationkey").agg(F.lit(1.0).alias("p"))
    for _ in range(6):  # cosh loss: gradient sum(tanh), curvature sum(1 - tanh^2)
        t = F.tanh(F.col("p") - F.col("v"))
        at = o.join(at, "c_nationkey").groupBy("c_nationkey", "p").agg(F.sum(t).alias("g"), F.sum(1 - t * t).alias("h")).select("c_nationkey", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("p") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("g") / F.col("h"))))).alias("p"))
    return at.select("c_nationkey", F.round("p", 5).alias("p"))


@query("k31_water_level")
def water_level(spark, d):
    """The level at which the power of each nation's channels is spent, by thirty halvings as column expressions."""
    # equal channels are counted, so a nation's array has a place for each of the nine gains
    equal = table(spark, d, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 9 + 1.0).alias("x")).agg(F.count("*").alias("n"))
    g = equal.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("gain")).withColumn("low", F.lit(0.0)).withColumn("high", F.lit(20.0))
    used = lambda level: F.aggregate("gain", F.lit(0.0), lambda a, c: a + c["n"] * F.greatest(level - 1 / c["x"], F.lit(0.0)))
    halve = lambda acc, _: F.when(used((acc["low"] + acc["high"]) / 2) > 10, F.struct(acc["low"].alias("low"), ((acc["low"] + acc["high"]) / 2).alias("high"))).otherwise(F.struct(((acc["low"] + acc["high"]) / 2).alias("low"), acc["high"].alias("high")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.struct("low", "high"), halve)
    return g.select("s_nationkey", F.round(found["low"], 6).alias("level"))


@query("k32_beamforming")
def beamforming(spark, d):
    """Zero-forcing weights of matrices of four neighbouring vectors' first eight components."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        h = np.stack([v[:8] for v in rows["embedding"]]).astype(float)
        return pd.DataFrame({"vec_id": rows["vec_id"], "weights": list(np.round(k.zero_forcing(h, 1e-3).T, 6))})

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.groupBy(F.floor(F.col("vec_id") / 4).alias("block")).applyInPandas(group, "vec_id long, weights array<double>")


def letter_code(spark, d) -> dict[str, str]:
    """The prefix code of the benchmark's characters; the driver gets a row for each of the code points in use."""
    chars = table(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return k.prefix_code({r["c"]: r["n"] for r in chars.groupBy("c").agg(F.count("*").alias("n")).collect()})


@query("k33_huffman_encode")
def huffman_encode(spark, d):
    """Bits of every benchmark text, and their number."""
    code = letter_code(spark, d)
    encode = F.pandas_udf(lambda column: column.map(lambda t: "".join(code[c] for c in t or "")), "string")
    return table(spark, d, "benchmark").select("item_id", encode("text").alias("bits")).withColumn("n", F.length("bits").cast("long"))


@query("k34_huffman_decode", "SELECT item_id, text FROM benchmark")
def huffman_decode(spark, d):
    """Encodes and decodes: the texts again."""
    code = letter_code(spark, d)
    decode = F.pandas_udf(lambda column: column.map(lambda bits: k.decode_prefix(bits, code)), "string")
    return huffman_encode(spark, d).select("item_id", decode("bits").alias("text"))
