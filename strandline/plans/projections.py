"""Projection queries: one row for each part, seen as a sample at (x, y) with value v.

The SQL gives each formula written out; the Spark side is written apart from it, by the library's functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from strandline.functions import acoustics, geometry
from strandline.plans.registry import query, table

FROM = "(SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_retailprice AS v FROM part) AS samples"
#: A draw in [0, 1) from the id that both engines can repeat.
DRAW = "(id * 1103515245 % 2147483648) / 2147483648e0"


def projection(name: str, doc: str, where: str = "TRUE", **columns: str) -> None:
    """Registers the columns that ``SPARK[name]`` makes of (id, x, y, v), beside the statement of ``columns`` where ``where`` holds."""
    sql = f"SELECT id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {FROM} WHERE {where}"

    def run(spark, d):
        part = table(spark, d, "part")
        samples = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_retailprice").alias("v"))
        own = [F.col(c) for c in samples.columns]
        if name in KEPT:
            samples = samples.where(KEPT[name](*own))
        return samples.select("id", *[e.alias(c) for c, e in SPARK[name](*own).items()])

    run.__doc__ = doc
    query(name, sql)(run)


def six(e):
    return F.round(e, 6)


def pulse(id, x, y, v):
    t = (x - 50) / 100
    decay = (math.pi * 3.0) ** 2 / (4 * 0.3 * math.log(10))
    envelope = F.exp(-decay * t * t)
    return {"inphase": six(envelope * F.cos(10 * math.pi * t)), "quadrature": six(envelope * F.sin(10 * math.pi * t)), "envelope": six(envelope)}


def product_sum(id, x, y, v):
    a, b, c = geometry.gaussian_variogram(x, 1, 20), geometry.gaussian_variogram(y, 1, 10), 1 - F.exp(-v / 1000)
    return {"g": six(1 + a + b - a * b * (0.5 + 0.25 * c))}


def errors(id, x, y, v):
    u = F.pmod(id * 1103515245, F.lit(2**31)) / 2.0**31
    return {"uniform": F.round(u + u - 1, 9), "triangular": F.round(F.when(u < 0.5, F.sqrt(2 * u) - 1).otherwise(1 - F.sqrt(2 - 2 * u)), 9)}


def blur(id, x, y, v):
    density = geometry.normal_density(x, 50, 10) * geometry.normal_density(y, 25, 5)
    return {"b": F.round(F.when(density > 1e-4, density).otherwise(0.0), 9)}


def morlet(id, x, y, v):
    t = (x - 50) / 10
    atom = F.cos(6 * t) * F.exp(-t * t / 2)
    return {"a": six(atom - F.avg(atom).over(Window.partitionBy(y)))}


KEPT = {"p17_scalar_tolerance": lambda id, x, y, v: F.abs(x - y) <= 0.1 + 1e-5 * F.abs(y), "f23_equal_bins": lambda id, x, y, v: id <= 11}
SPARK = {
    "p01_column_projection": lambda id, x, y, v: {"v": v},
    "p17_scalar_tolerance": lambda id, x, y, v: {"x": x},
    "p18_inside_region": lambda id, x, y, v: {"inside": ~((x < 0) | (x >= 100)) & y.between(1, 50)},
    "p20_derived_spacing": lambda id, x, y, v: {"dz": six((5900 + x) / 2 / (y + 30))},
    "f03_bark_band": lambda id, x, y, v: {"band": F.floor(47 * acoustics.bark(80 * x) / acoustics.bark(F.lit(8000.0)) + 0.5)},
    "f11_rotate": lambda id, x, y, v: dict(zip(("xr", "yr"), map(six, geometry.rotate(x, y, 30)))),
    "f13_tolerance_key": lambda id, x, y, v: {"k": geometry.to_tolerance(0.37 * x, 0.25)},
    "f16_gausspulse": pulse,
    "f19_opening_angle": lambda id, x, y, v: {"angle": six(F.degrees(F.asin(1.2 * (5920 / 5e6 * 1e3) / (x + 20))))},
    "f20_surface_length": lambda id, x, y, v: {"n": F.floor(200 * F.sin(F.radians(x + y / 2)) * F.sin(F.radians(y / 2)) + 1e-9)},
    "f21_gaussian_variogram": lambda id, x, y, v: {"g": six(geometry.gaussian_variogram(x, 2, 20))},
    "f22_product_sum_variogram": product_sum,
    "f23_equal_bins": lambda id, x, y, v: {"edge": (id - 1) / 2},
    "f25_box": lambda id, x, y, v: {"e": geometry.clamp(x - 50, 10.0)},
    "f28_symmetric_log": lambda id, x, y, v: {"s": six(geometry.symmetric_log(x - 50, 5))},
    "f30_tile_weights": lambda id, x, y, v: {"trapezoid": F.least(F.lit(1.0), (x + 1) / 10, (100 - x) / 10), "gaussians": six(sum(F.exp(-F.pow(x / 10 - c, F.lit(2))) for c in (3, 7)))},
    "f31_step_by_parity": lambda id, x, y, v: {"step": F.floor((y + 70) / 2)},
    "f32_border_mask": lambda id, x, y, v: {"kept": (x < 90) & ((y < 10) | (x >= 10))},
    "f35_spreading": lambda id, x, y, v: {"db": six(acoustics.spreading((x - 50) / 10))},
    "f36_modulus": lambda id, x, y, v: {"m": six(F.pow(F.hypot(x, y), F.lit(2))), "re": six(2 * x * y), "im": six((x - y) * (x + y))},
    "f37_morlet": morlet,
    "f42_error_text": lambda id, x, y, v: {"suffix": F.format_string("err_0p%03d", x.cast("long"))},
    "k44_position_error": errors,
    "k43_blur_patch": blur,
    "k39_boundary_split": lambda id, x, y, v: {"side": F.when(x < 40, "above").when(x >= 60, "below")},
}

projection("p01_column_projection", "Named columns only.", v="v")
projection("p17_scalar_tolerance", "Samples whose x is y within absolute and relative tolerance.", "abs(x - y) <= 1e-1 + 1e-5 * abs(y)", x="x")
projection("p18_inside_region", "Whether each position lies in the region that the guard demands.", inside="x >= 0 AND x < 100 AND y >= 1 AND y <= 50")
projection("p20_derived_spacing", "Depth step by speed and sampling rate in MHz.", dz="round((5900 + x) / (2 * (y + 30)), 6)")
projection("f03_bark_band", "Number of the band among 47 equal Bark bands, halves up.", band="CAST(floor(asinh(x * 80 / 600) / (asinh(8000 / 600e0) / 47) + 5e-1) AS BIGINT)")
projection("f11_rotate", "Positions turned by 30 degrees.", xr="round(cos(radians(30e0)) * x - sin(radians(30e0)) * y, 6)", yr="round(sin(radians(30e0)) * x + cos(radians(30e0)) * y, 6)")
projection("f13_tolerance_key", "Whole number of tolerances of a lag.", k="CAST(floor(x * 37e-2 / 25e-2 + 5e-1) AS BIGINT)")
_ALPHA = "(-pow(pi() * 5 * 6e-1, 2) / (4 * ln(pow(10e0, -6 / 20e0))))"
projection(
    "f16_gausspulse",
    "In-phase part, quadrature and envelope of a Gaussian pulse by its bandwidth.",
    inphase=f"round(exp(-{_ALPHA} * pow((x - 50) / 100, 2)) * cos(2 * pi() * 5 * (x - 50) / 100), 6)",
    quadrature=f"round(exp(-{_ALPHA} * pow((x - 50) / 100, 2)) * sin(2 * pi() * 5 * (x - 50) / 100), 6)",
    envelope=f"round(exp(-{_ALPHA} * pow((x - 50) / 100, 2)), 6)",
)
projection("f19_opening_angle", "Opening angle in degrees of an element of diameter D.", angle="round(degrees(asin(12e-1 * 5920 / ((x + 20) * 1e-3 * 5e6))), 6)")
projection("f20_surface_length", "Whole samples of surface between two angles.", n="CAST(floor(5e-1 * 200 * (cos(radians(x)) - cos(radians(x + y))) + 1e-9) AS BIGINT)")
projection("f21_gaussian_variogram", "Sill times one less a Gaussian of the lag.", g="round(2 * (1 - exp(-x * x / 400)), 6)")
_VX, _VY, _VZ = "(1 - exp(-x * x / 400))", "(1 - exp(-y * y / 100))", "(1 - exp(-v / 1000))"
projection("f22_product_sum_variogram", "Constant, two parts and their products; the third part enters by the last product only.", g=f"round(1 + {_VX} + {_VY} - 5e-1 * {_VX} * {_VY} - 25e-2 * {_VX} * {_VY} * {_VZ}, 6)")
projection("f23_equal_bins", "Eleven edges of ten equal bins.", "id <= 11", edge="(id - 1) * 5e0 / 10")
projection("f25_box", "Values held within the limit, with their sign.", e="greatest(-10e0, least(10e0, x - 50))")
projection("f28_symmetric_log", "Linear inside the threshold, logarithmic outside.", s="round(CASE WHEN abs(x - 50) <= 5 THEN (x - 50) / 5 ELSE sign(x - 50) * (1 + log10(abs(x - 50) / 5)) END, 6)")
projection("f30_tile_weights", "Trapezoid and double Gaussian over the places of a tile.", trapezoid="least(1e0, least(x + 1, 100 - x) / 10)", gaussians="round(exp(-pow((x - 30) / 10, 2)) + exp(-pow((x - 70) / 10, 2)), 6)")
projection("f31_step_by_parity", "Half the sum of two sizes, the second made smaller by one where the sum is odd.", step="CAST((y + 70 - (y + 70) % 2) / 2 AS BIGINT)")
projection("f32_border_mask", "Whether a place is kept: tiles on the left border keep their first columns.", kept="CASE WHEN y < 10 THEN x < 90 ELSE x >= 10 AND x < 90 END")
projection("f35_spreading", "Masking in dB by distance in Bark.", db="round(CASE WHEN x < 50 THEN 27 * (x - 50) / 10 ELSE -12 * (x - 50) / 10 END - 235e-1, 6)")
projection("f36_modulus", "Squared modulus of one number, real and imaginary part of a conjugate product.", m="round(x * x + y * y, 6)", re="round(x * y + y * x, 6)", im="round(x * x - y * y, 6)")
_ATOM = "exp(-pow((x - 50) / 10, 2) / 2) * cos(6 * (x - 50) / 10)"
projection("f37_morlet", "A cosine under a Gaussian, less its mean over the samples of one size.", a=f"round({_ATOM} - avg({_ATOM}) OVER (PARTITION BY y), 6)")
projection("f42_error_text", "Fractions as a suffix of file names.", suffix="concat('err_0p', lpad(CAST(CAST(x AS BIGINT) AS STRING), 3, '0'))")
projection("k44_position_error", "Uniform and triangular errors within one unit, by the inverse distribution.", uniform=f"round(2 * {DRAW} - 1, 9)", triangular=f"round(CASE WHEN {DRAW} < 5e-1 THEN sqrt(2 * {DRAW}) - 1 ELSE 1 - sqrt(2 * (1 - {DRAW})) END, 9)")
_BLUR = "exp(-pow((x - 50) / 10, 2) / 2) / (10 * sqrt(2 * pi())) * exp(-pow((y - 25) / 5, 2) / 2) / (5 * sqrt(2 * pi()))"
projection("k43_blur_patch", "Product of two normal densities; small ones are zero.", b=f"round(CASE WHEN {_BLUR} <= 1e-4 THEN 0e0 ELSE {_BLUR} END, 9)")
projection("k39_boundary_split", "Which side of the boundary a sample lies on; samples of other columns have no side.", side="CASE WHEN x < 40 THEN 'above' WHEN x >= 60 THEN 'below' END")
