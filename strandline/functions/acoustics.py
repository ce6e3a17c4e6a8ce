"""Column expressions of audio coding: levels, Bark bands, companding, quantisers, masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def decibel(v: Column, floor: float = -27.5) -> Column:
    """20 log10 of the magnitude, lifted by a floor so that zero stays finite."""
    return 20 * F.log10(F.abs(v + 10 ** (2 * (floor - 1) / 20)))


def bark(f: Column) -> Column:
    return 6 * F.asinh(f / 600)


def hertz(b: Column) -> Column:
    return 600 * F.sinh(b / 6)


def compress(x: Column, mu: float = 255.0) -> Column:
    return F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(mu))


def expand(y: Column, mu: float = 255.0) -> Column:
    return F.signum(y) * (F.pow(F.lit(mu + 1), F.abs(y)) - 1) / mu


def quantise(x: Column, step: float, bits: int = 8) -> Column:
    """Nearest step, halves to even, held within the signed range instead of wrapping around."""
    top = 2 ** (bits - 1)
    return F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.rint(x / step).cast("int")))


def log_step(m: Column) -> Column:
    return F.greatest(F.rint(4 * F.log2(m)), F.lit(0.0))


def quiet_threshold(f: Column) -> Column:
    """Absolute threshold of hearing in dB by frequency in Hz, held within -20 and 160."""
    k = f / 1000
    return F.greatest(F.lit(-20.0), F.least(F.lit(160.0), 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, F.lit(2))) + 0.001 * F.pow(k, F.lit(4))))


def spreading(distance: Column) -> Column:
    """dB of masking by the distance in Bark: a steep ramp below the masker, a flat one above, less 23.5."""
    return F.when(distance < 0, 27 * distance).otherwise(-12 * distance) - 23.5
