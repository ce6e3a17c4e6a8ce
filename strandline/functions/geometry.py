"""Column expressions of scanning: polar positions, pulses, travel times, variograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def rotate(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return c * x - s * y, s * x + c * y


def travel_time(dx: Column, dz: Column, speed: float, opening: float) -> Column:
    """Samples of two-way travel; null outside the opening angle in degrees."""
    return F.when(F.abs(dx) <= F.tan(F.radians(F.lit(opening))) * dz, 2 * F.hypot(dx, dz) / speed)


def apodization(dx: Column, dz: Column, opening: float) -> Column:
    return F.exp(-F.pow(dx, F.lit(2)) / F.pow(F.tan(F.radians(F.lit(opening))) * dz, F.lit(2)))


def gabor(t: Column, tau: Column, frequency: float, bandwidth: float, phase: float = 0.0) -> Column:
    """A cosine under a Gaussian around tau."""
    return F.exp(-bandwidth * F.pow(t - tau, F.lit(2))) * F.cos(2 * math.pi * frequency * (t - tau) + phase)


def gaussian_variogram(h: Column, sill: float, reach: float) -> Column:
    return sill * (1 - F.exp(-h * h / reach**2))


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    return F.exp(-F.pow((x - mean) / deviation, F.lit(2)) / 2) / (deviation * math.sqrt(2 * math.pi))


def soft_threshold(x: Column, by: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def clamp(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def symmetric_log(x: Column, linear: float) -> Column:
    return F.when(F.abs(x) <= linear, x / linear).otherwise(F.signum(x) * (1 + F.log10(F.abs(x) / linear)))


def to_tolerance(x: Column, tolerance: float) -> Column:
    """The whole number of tolerances, halves to even: a key for equal joins on lags."""
    return F.rint(x / tolerance).cast("long")
