"""Bytes of measured files as column expressions, so that writing them needs no Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _hex(number: Column, size: int) -> Column:
    """A whole number, two's complement below zero, as hexadecimal digits of ``size`` bytes, the lowest first."""
    byte = lambda k: F.lpad(F.hex(F.pmod(F.floor(number / 256**k).cast("long"), F.lit(256))), 2, "0")
    return F.concat(*[byte(k) for k in range(size)])


def int16_bytes(samples: Column) -> Column:
    """An array of whole numbers as little-endian 16-bit samples."""
    return F.unhex(F.array_join(F.transform(samples, lambda v: _hex(v, 2)), ""))


def wave_bytes(samples: Column, channels: int, rate: int) -> Column:
    """Samples, channel by channel within each instant, as a 16-bit sound file."""
    size = F.size(samples) * 2
    text = lambda t: F.encode(F.lit(t), "UTF-8")
    number = lambda n, b: F.unhex(_hex(n if isinstance(n, Column) else F.lit(n), b))
    form = [number(16, 4), number(1, 2), number(channels, 2), number(rate, 4), number(rate * channels * 2, 4), number(channels * 2, 2), number(16, 2)]
    return F.concat(text("RIFF"), number(size + 36, 4), text("WAVEfmt "), *form, text("data"), number(size, 4), int16_bytes(samples))
