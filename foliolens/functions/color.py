"""Colour arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_channel(hex_value: Column, index: int) -> Column:
    return F.conv(F.substring(hex_value, 2 + 2 * index, 2), 16, 10).cast("int")


def valid_hex(hex_value: Column) -> Column:
    return F.coalesce(hex_value.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))


def hex_to_rgb(hex_value: Column) -> Column:
    return F.when(valid_hex(hex_value), F.struct(*[hex_channel(hex_value, i).alias(n) for i, n in enumerate("rgb")]))


def rgb_to_hex(r, g, b) -> Column:
    parts = [F.lpad(F.hex(_col(c).cast("long")), 2, "0") for c in (r, g, b)]
    good = F.lit(True)
    for c in (r, g, b):
        good = good & _col(c).between(0, 255)
    return F.when(good, F.concat(F.lit("#"), *parts))


def _linear(channel: Column) -> Column:
    v = channel / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r, g, b) -> Column:
    return 0.2126 * _linear(_col(r)) + 0.7152 * _linear(_col(g)) + 0.0722 * _linear(_col(b))


def ratio_of(first: Column, second: Column) -> Column:
    return (F.greatest(first, second) + 0.05) / (F.least(first, second) + 0.05)


def contrast(a: tuple, b: tuple) -> Column:
    return ratio_of(luminance(*a), luminance(*b))


def mode_of(lum: Column) -> Column:
    return F.when(lum <= 0.10, "near-black").when(lum >= 0.90, "near-white").otherwise("other")


def luma8(r, g, b) -> Column:
    """8-bit luma with the usual 16-bit fixed-point weights."""
    return F.shiftright(_col(r) * 19595 + _col(g) * 38470 + _col(b) * 7471 + 32768, 16)


def channel_distance(a: tuple, b: tuple) -> Column:
    return F.greatest(*[F.abs(_col(x) - _col(y)) for x, y in zip(a, b)])
