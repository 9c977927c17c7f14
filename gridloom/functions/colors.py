"""Colors written as #rrggbb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(color: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(color, i, 2), 16, 10).cast("int") for i in (2, 4, 6))


def lab(color: Column) -> tuple[Column, Column, Column]:
    return lab_of(*rgb(color))


def lab_of(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) in 8 bits: lightness over 255, a and b shifted by 128."""
    def linear(x: Column) -> Column:
        s = x / F.lit(255.0)
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = (linear(x) for x in (red, green, blue))
    # fixed values: the sRGB matrix, rows divided by the white point
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return tuple(F.floor(v + 0.5).cast("int") for v in (light * 255 / 100, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128))
