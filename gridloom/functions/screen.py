"""Pixels, places on a grid and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel(eighths: Column, scale: int) -> Column:
    """`scale` pixels an inch, halves up."""
    return F.floor(eighths * scale / F.lit(8.0) + 0.5).cast("long")


def cell_at(x: Column, cell: int, count: int | None = None) -> Column:
    """The cell that a coordinate falls in; with a count, the nearest existing one."""
    at = F.floor(x / F.lit(float(cell))).cast("long")
    return at if count is None else F.greatest(F.lit(0), F.least(F.lit(count - 1), at))


def downscaled(wide: Column, high: Column, most: int) -> tuple[Column, Column]:
    """Sides of an image whose longer one may have `most` pixels."""
    long = F.greatest(wide, high)

    def side(x: Column) -> Column:
        return F.when(long <= most, x).otherwise(F.floor(x * F.lit(float(most)) / long + 0.5)).cast("long")

    return side(wide), side(high)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
