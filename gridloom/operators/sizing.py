"""Finished sizes: presets, locked and unlocked resizing. All lengths are eighths of an inch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.lengths import clamp, half_up_div, quarter_inch
from gridloom.sources.grids import literal

#: Preset names and sizes, and the limits of cells and bands.
PRESETS = (("Crib", 288, 416), ("Throw", 400, 520), ("Twin", 560, 720), ("Full", 672, 720), ("Queen", 720, 864), ("King", 880, 864))
CELL_LIMITS, BAND_LIMITS = (6, 32), (2, 112)
ASPECT_TOLERANCE, SIDE_TOLERANCE = 0.04, 0.56


def presets(spark: SparkSession) -> DataFrame:
    return literal(spark, "ord int, name string, width int, height int", [(i, *p) for i, p in enumerate(PRESETS)])


def by_aspect(sizes: DataFrame) -> DataFrame:
    """Adds `preset` to rows with an `aspect`: the only preset whose long side over short side is within 0.04 of
    it either way round; null if none or several are."""
    long = F.when(F.col("aspect") >= 1, F.col("aspect")).otherwise(F.try_divide(F.lit(1.0), F.col("aspect")))

    def near(name: str, w: int, h: int) -> Column:
        return F.when((F.col("aspect") > 0) & (F.abs(long - F.lit(max(w, h) / min(w, h))) <= ASPECT_TOLERANCE), F.lit(name))

    found = F.array_compact(F.array(*[near(*p) for p in PRESETS]))  # six literals, so no join
    return sizes.withColumn("preset", F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def by_size(sizes: DataFrame) -> DataFrame:
    """Adds `preset` to rows with width and height: the first within 0.56 eighths on both sides."""
    hits = [F.when((F.abs(F.col("width") - w) <= SIDE_TOLERANCE) & (F.abs(F.col("height") - h) <= SIDE_TOLERANCE), F.lit(n)) for n, w, h in PRESETS]
    return sizes.withColumn("preset", F.coalesce(*hits))


def _inner(target: Column, band: Column) -> Column:
    return F.greatest(target - 2 * band, F.lit(0))


def _achieved(cell: Column, cols: Column, rows: Column, band: Column) -> list[Column]:
    return [cell.alias("new_cell"), (cols * cell + 2 * band).alias("achieved_width"), (rows * cell + 2 * band).alias("achieved_height")]


def locked(rows: DataFrame) -> DataFrame:
    """Counts stay, the cell follows the target; width wins over height, height over cell. Expects rows, cols,
    cell_size, band and nullable target_width, target_height, target_cell. Bands stay."""
    def fitted(target: str, n: str) -> Column:
        return F.greatest(F.lit(1), half_up_div(_inner(F.col(target), F.col("band")), F.col(n)))

    cell = (
        F.when(F.col("target_width").isNotNull(), fitted("target_width", "cols")).when(F.col("target_height").isNotNull(), fitted("target_height", "rows"))
        .when(F.col("target_cell").isNotNull(), F.greatest(F.lit(1), F.col("target_cell"))).otherwise(F.col("cell_size")).cast("int")
    )
    return rows.select("*", *_achieved(cell, F.col("cols"), F.col("rows"), F.col("band")))


def unlocked(rows: DataFrame) -> DataFrame:
    """The cell stays, each axis gets whole blocks, one at least. Expects rows, cols, cell_size, band, block and
    nullable target_width, target_height."""
    def fitted(target: str, n: str) -> Column:
        blocks = F.greatest(F.lit(1), half_up_div(_inner(F.col(target), F.col("band")), F.col("block") * F.col("cell_size")))
        return F.when(F.col(target).isNotNull(), blocks * F.col("block")).otherwise(F.col(n)).cast("int")

    cols, high = fitted("target_width", "cols"), fitted("target_height", "rows")
    return rows.select("*", high.alias("new_rows"), cols.alias("new_cols"), (cols * F.col("cell_size") + 2 * F.col("band")).alias("achieved_width"), (high * F.col("cell_size") + 2 * F.col("band")).alias("achieved_height"))


def rescaled(rows: DataFrame) -> DataFrame:
    """Locked resizing with bands that follow: targets are rounded to quarter inches and kept within 20 to 140
    inches; with both the smaller cell counts; the cell is solved with the old bands, kept within its limits,
    and each band (array `bands`) then scaled and kept within its own."""
    def fitted(target: str, n: str) -> Column:
        return F.greatest(F.lit(1), half_up_div(_inner(quarter_inch(F.col(target)), F.col("band")), F.col(n)))

    best = F.least(F.when(F.col("target_width").isNotNull(), fitted("target_width", "cols")), F.when(F.col("target_height").isNotNull(), fitted("target_height", "rows")))
    cell = clamp(F.coalesce(best, F.col("target_cell")), *CELL_LIMITS).cast("int")
    bands = F.transform("bands", lambda b: clamp(half_up_div(b * cell, F.col("cell_size")), *BAND_LIMITS).cast("int"))
    band = F.aggregate(bands, F.lit(0), lambda a, b: a + b)
    return rows.select("*", bands.alias("new_bands"), *_achieved(cell, F.col("cols"), F.col("rows"), band))


def finished(rows: DataFrame) -> DataFrame:
    """The cell whose quilt, bands scaled with it, comes nearest the requested sides; the smaller of both. The
    cell is kept within its limits and bands have a floor only."""
    def candidate(target: str, n: str) -> Column:
        t, n = F.col(target), F.col(n)
        scaled = half_up_div(t * F.col("cell_size"), n * F.col("cell_size") + 2 * F.col("band"))
        return F.when(t.isNotNull(), F.when(F.col("band") > 0, scaled).otherwise(half_up_div(t, n)))

    cell = clamp(F.least(candidate("target_width", "cols"), candidate("target_height", "rows")), *CELL_LIMITS).cast("int")
    bands = F.transform("bands", lambda b: F.greatest(F.lit(BAND_LIMITS[0]), half_up_div(b * cell, F.col("cell_size"))).cast("int"))
    band = F.aggregate(bands, F.lit(0), lambda a, b: a + b)
    return rows.select("*", bands.alias("new_bands"), *_achieved(cell, F.col("cols"), F.col("rows"), band))


def finished_columns(quilts: DataFrame, borders: DataFrame) -> DataFrame:
    """model_id, band, finished_width, finished_height, perimeter, binding_length, batting_width, batting_height."""
    bands = borders.groupBy("model_id").agg(F.sum("width").alias("band"))
    q = quilts.join(bands, "model_id", "left").withColumn("band", F.coalesce("band", F.lit(0)))
    w, h = (F.col(n) * F.col("cell_size") + 2 * F.col("band") for n in ("cols", "rows"))
    q = q.withColumn("finished_width", w).withColumn("finished_height", h).withColumn("perimeter", 2 * (F.col("finished_width") + F.col("finished_height")))
    return q.select(
        "model_id", "band", "finished_width", "finished_height", "perimeter", (F.col("perimeter") + F.col("binding_extra")).alias("binding_length"),
        (F.col("finished_width") + F.col("backing_margin")).alias("batting_width"), (F.col("finished_height") + F.col("backing_margin")).alias("batting_height"),
    ).hint("merge")


def running_bands(borders: DataFrame) -> DataFrame:
    """Adds `inner`, the sum of the widths of the bands inside each band."""
    inside = W.partitionBy("model_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return borders.withColumn("inner", F.coalesce(F.sum("width").over(inside), F.lit(0)))
