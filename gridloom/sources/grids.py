"""Grid models as long tables, from generators, literals and other tables.

A model is four tables: quilts (one row a model), cells (model_id, r, c, fabric_id, confidence), fabrics
(model_id, ord, fabric_id, name, color) and borders (model_id, ord, fabric_id, width), inner band first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import report
from gridloom.functions.lengths import int_div

#: The benchmark's two block patterns and its palette.
BLOCKS = ("bbcbbbbbbbcbbbcbbbbbbbcbb", "bcccbcccccccccccccccbcccb")
BENCHMARK = "benchmark"
CHAIN = [("b", "Chain blue", "#9db8d9"), ("c", "Background cream", "#f2e8d5")]
RED = [("r", "Red", "#c03030"), ("w", "White", "#ffffff")]
#: Small authored models: rows, cell size, bands, binding, palette.
AUTHORED = {
    "tiny": (("rw", "wr"), 16, (("w", 8),), "r", RED),
    "checker": (("rwwr", "wrrw", "wrrw", "rwwr"), 8, (), "r", RED),
    "mini": (("bcccccc", "ccccccc", "ccccccc", "ccccccc", "ccccccc"), 20, (("c", 2),), "b", CHAIN),
    "small": (("rwr", "wrw"), 8, (("w", 4),), "r", RED),
    "uniform": (("c" * 18,) * 24, 20, (("c", 20),), "b", CHAIN),
}
#: The palette of a blank grid.
PLAIN = [("bg", "Background", "#f5f1e8"), ("a1", "Accent", "#4a6fa5")]
#: Models that a task makes cells of.
TASK_MODELS = 250
QUILTS = "model_id string, name string, rows int, cols int, cell_size int, binding_fabric_id string, binding_width int, seam_allowance int, wof int, binding_extra int, backing_margin int"


@dataclass(frozen=True)
class Models:
    quilts: DataFrame
    cells: DataFrame
    fabrics: DataFrame
    borders: DataFrame

    def union(self, other: Models) -> Models:
        return Models(*(getattr(self, k).unionByName(getattr(other, k)) for k in ("quilts", "cells", "fabrics", "borders")))


def grid_cells(spine: DataFrame, cell: Column, cols: Column | int, fabric: Column, model: Column, confidence: Column | None = None) -> DataFrame:
    """Cells of a spine of running numbers: `cell` is the place in reading order."""
    width = F.lit(cols) if isinstance(cols, int) else cols
    return spine.select(
        model.alias("model_id"), int_div(cell, width).cast("int").alias("r"), (cell % width).cast("int").alias("c"),
        fabric.alias("fabric_id"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
    )


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of literals, evaluated by Spark without a Python worker."""
    names = [f.split() for f in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in names])
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _tables(spark: SparkSession, models: list[tuple]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """quilts, fabrics and borders of (model, name, rows, cols, cell size, bands, binding, palette) rows."""
    quilts = literal(spark, QUILTS, [(m, name, rows, cols, size, binding, 20, 2, 336, 80, 64) for m, name, rows, cols, size, _, binding, _ in models])
    fabrics = literal(spark, "model_id string, ord int, fabric_id string, name string, color string", [(x[0], i, *f) for x in models for i, f in enumerate(x[7])])
    borders = literal(spark, "model_id string, ord int, fabric_id string, width int", [(x[0], i, *b) for x in models for i, b in enumerate(x[5])])
    return quilts, fabrics, borders


def benchmark(spark: SparkSession, across: int = 9, down: int = 11, cell_size: int = 12, band: int = 30) -> Models:
    """Two 5x5 blocks in checkerboard order, the first on all four corners."""
    if across % 2 == 0 or down % 2 == 0:
        raise ValueError(f"{across} x {down} blocks: an even count puts the second block on a corner")
    rows, cols = down * 5, across * 5
    r, c = int_div(F.col("id"), cols), F.col("id") % cols
    which = F.when((int_div(r, 5) + int_div(c, 5)) % 2 == 0, F.lit(BLOCKS[0])).otherwise(F.lit(BLOCKS[1]))
    fabric = F.substring(which, ((r % 5) * 5 + c % 5 + 1).cast("int"), F.lit(1))
    cells = grid_cells(spark.range(rows * cols), F.col("id"), cols, fabric, F.lit(BENCHMARK))
    quilts, fabrics, borders = _tables(spark, [(BENCHMARK, "Double Irish Chain 75x90", rows, cols, cell_size, [("c", band)], "b", CHAIN)])
    return Models(quilts, cells, fabrics, borders)


def blank(spark: SparkSession, rows: int = 24, cols: int = 18, cell_size: int = 20, fabric: str = "bg") -> Models:
    cells = grid_cells(spark.range(rows * cols), F.col("id"), cols, F.lit(fabric), F.lit("blank"))
    quilts, fabrics, borders = _tables(spark, [("blank", "Untitled quilt", rows, cols, cell_size, [(fabric, 20)], "a1", [(fabric, *PLAIN[0][1:]), PLAIN[1]])])
    return Models(quilts, cells, fabrics, borders)


def blanks(trust: DataFrame, fabrics: DataFrame, rows: int = 24, cols: int = 18, cell_size: int = 20) -> Models:
    """A blank grid for each of (model_id, confidence): of the first fabric of its recovered palette (model_id, ord,
    fabric_id, name, color) where that is trusted, else of a plain background with an accent."""
    ranked = fabrics.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("ord", "fabric_id", "name", "color"))).alias("found"))
    plain = F.array(*[F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(c) for c, v in zip(("fabric_id", "name", "color"), row, strict=True)]) for i, row in enumerate(PLAIN)])
    size = F.size("found")
    chosen = trust.join(ranked, "model_id", "left").withColumn("trusted", F.coalesce(report.trusted_palette(F.col("confidence"), size), F.lit(False)))
    chosen = chosen.select("model_id", F.when(F.col("trusted"), F.col("found")).otherwise(plain).alias("palette"))
    first, last = F.get("palette", F.lit(0))["fabric_id"], F.element_at("palette", -1)["fabric_id"]
    fixed = [F.lit(v).alias(c) for c, v in (("rows", rows), ("cols", cols), ("cell_size", cell_size))]
    rest = [F.lit(v).alias(c) for c, v in (("binding_width", 20), ("seam_allowance", 2), ("wof", 336), ("binding_extra", 80), ("backing_margin", 64))]
    quilts = chosen.select("model_id", F.lit("Untitled quilt").alias("name"), *fixed, last.alias("binding_fabric_id"), *rest)
    spine = chosen.select("model_id", first.alias("fabric_id"), F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("id"))
    cells = grid_cells(spine, F.col("id"), cols, F.col("fabric_id"), F.col("model_id"))
    return Models(quilts, cells, chosen.select("model_id", F.inline("palette")), chosen.select("model_id", F.lit(0).alias("ord"), first.alias("fabric_id"), F.lit(20).alias("width")))


def authored(spark: SparkSession, names: tuple[str, ...] = tuple(AUTHORED)) -> Models:
    """The small models, their cells cut from strings by Spark."""
    specs = [(m, m, len(rows), len(rows[0]), size, bands, binding, palette) for m in names for rows, size, bands, binding, palette in [AUTHORED[m]]]
    text = literal(spark, "model_id string, cols int, content string", [(m, len(AUTHORED[m][0][0]), "".join(AUTHORED[m][0])) for m in names])
    spine = text.select("*", F.explode(F.sequence(F.lit(0), F.length("content") - 1)).alias("id"))
    cells = grid_cells(spine, F.col("id"), F.col("cols"), F.substring("content", F.col("id") + 1, F.lit(1)), F.col("model_id"))
    quilts, fabrics, borders = _tables(spark, specs)
    return Models(quilts, cells, fabrics, borders)


def everything(spark: SparkSession) -> Models:
    return benchmark(spark).union(authored(spark))


def from_events(events: DataFrame, rows: int = 25, cols: int = 20) -> DataFrame:
    """Cells from a table of running ids: each rows*cols events make a grid of their types. An adapter, so
    that grid operators run on tables of any size."""
    size = rows * cols
    place = F.col("event_id") % size
    confidence = ((F.col("event_id") * 37) % 100) / F.lit(100.0)
    return grid_cells(events, place, cols, F.col("event_type"), int_div(F.col("event_id"), size).cast("string"), confidence)


def from_suppliers(suppliers: DataFrame) -> Models:
    """Models from a table of suppliers: each key makes a quilt of its own size, blocks, palette and bands, so that
    their number follows the table. Two block types alternate; where the key is a multiple of seven a row more
    than whole blocks breaks the structure."""
    key, nation = F.col("s_suppkey"), F.coalesce(F.col("s_nationkey"), F.lit(0)).cast("long")
    seeds = suppliers.where("s_suppkey is not null").select(
        F.concat(F.lit("s"), key.cast("string")).alias("model_id"), key.alias("k"), nation.alias("n"), (key % 4 + 2).alias("p"),
        (key % 3 + 2).alias("across"), (int_div(key, 3) % 4 + 2).alias("down"), (int_div(key, 2) % 4 + 2).alias("nf"),
    )
    # a small file is one task's, and its rows become thousands: they are dealt by model, before they are exploded, to as
    # many tasks as shuffles have, or more, so that a task has about TASK_MODELS however many there are; what then joins on
    # the model alone, or groups by it, needs no shuffle of its own
    tasks = max(int(suppliers.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(suppliers.count() / TASK_MODELS))
    seeds = seeds.repartition(tasks, "model_id")
    k, n, p, nf = (F.col(c) for c in ("k", "n", "p", "nf"))

    def fabric(i: Column) -> Column:
        return F.concat(F.lit("f"), (i % nf).cast("string"))

    sized = seeds.withColumn("rows", p * F.col("down") + (k % 7 == 0).cast("int")).withColumn("cols", p * F.col("across"))
    quilts = sized.select(
        "model_id", F.concat(F.lit("Quilt "), k.cast("string")).alias("name"), F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"), (n % 9 * 2 + 8).cast("int").alias("cell_size"),
        fabric(n).alias("binding_fabric_id"), *[F.lit(v).alias(c) for c, v in (("binding_width", 20), ("seam_allowance", 2), ("wof", 336), ("binding_extra", 80), ("backing_margin", 64))],
    )
    i = F.col("i")
    listed = seeds.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), nf - 1)))
    color = F.format_string("#%02x%02x%02x", i * 50 + 40 + k % 13, i * 45 + 50 + n, 220 - i * 50 + k % 29)
    fabrics = listed.select("model_id", i.cast("int").alias("ord"), fabric(i).alias("fabric_id"), F.concat(F.lit("Fabric "), (i + 1).cast("string")).alias("name"), color.alias("color"))
    banded = seeds.where(k % 3 > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), k % 3 - 1)))
    borders = banded.select("model_id", i.cast("int").alias("ord"), fabric(i).alias("fabric_id"), ((k + i * 5) % 12 * 2 + 8).cast("int").alias("width"))
    spine = sized.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("cols") - 1)))
    spine = spine.withColumn("y", int_div(F.col("id"), F.col("cols"))).withColumn("x", F.col("id") % F.col("cols"))
    r, c, y, x = F.col("y") % p, F.col("x") % p, F.col("y"), F.col("x")
    block = (int_div(y, p) + int_div(x, p)) % 2
    which = r * (k % 3 + 1) + c * 2 + block * (n % 2 + 1) + r * c % 3
    cells = grid_cells(spine, F.col("id"), F.col("cols"), fabric(which), F.col("model_id"), ((k * 31 + y * 17 + x * 7) % 100) / F.lit(100.0))
    # Spark takes an exploded table for as small as the file it comes from, and would broadcast it through the driver
    return Models(*(t.hint("merge") for t in (quilts, cells, fabrics, borders)))
