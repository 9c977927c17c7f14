"""Edits of models: cells, palettes, borders and seams. Each takes tables of edits and gives tables back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.lengths import QUARTER_YARD, ceil_div
from gridloom.operators import seams, sizing, structure
from gridloom.sources.grids import Models

CELL, EDGE = ["model_id", "r", "c"], ["model_id", "r", "c", "dir"]
#: Color of a new fabric, width of a new border, the viewer's seam allowance twice.
NEW_COLOR, NEW_BORDER, VIEWER_ADD = "#b8a06a", 16, 4


def painted(cells: DataFrame, strokes: DataFrame) -> DataFrame:
    """cells after strokes (model_id, ord, r, c, fabric_id): the last stroke of a cell counts and makes it certain;
    those outside the grid do nothing."""
    last = strokes.groupBy(*CELL).agg(F.max(F.struct("ord", "fabric_id"))["fabric_id"].alias("paint"))
    both = cells.join(last, CELL, "left")
    return both.select(*CELL, F.coalesce("paint", "fabric_id").alias("fabric_id"), F.when(F.col("paint").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))


def redone(fabrics: DataFrame, changes: DataFrame) -> DataFrame:
    """fabrics with new names and colors from (model_id, fabric_id, new_name, new_color), null for no change."""
    both = fabrics.join(changes, ["model_id", "fabric_id"], "left")
    return both.select("model_id", "ord", "fabric_id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_color", "color").alias("color"))


def with_fabric(fabrics: DataFrame) -> DataFrame:
    """Each palette with one more fabric: f1, f2 and so on, the first that is free."""
    size = fabrics.groupBy("model_id").agg(F.collect_set("fabric_id").alias("known"), (F.max("ord") + 1).cast("int").alias("ord"), F.count("*").alias("n"))
    ids = F.transform(F.sequence(F.lit(1), F.size("known") + 1), lambda i: F.concat(F.lit("f"), i.cast("string")))
    new = F.get(F.array_except(ids, "known"), F.lit(0))
    more = size.select("model_id", "ord", new.alias("fabric_id"), F.concat(F.lit("Fabric "), (F.col("n") + 1).cast("string")).alias("name"), F.lit(NEW_COLOR).alias("color"))
    return fabrics.select(*more.columns).unionByName(more)


def uses(models: Models) -> DataFrame:
    """(model_id, fabric_id): what cells, borders or the binding refer to."""
    bound = models.quilts.select("model_id", F.col("binding_fabric_id").alias("fabric_id"))
    return models.cells.select("model_id", "fabric_id").distinct().unionByName(models.borders.select("model_id", "fabric_id")).unionByName(bound).distinct()


def removable(models: Models) -> DataFrame:
    """(model_id, fabric_id, removable): a fabric may go if nothing refers to it."""
    used = uses(models).withColumn("used", F.lit(True))
    return models.fabrics.select("model_id", "fabric_id").join(used, ["model_id", "fabric_id"], "left").select("model_id", "fabric_id", F.col("used").isNull().alias("removable"))


def _numbered(borders: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("model_id").orderBy("ord")) - 1
    return borders.select("model_id", place.cast("int").alias("ord"), "fabric_id", "width")


def with_border(models: Models) -> DataFrame:
    """borders with a new innermost one of the palette's first fabric."""
    first = models.fabrics.groupBy("model_id").agg(F.min(F.struct("ord", "fabric_id"))["fabric_id"].alias("fabric_id"))
    inner = first.select("model_id", F.lit(-1).alias("ord"), "fabric_id", F.lit(NEW_BORDER).alias("width"))
    return _numbered(models.borders.unionByName(inner))


def without_border(borders: DataFrame, gone: DataFrame) -> DataFrame:
    """borders without those of gone (model_id, ord), one a model; the only border of a model stays."""
    n = borders.groupBy("model_id").agg(F.count("*").alias("n"))
    some = gone.join(n.where("n > 1"), "model_id", "left_semi")
    return _numbered(borders.join(some, ["model_id", "ord"], "left_anti"))


def changed_border(models: Models, changes: DataFrame) -> DataFrame:
    """borders with new widths and fabrics from (model_id, ord, new_width, new_fabric), null for no change; a
    change to no width above 0 or to an unknown fabric is left out as a whole."""
    known = models.fabrics.select("model_id", F.col("fabric_id").alias("new_fabric"), F.lit(True).alias("known"))
    fit = changes.join(known, ["model_id", "new_fabric"], "left").where("(new_fabric is null or known) and (new_width is null or new_width > 0)").drop("known")
    both = models.borders.join(fit, ["model_id", "ord"], "left")
    return both.select("model_id", "ord", F.coalesce("new_fabric", "fabric_id").alias("fabric_id"), F.coalesce("new_width", "width").cast("int").alias("width"))


def dragged(fixes: DataFrame, merged: DataFrame, edges: DataFrame) -> DataFrame:
    """fixes after a drag over edges (model_id, r, c, dir): those that aren't merged become merges."""
    new = edges.select(*EDGE).distinct().join(merged, EDGE, "left_anti").withColumn("action", F.lit("merge"))
    return fixes.join(new, EDGE, "left_anti").select(*EDGE, "action").unionByName(new)


def tapped(cells: DataFrame, fixes: DataFrame, merged: DataFrame, taps: DataFrame) -> DataFrame:
    """fixes after taps on cells (model_id, r, c): every merged edge inside the tapped pieces becomes a split."""
    pieces = seams.pieces(cells, merged)
    hit = pieces.join(taps.select(*CELL), CELL, "left_semi").select("model_id", "piece").distinct()
    inside = merged.join(pieces, CELL).join(hit, ["model_id", "piece"], "left_semi").select(*EDGE).withColumn("action", F.lit("split"))
    return fixes.join(inside, EDGE, "left_anti").select(*EDGE, "action").unionByName(inside)


def resized(models: Models, targets: DataFrame) -> DataFrame:
    """Cells of models brought to targets (model_id, target_width, target_height), either null: cell size and
    borders stay, each side gets whole blocks, or single squares where there is no structure of several
    block types; what fits stays and the rest continues the least periods."""
    types = structure.types_of(structure.block_layout(models.cells)).groupBy("model_id").agg(F.max("size").alias("size"), F.count("*").alias("types"))
    bands = models.borders.groupBy("model_id").agg(F.sum("width").cast("int").alias("band"))
    q = models.quilts.select("model_id", "rows", "cols", "cell_size").join(bands, "model_id", "left").join(types, "model_id", "left").join(targets, "model_id")
    q = q.withColumn("band", F.coalesce("band", F.lit(0))).withColumn("block", F.when(F.col("types") > 1, F.col("size")).otherwise(1).cast("int"))
    return structure.regridded(models.cells, sizing.unlocked(q).select("model_id", "new_rows", "new_cols"))


def viewer_yardage(models: Models) -> DataFrame:
    """(model_id, fabric_id, cells, quarter_yards) as the viewer reckons: cells only, at its own allowance."""
    n = models.cells.groupBy("model_id", "fabric_id").agg(F.count("*").alias("n"))
    q = models.quilts.select("model_id", "cell_size", "wof")
    each = models.fabrics.select("model_id", "fabric_id").join(q, "model_id").join(n, ["model_id", "fabric_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    side = F.col("cell_size") + VIEWER_ADD
    return each.select("model_id", "fabric_id", F.col("n").alias("cells"), ceil_div(ceil_div(F.col("n") * side * side, F.col("wof")), QUARTER_YARD).alias("quarter_yards"))


def tiled(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of grids brought to (model_id, new_rows, new_cols) by their block layout, or by the whole grid where
    there is none; every cell of the target is one of the source at a remainder, so it is one lookup."""
    # the layout repeats as a whole, and with it the grid: block (br % down, bc % across) at the same place inside
    size = structure.dims(cells)
    spine = targets.join(size, "model_id").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("new_rows") - 1)))
    spine = spine.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("new_cols") - 1)))
    source = spine.select("model_id", "r", "c", (F.col("r") % F.col("rows")).alias("sr"), (F.col("c") % F.col("cols")).alias("sc"))
    return source.join(cells.select("model_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "fabric_id"), ["model_id", "sr", "sc"]).select("model_id", "r", "c", "fabric_id")


def rectangles(models: Models, scale: int = 10) -> DataFrame:
    """(model_id, layer, x0, y0, x1, y1, color): the filled rectangles of a flat picture at `scale` pixels an inch,
    inclusive corners, without the margin: borders from outside in (layer from 0 on), then the cells (layer -1)."""
    def px(x):
        return F.floor(x * scale / F.lit(8.0) + 0.5).cast("long")

    sized = sizing.finished_columns(models.quilts, models.borders).select("model_id", "band", "finished_width", "finished_height")
    outer = F.coalesce(F.sum("width").over(W.partitionBy("model_id").orderBy(F.col("ord").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    layer = F.row_number().over(W.partitionBy("model_id").orderBy(F.col("ord").desc())) - 1
    colors = models.fabrics.select("model_id", "fabric_id", "color")
    b = models.borders.withColumn("inset", outer).withColumn("layer", layer).join(sized, "model_id").join(colors, ["model_id", "fabric_id"])
    i = F.col("inset")
    bands = b.select("model_id", F.col("layer").cast("int").alias("layer"), px(i).alias("x0"), px(i).alias("y0"), (px(F.col("finished_width") - i) - 1).alias("x1"), (px(F.col("finished_height") - i) - 1).alias("y1"), "color")
    q = models.quilts.select("model_id", "cell_size").join(sized, "model_id")
    c = models.cells.join(q, "model_id").join(colors, ["model_id", "fabric_id"])
    x, y = (F.col("band") + F.col(k) * F.col("cell_size") for k in ("c", "r"))
    size = F.col("cell_size")
    return bands.unionByName(c.select("model_id", F.lit(-1).alias("layer"), px(x).alias("x0"), px(y).alias("y0"), (px(x + size) - 1).alias("x1"), (px(y + size) - 1).alias("y1"), "color"))

