"""Grid analytics: validation, census, borders, voting, comparison, nearest labels and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import colors
from gridloom.functions.lengths import QUARTER_YARD, ceil_div, int_div
from gridloom.operators import pixels, sizing
from gridloom.operators.structure import dims
from gridloom.sources.grids import Models

#: The thresholds of the verdict and of the scans.
T1, T2, T3, T4, T5 = 0.60, 0.45, 1.05, 1.50, 0.70
UNIFORM, TRIM = 0.93, 0.15
SURE, COPIES = 0.8, 3
STAGES = ("rectify", "palette", "grid", "cells", "repeat", "border")


def census(models: Models) -> DataFrame:
    """(model_id, ord, fabric_id, name, cells) with 0 for fabrics that no cell has."""
    n = models.cells.groupBy("model_id", "fabric_id").agg(F.count("*").alias("n"))
    joined = models.fabrics.join(n, ["model_id", "fabric_id"], "left")
    return joined.select("model_id", "ord", "fabric_id", "name", F.coalesce("n", F.lit(0)).alias("cells"))


def violations(models: Models) -> DataFrame:
    """(model_id, rule, n): how often each rule is broken; rules that hold have no row."""
    q, cells, fabrics, borders = models.quilts, models.cells, models.fabrics, models.borders
    known = fabrics.select("model_id", "fabric_id")

    def counted(rows: DataFrame, rule: str) -> DataFrame:
        return rows.groupBy("model_id").agg(F.count("*").alias("n")).select("model_id", F.lit(rule).alias("rule"), "n")

    used = cells.select("model_id", "fabric_id").distinct().unionByName(borders.select("model_id", "fabric_id")).unionByName(q.select("model_id", F.col("binding_fabric_id").alias("fabric_id"))).distinct()
    have = cells.groupBy("model_id").agg(F.count("*").alias("have"))
    parts = [
        counted(q.join(have, "model_id", "left").where(F.coalesce("have", F.lit(0)) != F.col("rows") * F.col("cols")), "dimensions"),
        counted(cells.where(~F.col("confidence").between(0, 1)), "confidence"),
        counted(q.where((F.col("cell_size") <= 0) | (F.col("wof") <= 0)), "positive size"),
        counted(borders.where("width <= 0"), "positive band"),
        counted(fabrics.where(~F.lower("color").rlike("^#[0-9a-f]{6}$")), "color"),
        counted(fabrics.groupBy("model_id", "fabric_id").count().where("count > 1"), "unique fabric"),
        counted(used.join(known, ["model_id", "fabric_id"], "left_anti"), "unknown fabric"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def uncertain(cells: DataFrame, below: float = 0.9) -> DataFrame:
    return cells.groupBy("model_id").agg(F.sum((F.col("confidence") < below).cast("int")).alias("uncertain"), F.count("*").alias("cells"))


def plausible(extent: Column, count: Column) -> Column:
    """At least two cells, of five pixels or more."""
    return (count >= 2) & (count <= int_div(extent, 5))


def border_scan(cells: DataFrame, by_strip: bool = False) -> DataFrame:
    """(model_id, side, strips, fabric_id, score): how many strips from each side on are of one fabric, a
    quarter of the grid at most; the most frequent fabric of these strips; their mean score. A strip's score
    is its most frequent fabric's share once 15 percent of it is left out of account. by_strip: a row a strip
    (model_id, side, i, fabric_id, score) in their place."""
    sized = cells.join(dims(cells), "model_id")

    def strips(side: str, at: Column, extent: str) -> DataFrame:
        return sized.select("model_id", F.lit(side).alias("side"), at.alias("i"), F.col(extent).alias("extent"), "fabric_id")

    r, c, rows, cols = (F.col(x) for x in ("r", "c", "rows", "cols"))
    every = strips("left", c, "cols").unionByName(strips("right", cols - 1 - c, "cols")).unionByName(strips("top", r, "rows")).unionByName(strips("bottom", rows - 1 - r, "rows"))
    near = every.where(F.col("i") < int_div(F.col("extent"), 4))
    counts = near.groupBy("model_id", "side", "i", "fabric_id").agg(F.count("*").alias("n"))
    mode = counts.groupBy("model_id", "side", "i").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "fabric_id")).alias("m"))
    keep = F.greatest(F.lit(1), F.col("total") - F.floor(F.lit(TRIM) * F.col("total")))
    scored = mode.select("model_id", "side", "i", F.col("m.fabric_id").alias("fabric_id"), F.least(F.lit(1.0), -F.col("m.k") / keep).alias("score"))
    stop = F.min(F.when(F.col("score") < UNIFORM, F.col("i"))).over(W.partitionBy("model_id", "side"))
    lead = scored.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("i") < F.col("stop")))
    if by_strip:
        return lead.select("model_id", "side", "i", "fabric_id", "score")
    votes = lead.groupBy("model_id", "side", "fabric_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    return votes.groupBy("model_id", "side").agg(
        F.sum("n").alias("strips"), F.min(F.struct((-F.col("n")).alias("k"), "fabric_id"))["fabric_id"].alias("fabric_id"), (F.sum("s") / F.sum("n")).alias("score"))


def borders_found(cells: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(model_id, left, right, top, bottom, left_px, right_px, top_px, bottom_px, fabric_id, confidence): the strips of
    `border_scan` by side and how wide they are between boundaries (model_id, xs, ys); the most frequent fabric of
    all strips, the smallest of equal ones, and their mean score, null and 1 without any."""
    sides = border_scan(cells, by_strip=True)
    n = sides.groupBy("model_id").agg(
        *[F.count(F.when(F.col("side") == s, True)).alias(s) for s in ("left", "right", "top", "bottom")], F.avg("score").alias("confidence"))
    votes = sides.groupBy("model_id", "fabric_id").agg(F.count("*").alias("n")).groupBy("model_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "fabric_id"))["fabric_id"].alias("fabric_id"))
    every = boundaries.join(n, "model_id", "left").join(votes, "model_id", "left")
    left, right, top, bottom = (F.coalesce(F.col(s), F.lit(0)) for s in ("left", "right", "top", "bottom"))

    def low(edges: str, k: Column) -> Column:
        return F.get(edges, k.cast("int")) - F.get(edges, F.lit(0))

    def high(edges: str, k: Column) -> Column:
        return F.element_at(edges, -1) - F.get(edges, (F.size(edges) - 1 - k).cast("int"))

    return every.select(
        "model_id", left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"), low("xs", left).alias("left_px"), high("xs", right).alias("right_px"),
        low("ys", top).alias("top_px"), high("ys", bottom).alias("bottom_px"), "fabric_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def voted(cells: DataFrame, periods: DataFrame) -> DataFrame:
    """cells with `voted`: those of low confidence get the label of the greatest weight among their periodic
    copies. periods: (model_id, period_rows, period_cols). An axis votes with three copies or more; ties and
    a tally of nothing go to the smallest label (of the copies, or of the whole grid). Grids without periods, or
    with null ones, stay as they are."""
    size = dims(cells).join(periods, "model_id", "left")
    pr, pc = F.coalesce("period_rows", F.lit(0)), F.coalesce("period_cols", F.lit(0))
    placed = cells.join(size, "model_id")
    by_r, by_c = (pr > 0) & (F.col("rows") >= COPIES * pr), (pc > 0) & (F.col("cols") >= COPIES * pc)
    placed = placed.withColumn("kr", F.when(by_r, F.col("r") % F.greatest(pr, F.lit(1))).otherwise(F.col("r"))).withColumn("kc", F.when(by_c, F.col("c") % F.greatest(pc, F.lit(1))).otherwise(F.col("c"))).withColumn("votes", by_r | by_c)
    tally = placed.where("votes").groupBy("model_id", "kr", "kc", "fabric_id").agg(F.sum("confidence").alias("w"))
    best = tally.groupBy("model_id", "kr", "kc").agg(F.min(F.struct((-F.col("w")).alias("k"), "fabric_id")).alias("b"))
    smallest = cells.groupBy("model_id").agg(F.min("fabric_id").alias("least"))
    found = placed.join(best, ["model_id", "kr", "kc"], "left").join(smallest, "model_id")
    winner = F.when(F.col("b.k") < 0, F.col("b.fabric_id")).otherwise(F.col("least"))
    new = F.when(F.col("votes") & (F.col("confidence") < SURE), winner).otherwise(F.col("fabric_id"))
    return found.select("model_id", "r", "c", "fabric_id", "confidence", new.alias("voted"))


def compared(truth: DataFrame, recovered: DataFrame, mapping: DataFrame) -> DataFrame:
    """(model_id, compared, accuracy, dims_match) of cells on the overlap; mapping (model_id, fabric_id, truth_id)
    names the recovered fabrics, those without a name match nothing."""
    named = recovered.join(mapping, ["model_id", "fabric_id"], "left").select("model_id", "r", "c", F.coalesce("truth_id", F.lit("?")).alias("named"))
    both = truth.join(named, ["model_id", "r", "c"]).groupBy("model_id").agg(F.count("*").alias("compared"), F.avg((F.col("named") == F.col("fabric_id")).cast("double")).alias("accuracy"))
    a, b = (dims(x).select("model_id", F.col("rows").alias(f"rows_{k}"), F.col("cols").alias(f"cols_{k}")) for k, x in (("a", truth), ("b", recovered)))
    same = (F.col("rows_a") == F.col("rows_b")) & (F.col("cols_a") == F.col("cols_b"))
    return a.join(b, "model_id").join(both, "model_id", "left").select("model_id", F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), same.alias("dims_match"))


def compared_models(truth: Models, recovered: Models) -> DataFrame:
    """(model_id, compared, accuracy, dims_match, mapping, stages): `compared` with the recovered palette's fabrics
    matched to the true ones by color, that mapping, and for each stage the confidence of the recovered model
    (column stage_confidence of its quilts, a map; 1 where it has none)."""

    def palette(m: Models) -> DataFrame:
        return m.fabrics.select("model_id", "ord", "fabric_id", F.array(*[c.cast("double") for c in colors.lab(F.col("color"))]).alias("v"))

    mapping = pixels.matched_palettes(palette(truth), palette(recovered)).select("model_id", "fabric_id", "truth_id")
    listed = mapping.groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fabric_id", "truth_id")))).alias("mapping"))
    told = F.col("stage_confidence") if "stage_confidence" in recovered.quilts.columns else F.lit(None).cast("map<string, double>")
    stages = F.map_from_arrays(F.array(*[F.lit(s) for s in STAGES]), F.array(*[F.coalesce(F.try_element_at(told, F.lit(s)), F.lit(1.0)) for s in STAGES]))
    found = compared(truth.cells, recovered.cells, mapping)
    return found.join(listed, "model_id", "left").join(recovered.quilts.select("model_id", stages.alias("stages")), "model_id", "left")


def nearest_two(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(point_id, center_id, d1, d2, margin) from (point_id, v) and a small table (center_id, w): the nearest
    center (the smaller id of equal ones) and how far behind the second is, relative to it."""
    square = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    listed = F.array_sort(F.collect_list(F.struct("center_id", "w")))
    table = centers.agg(listed.alias("centers"))  # a palette's handful of rows in one
    spread = points.join(F.broadcast(table)).select("point_id", "v", F.inline("centers"))
    ranked = spread.select("point_id", "center_id", F.sqrt(square).alias("d")).groupBy("point_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "center_id"))), 1, 2).alias("top"))
    d1, d2 = F.get("top", F.lit(0))["d"], F.coalesce(F.get("top", F.lit(1))["d"], F.get("top", F.lit(0))["d"] + 1)
    return ranked.select("point_id", F.get("top", F.lit(0))["center_id"].alias("center_id"), d1.alias("d1"), d2.alias("d2"), F.when(d2 > 0, (d2 - d1) / d2).otherwise(0.0).alias("margin"))


def verdict(grid: Column, periodicity: Column, coherence: Column, repeat: Column, snr: Column | None = None, lock: Column | None = None, mean_cell: Column | None = None, block: Column | None = None) -> Column:
    """readable, readable_no_repeat, non_square_repeat or no_grid; comparisons are strict. The last four are
    the corroboration, null where there is none."""
    rest = F.when(periodicity < T2, F.when(repeat, "readable").otherwise("readable_no_repeat")).when(coherence > T3, "non_square_repeat").otherwise("readable")
    if snr is None:
        return F.when(grid < T1, "no_grid").otherwise(rest)
    lattice = F.coalesce(snr >= T4, F.lit(False))
    rescued = lattice & F.coalesce(lock & (mean_cell >= T5), F.lit(False))
    textured = lattice & F.coalesce(block > T3, F.lit(False))
    return F.when((grid >= T1) | rescued, rest).when(textured, "non_square_repeat").otherwise("no_grid")


def summary(models: Models) -> DataFrame:
    """A row a model: sides, number of fabrics, finished and batting size, and the batting's quarter yards."""
    n = models.fabrics.groupBy("model_id").agg(F.count("*").alias("fabric_count"))
    size = sizing.finished_columns(models.quilts, models.borders)
    q = models.quilts.select("model_id", "rows", "cols").join(size, "model_id").join(n, "model_id", "left")
    return q.select(
        "model_id", "rows", "cols", F.coalesce("fabric_count", F.lit(0)).alias("fabric_count"), "finished_width", "finished_height", "batting_width", "batting_height",
        ceil_div(F.col("batting_height"), QUARTER_YARD).alias("batting_quarters"),
    )
