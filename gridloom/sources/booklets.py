"""Booklets of plans: eight sections of paragraphs, tables and numbered steps, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.lengths import ceil_div, shown, yards_shown
from gridloom.operators import analytics, sizing
from gridloom.plans import construction
from gridloom.plans.construction import Plan

#: The sections' titles and the tables' heads.
TITLES = ("Introduction", "Fabrics", "Cutting", "Strip sets", "Assembly", "Borders", "Binding", "Finishing")
_FABRICS = ("Fabric", "ID", "Color", "Cells")
_PURCHASE = ("Purchase", "Length", "Yards")
_CUTTING = ("Fabric", "Piece", "Component", "Quantity", "Cut size", "Finished size")
_STRIPS = ("Set", "Strips", "Strip cut width", "Sets to make", "Segments per set", "Segments needed")
BATTING_MARGIN = 64


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def sections(p: Plan) -> DataFrame:
    """(model_id, section, title, part, kind, ord, cells): every section's rows, in order of (section, part, ord).

    Sections count from 1. Part 0 holds the paragraphs, part n the n-th table, whose row 0 is its head; kind is
    paragraph, table or numbered. cells has one text for paragraphs and numbered steps, and one a column for
    tables. Every model of the plan has all eight sections."""
    m = p.models
    names = m.fabrics.select("model_id", "fabric_id", F.col("name").alias("fabric_name"))
    size = sizing.finished_columns(m.quilts, m.borders).select("model_id", "finished_width", "finished_height", "binding_length")
    q = m.quilts.join(size, "model_id").hint("merge")
    lines = construction.purchase(p)
    parts = []

    def rows(df: DataFrame, section: int, part: int, kind: str, ord_: Column, *cells: Column) -> None:
        values = F.array(*[c.cast("string") for c in cells])
        parts.append(df.select("model_id", F.lit(section).alias("section"), F.lit(part).alias("part"), F.lit(kind).alias("kind"), ord_.cast("int").alias("ord"), values.alias("cells")))

    def paragraphs(df: DataFrame, section: int, *texts: Column) -> None:
        each = df.select("model_id", F.posexplode(F.array(*texts)).alias("ord", "text"))
        rows(each, section, 0, "paragraph", F.col("ord"), F.col("text"))

    def table(df: DataFrame, owners: DataFrame, section: int, part: int, head: tuple[str, ...], ord_: Column, *cells: Column) -> None:
        rows(owners, section, part, "table", F.lit(0), *map(F.lit, head))
        rows(df, section, part, "table", ord_, *cells)

    told = q.join(construction.metrics(p), "model_id")
    label = F.col("heuristic_label")
    paragraphs(
        told, 1, _said(F.col("name"), " finishes at ", shown(F.col("finished_width")), " wide by ", shown(F.col("finished_height")), " tall."),
        _said(f"This booklet plans the quilt with the {p.strategy} strategy. The finished top has ", F.col("piece_count"), " pieces."),
        _said("Difficulty is ", F.col("difficulty"), " on a ", label, "."), _said("Estimated piecing time is ", F.col("time_minutes"), " minutes on a ", label, "."),
    )
    paragraphs(q, 2, F.lit("Palette fabrics and the yardage to buy, rounded up per fabric."))
    colored = analytics.census(m).join(m.fabrics.select("model_id", "ord", "color"), ["model_id", "ord"])
    table(colored, q, 2, 1, _FABRICS, F.col("ord") + 1, *[F.col(c) for c in ("name", "fabric_id", "color", "cells")])
    placed = lines.withColumn("place", F.row_number().over(W.partitionBy("model_id").orderBy("grp", "ord")))
    table(placed, q, 2, 2, _PURCHASE, F.col("place"), F.col("name"), shown(F.col("length_needed")), yards_shown(F.col("quarter_yards")))
    table(construction.cut_list(p), q, 3, 1, _CUTTING, F.col("line"), *[F.col(c) for c in ("fabric_name", "label", "component", "quantity", "cut_size", "finished_size")])
    with_sets = q.join(p.sets.select("model_id").distinct(), "model_id", "left_semi")
    paragraphs(with_sets, 4, _said("Crosscut every strip set at ", shown(F.col("cell_size") + 2 * F.col("seam_allowance")), "."))
    paragraphs(q.join(p.sets.select("model_id").distinct(), "model_id", "left_anti"), 4, F.lit("No strip sets for this strategy."))
    table(p.sets, with_sets, 4, 1, _STRIPS, F.col("set"), _said("SS", F.col("set")), F.array_join("sequence", " "), shown(F.col("width")), F.col("sets"), F.col("per_set"), F.col("needed"))
    step = F.array_join(F.concat(F.array(_said(F.col("title"), ". ", F.col("detail"))), F.col("substeps")), " ")
    rows(construction.assembly(p), 5, 1, "numbered", F.col("number"), step)
    bands = m.borders.join(names, ["model_id", "fabric_id"])
    rows(bands, 6, 0, "paragraph", F.col("ord"), _said("Border ", F.col("ord") + 1, ": ", F.col("fabric_name"), ", ", shown(F.col("width")), " finished band on all four sides."))
    paragraphs(q.join(m.borders.select("model_id").distinct(), "model_id", "left_anti"), 6, F.lit("No border bands."))
    bound = q.join(names, (q["model_id"] == names["model_id"]) & (q["binding_fabric_id"] == names["fabric_id"])).drop(names["model_id"])
    strips = ceil_div(F.col("binding_length"), F.col("wof"))
    paragraphs(bound, 7, _said("Bind with ", F.col("fabric_name"), ". Cut ", shown(F.col("binding_width")), " strips and join ", strips, " widths of fabric for ", shown(F.col("binding_length")), " of binding."))
    backing = q.join(lines.where("purpose = 'backing'").select("model_id", "length_needed"), "model_id")
    known = backing.columns
    motifs = F.size("motifs") if "motifs" in known else F.lit(0)
    density = F.col("density").cast("double") if "density" in known else F.lit(None).cast("double")
    authored = _said("Quilting: ", motifs, " authored motif(s)", F.coalesce(_said(" at ", density, " stitches per inch."), F.lit(".")))
    note = F.when(motifs > 0, authored).otherwise("Quilting: no motifs are authored. Quilt as desired, for example an allover edge-to-edge design.")
    panels = ceil_div(F.col("finished_width") + F.col("backing_margin"), F.col("wof"))
    wide, high = (shown(F.col(c) + BATTING_MARGIN) for c in ("finished_width", "finished_height"))
    paragraphs(
        backing, 8, _said("Backing: piece ", panels, " panel(s) for ", shown(F.col("length_needed")), " of 42-inch fabric."),
        _said("Batting: at least ", wide, " by ", high, ", the finished top plus ", shown(F.lit(BATTING_MARGIN)), " on each dimension."), note,
    )
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    title = F.element_at(F.array(*map(F.lit, TITLES)), F.col("section"))
    return every.select("model_id", "section", title.alias("title"), "part", "kind", "ord", "cells")
