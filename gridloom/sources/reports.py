"""Reports of plans as files and texts: cut lists as CSV and Markdown, yardage as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.lengths import QUARTER_YARD, ceil_div, shown, yards_shown
from gridloom.functions.report import quarters_shown
from gridloom.operators import sizing
from gridloom.plans.construction import Plan, cut_list

CSV_SCHEMA = (
    "line long, fabric_id string, fabric_name string, component string, source string, label string, quantity long, cut_width_eighths long, cut_height_eighths long, "
    "finished_width_eighths long, finished_height_eighths long, cut_size string, finished_size string, model_id string"
)
#: The heads of the tables.
_HEADS = ("| Piece | Component | Source | Quantity | Cut size | Finished size |", "| --- | --- | --- | --- | --- | --- |")
_CHART = ("| Set | Strips (top to bottom) | Strip cut width | Sets to make | Segments per set | Segments needed |", "| --- | --- | --- | --- | --- | --- |")


def write_csv(plan: Plan, path: str) -> None:
    """CSV files with a key column: a model's lines meet in one task, in plan order, and many models share a file."""
    names = [x.split()[0] for x in CSV_SCHEMA.split(", ")]
    ordered = cut_list(plan).select(*names).repartition("model_id").sortWithinPartitions("model_id", "line")
    ordered.write.csv(path, header=True, quote='"', escape='"')


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=CSV_SCHEMA, header=True, quote='"', escape='"')


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def _in_order(key: Column, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"])


def cut_list_markdown(plan: Plan) -> DataFrame:
    """(model_id, text): a section for each fabric that has pieces, then the chart of the strip sets, if any."""
    source = F.when(F.col("source") == "strip_set", "strip sets").otherwise("rotary")
    lines = cut_list(plan).withColumn("text", _row(F.col("label"), F.col("component"), source, F.col("quantity"), F.col("cut_size"), F.col("finished_size")))
    palette = plan.models.fabrics.select("model_id", "fabric_id", "ord")
    sections = lines.join(palette, ["model_id", "fabric_id"]).groupBy("model_id", "ord", "fabric_id", "fabric_name").agg(_in_order(F.col("line"), F.col("text")).alias("lines"))
    title = F.concat(F.lit("## "), F.col("fabric_name"), F.lit(" ("), F.col("fabric_id"), F.lit(")"))
    whole = F.concat(F.array(title, F.lit(""), *map(F.lit, _HEADS)), F.col("lines"), F.array(F.lit("")))
    body = sections.groupBy("model_id").agg(F.flatten(_in_order(F.col("ord"), whole)).alias("body"))
    row = _row(F.concat(F.lit("SS"), F.col("set").cast("string")), F.array_join("sequence", " "), shown(F.col("width")), F.col("sets"), F.col("per_set"), F.col("needed"))
    chart = plan.sets.join(plan.models.quilts.select("model_id", "cell_size", "seam_allowance"), "model_id").groupBy("model_id").agg(_in_order(F.col("set"), row).alias("rows"), F.max(F.col("cell_size") + 2 * F.col("seam_allowance")).alias("segment"))
    end = F.concat(F.lit("\nCrosscut every set at "), shown(F.col("segment")), F.lit("."))
    chart = chart.select("model_id", F.concat(F.array(F.lit("## Strip cutting chart"), F.lit(""), *map(F.lit, _CHART)), F.col("rows"), F.array(end, F.lit(""))).alias("chart")).hint("merge")
    head = F.array(F.concat(F.lit("# Cut list - "), F.col("name"), F.lit(f" ({plan.strategy} strategy)")), F.lit(""))
    every = plan.models.quilts.select("model_id", "name").join(body, "model_id", "left").join(chart, "model_id", "left")
    none = F.array().cast("array<string>")
    return every.select("model_id", F.array_join(F.concat(head, F.coalesce("body", none), F.coalesce("chart", none)), "\n").alias("text"))


def yardage_markdown(lines: DataFrame, strategy: str) -> DataFrame:
    """(model_id, text) of yardage lines."""
    label = F.when(F.col("fabric_id").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "fabric_id", F.lit(")")))
    row = _row(label, shown(F.col("length_needed")), yards_shown(F.col("quarter_yards")))
    rows = lines.groupBy("model_id").agg(_in_order(F.struct("grp", "ord"), row).alias("rows"))
    head = F.array(F.lit(f"# Yardage ({strategy} strategy)"), F.lit(""), F.lit("| Fabric | Length needed | Yards |"), F.lit("| --- | --- | --- |"))
    note = "Yardage rounds up to the nearest 1/4 yard per fabric. Backing is a dedicated line item, never a palette fabric."
    return rows.select("model_id", F.array_join(F.concat(head, F.col("rows"), F.array(F.lit(""), F.lit(note), F.lit(""))), "\n").alias("text"))


def settings_summary(plan: Plan, lines: DataFrame) -> DataFrame:
    """(model_id, text): a pattern's size, squares and borders, and what to buy, from purchase lines. What isn't bought
    is a dash."""
    m = plan.models
    size = sizing.finished_columns(m.quilts, m.borders)
    bands = m.borders.groupBy("model_id").agg(F.array_join(_in_order(F.col("ord"), shown(F.col("width"))), " + ").alias("bands"))
    yards = F.concat(quarters_shown(F.col("quarter_yards")), F.lit(" yd"))
    top = F.concat(F.lit("  - "), F.col("name"), F.lit(": "), yards)
    bought = lines.groupBy("model_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("purpose") == "top", F.struct(F.col("ord").alias("k"), top.alias("v"))))), lambda x: x["v"]).alias("tops"),
        *[F.min(F.when(F.col("purpose") == p, F.struct("ord", yards.alias("v"))))["v"].alias(p) for p in ("binding", "backing")],
    ).hint("merge")
    q = m.quilts.join(size.drop("cell_size", "rows", "cols", "name"), "model_id").join(bands, "model_id", "left").join(bought, "model_id", "left")
    batting = F.concat(shown(F.col("batting_width")), F.lit(" × "), shown(F.col("batting_height")), F.lit(" ("), quarters_shown(ceil_div(F.col("batting_height"), QUARTER_YARD)), F.lit(" yd)"))
    tops = F.coalesce("tops", F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit("Pattern — "), "name"), F.concat(F.lit("Finished size: "), shown(F.col("finished_width")), F.lit(" × "), shown(F.col("finished_height"))),
        F.concat(F.lit("Squares: "), F.col("cols").cast("string"), F.lit(" × "), F.col("rows").cast("string"), F.lit(" at "), shown(F.col("cell_size")), F.lit(" each ("), (F.col("rows") * F.col("cols")).cast("string"), F.lit(" squares)")),
        F.concat(F.lit("Borders: "), F.coalesce("bands", F.lit(""))),
    )
    body = F.when(F.size(tops) > 0, F.concat(F.array(F.lit("Fabric yardage:")), tops)).otherwise(tops)
    end = F.array(*[F.concat(F.lit(f"{n}: "), v) for n, v in (("Binding", F.coalesce("binding", F.lit("—"))), ("Backing", F.coalesce("backing", F.lit("—"))), ("Batting", batting))])
    return q.select("model_id", F.array_join(F.concat(head, body, end), "\n").alias("text"))
