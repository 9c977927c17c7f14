"""All reports of a plan by the names of their formats, and the viewer's configuration."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import sizing, structure
from gridloom.plans import construction
from gridloom.plans.construction import Plan
from gridloom.sources import booklets, reports
from gridloom.sources.grids import Models

#: Files are JSON lines with a key column, many models to a file.
_CONFIG = "rows cols cellSize borders block checker wof presets blockTypes layout"


def _texts(rows: DataFrame, path: str) -> list[str]:
    rows.write.json(path)
    return [path]


def _cutlist(plan: Plan, path: str) -> list[str]:
    reports.write_csv(plan, f"{path}/cutlist_csv")
    return [*_texts(reports.cut_list_markdown(plan), f"{path}/cutlist_md"), f"{path}/cutlist_csv"]


def _yardage(plan: Plan, path: str) -> list[str]:
    return _texts(reports.yardage_markdown(construction.purchase(plan), plan.strategy), f"{path}/yardage_md")


def _booklet(plan: Plan, path: str) -> list[str]:
    rows = booklets.sections(plan)
    return _texts(rows.repartition("model_id").sortWithinPartitions("model_id", "section", "part", "ord"), f"{path}/booklet")


def _viewer(plan: Plan, path: str) -> list[str]:
    return _texts(viewer_config(plan.models, plan.blocks), f"{path}/viewer")


EXPORTERS: dict[str, Callable[[Plan, str], list[str]]] = {"cutlist": _cutlist, "yardage": _yardage, "booklet": _booklet, "viewer": _viewer}


def export(plan: Plan, path: str, formats: Iterable[str] | None = None) -> list[str]:
    """Writes the formats named, or all, below a path and gives the folders written. An unknown name is an error, told
    before anything is written."""
    chosen = list(EXPORTERS) if formats is None else list(formats)
    unknown = [f for f in chosen if f not in EXPORTERS]
    if unknown:
        raise KeyError(f"unknown formats {', '.join(map(repr, unknown))}; there are {', '.join(EXPORTERS)}")
    plan = construction.settled(plan)
    return [folder for f in chosen for folder in EXPORTERS[f](plan, path)]


def viewer_config(models: Models, blocks: DataFrame | None = None) -> DataFrame:
    """(model_id, json): what a sizing viewer needs of a model. Without block structure the block is 1, and types and
    layout are null; checker tells two types that alternate from the first block on."""
    found = structure.block_layout(models.cells) if blocks is None else blocks
    side = F.col("size").cast("int")

    def ordered(key: str, value):
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])

    types = structure.types_of(found).groupBy("model_id", "size").agg(ordered("type", F.col("sig")).alias("sigs")).select(
        "model_id", "size", F.transform("sigs", lambda s: F.transform(F.sequence(F.lit(0), side - 1), lambda i: F.slice(F.split(s, ","), i * side + 1, side))).alias("blockTypes"),
    )
    across = found.groupBy("model_id", "br").agg(ordered("bc", F.col("type").cast("int")).alias("row"), F.bool_and(F.col("type") == (F.col("br") + F.col("bc")) % 2).alias("even"))
    layout = across.groupBy("model_id").agg(ordered("br", F.col("row")).alias("layout"), F.bool_and("even").alias("even"))
    bands = models.borders.groupBy("model_id").agg(ordered("ord", F.col("width")).alias("borders"))
    q = models.quilts.join(types, "model_id", "left").join(layout, "model_id", "left").join(bands, "model_id", "left")
    presets = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("w"), F.lit(h).alias("h")) for n, w, h in sizing.PRESETS])
    fields = {
        "cellSize": F.col("cell_size"), "borders": F.coalesce("borders", F.array().cast("array<int>")), "block": F.coalesce(side, F.lit(1)),
        "checker": F.coalesce((F.size("blockTypes") == 2) & F.col("even"), F.lit(False)), "presets": presets,
    }
    config = F.struct(*[fields[n].alias(n) if n in fields else F.col(n) for n in _CONFIG.split()])
    return q.select("model_id", F.to_json(config, {"ignoreNullFields": "false"}).alias("json"))
