"""Grid models as JSON documents: parsing behind a version gate, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.grids import Models

SCHEMA = (
    "struct<schema_version: string, metadata: struct<name: string, notes: string>, palette: struct<fabrics: array<struct<id: string, name: string, color: string>>>, "
    "center: struct<kind: string, rows: int, cols: int, cell_size: int, cells: array<array<string>>, cell_confidence: array<array<double>>>, "
    "borders: array<struct<fabric_id: string, width: int>>, binding: struct<fabric_id: string, strip_width: int>, "
    "quilting: struct<motifs: array<struct<name: string, x: int, y: int, width: int, height: int>>, density: double>, "
    "settings: struct<seam_allowance: int, wof: int, binding_strip_width: int, binding_extra: int, backing_margin: int>, "
    "provenance: struct<source: string, stage_confidence: map<string, double>>>"
)


def _optional() -> dict[str, Column]:
    """Columns of quilts that only documents have, and what they are where they are missing."""
    return {
        "notes": F.lit(""), "binding_strip_width": F.lit(20), "density": F.lit(None).cast("double"),
        "motifs": F.array().cast("array<struct<name: string, x: int, y: int, width: int, height: int>>"),
        "source": F.lit("authored"), "stage_confidence": F.create_map().cast("map<string, double>"),
    }


_PLACES = (("metadata", "notes"), ("settings", "binding_strip_width"), ("quilting", "motifs"), ("quilting", "density"), ("provenance", "source"), ("provenance", "stage_confidence"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, json) of all document files at a path, a file each: the id is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("model_id"), F.col("value").alias("json"))


def save(models: Models, path: str) -> None:
    """The models' documents as JSON lines of model_id and json, many to a file."""
    to_json(models).write.json(path)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, json) of what `save` wrote."""
    return spark.read.schema("model_id string, json string").json(path)


def parse(rows: DataFrame) -> DataFrame:
    """(model_id, doc, problem) from (model_id, json); a project file's model is taken out of it. doc is null and
    problem says why where the text isn't a document of version 1."""
    inner = F.when(F.get_json_object("json", "$.app").isNotNull(), F.get_json_object("json", "$.model"))
    text = F.coalesce(inner, F.col("json"))
    version = F.get_json_object(text, "$.schema_version")
    problem = (
        F.when(F.get_json_object(text, "$").isNull() | ~F.startswith(F.ltrim(text), F.lit("{")), "not a JSON object").when(version.isNull(), "missing schema_version")
        .when(F.substring_index(version, ".", 1) != "1", "unsupported schema_version")
    )
    checked = rows.select("model_id", text.alias("json"), problem.alias("problem"))
    return checked.select("model_id", F.when(F.col("problem").isNull(), F.from_json("json", SCHEMA)).alias("doc"), "problem")


def cells_of(parsed: DataFrame) -> DataFrame:
    """(model_id, r, c, fabric_id, confidence) of the documents that parsed."""
    rows = parsed.where("doc is not null").select("model_id", "doc.center.cell_confidence", F.posexplode("doc.center.cells").alias("r", "row"))
    cells = rows.select("model_id", "cell_confidence", "r", F.posexplode("row").alias("c", "fabric_id"))
    return cells.select("model_id", "r", "c", "fabric_id", F.coalesce(F.get(F.get("cell_confidence", F.col("r")), F.col("c")), F.lit(1.0)).alias("confidence"))


def quilts_of(parsed: DataFrame) -> DataFrame:
    """One row a document, defaults filled in."""
    d = parsed.where("doc is not null")
    usual = {"seam_allowance": 2, "wof": 336, "binding_extra": 80, "backing_margin": 64}
    return d.select(
        "model_id", F.col("doc.metadata.name").alias("name"), *[F.col(f"doc.center.{c}").alias(c) for c in ("rows", "cols", "cell_size")],
        F.col("doc.binding.fabric_id").alias("binding_fabric_id"), F.coalesce("doc.binding.strip_width", F.lit(20)).alias("binding_width"),
        *[F.coalesce(f"doc.settings.{k}", F.lit(v)).alias(k) for k, v in usual.items()],
        *[F.coalesce(f"doc.{at}.{k}", _optional()[k]).alias(k) for at, k in _PLACES],
    )


def fabrics_of(parsed: DataFrame) -> DataFrame:
    each = parsed.where("doc is not null").select("model_id", F.posexplode("doc.palette.fabrics").alias("ord", "f"))
    return each.select("model_id", "ord", F.col("f.id").alias("fabric_id"), F.col("f.name").alias("name"), F.lower("f.color").alias("color"))


def borders_of(parsed: DataFrame) -> DataFrame:
    each = parsed.where("doc is not null").select("model_id", F.posexplode("doc.borders").alias("ord", "b"))
    return each.select("model_id", "ord", "b.*")


def models_of(parsed: DataFrame) -> Models:
    return Models(quilts_of(parsed), cells_of(parsed), fabrics_of(parsed), borders_of(parsed))


def _ordered(struct, key: str):
    return F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), struct.alias("v"))))


def to_json(models: Models) -> DataFrame:
    """(model_id, json): a document a model, fields and lists in fixed order."""
    rows = models.cells.groupBy("model_id", "r").agg(F.transform(_ordered(F.col("fabric_id"), "c"), lambda x: x["v"]).alias("row"), F.transform(_ordered(F.col("confidence"), "c"), lambda x: x["v"]).alias("conf"))
    grid = rows.groupBy("model_id").agg(F.transform(_ordered(F.col("row"), "r"), lambda x: x["v"]).alias("cells"), F.transform(_ordered(F.col("conf"), "r"), lambda x: x["v"]).alias("cell_confidence"))
    fabrics = models.fabrics.groupBy("model_id").agg(F.transform(_ordered(F.struct(F.col("fabric_id").alias("id"), "name", "color"), "ord"), lambda x: x["v"]).alias("fabrics"))
    bands = models.borders.groupBy("model_id").agg(F.transform(_ordered(F.struct("fabric_id", "width"), "ord"), lambda x: x["v"]).alias("borders"))
    q = models.quilts.join(grid, "model_id").join(fabrics, "model_id", "left").join(bands, "model_id", "left")
    q = q.withColumns({k: v for k, v in _optional().items() if k not in q.columns})
    doc = F.struct(
        F.lit("1").alias("schema_version"), F.struct("name", "notes").alias("metadata"), F.struct("fabrics").alias("palette"),
        F.struct(F.lit("grid").alias("kind"), "rows", "cols", "cell_size", "cells", "cell_confidence").alias("center"),
        F.coalesce("borders", F.array().cast("array<struct<fabric_id: string, width: int>>")).alias("borders"),
        F.struct(F.col("binding_fabric_id").alias("fabric_id"), F.col("binding_width").alias("strip_width")).alias("binding"),
        F.struct("motifs", "density").alias("quilting"),
        F.struct("seam_allowance", "wof", "binding_strip_width", "binding_extra", "backing_margin").alias("settings"),
        F.struct("source", "stage_confidence").alias("provenance"),
    )
    return q.select("model_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
