"""Project files and autosaved documents: a model's document inside an application's wrapper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources import documents
from gridloom.sources.grids import Models

VERSION, UNTITLED = 1, "Untitled"


def _quoted(text: Column) -> Column:
    """A text as a JSON text: an array of one, without its brackets."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


def wrap(models: Models, app: str, ui: DataFrame | None = None, saved_at: DataFrame | None = None) -> DataFrame:
    """(model_id, json): each model's document with the application's name and version, the quilt's name and the state of
    the user interface beside it. ui: (model_id, ui) with JSON texts, {} where there is none; saved_at:
    (model_id, saved_at) in milliseconds makes autosaved documents, 0 where there is none."""
    rows = documents.to_json(models).join(models.quilts.select("model_id", "name"), "model_id")
    state, time = F.lit("{}"), F.lit("")
    if ui is not None:
        rows, state = rows.join(ui.select("model_id", "ui"), "model_id", "left"), F.coalesce("ui", F.lit("{}"))
    if saved_at is not None:
        rows = rows.join(saved_at.select("model_id", "saved_at"), "model_id", "left")
        time = F.concat(F.lit('"savedAt":'), F.coalesce("saved_at", F.lit(0)).cast("string"), F.lit(","))
    head = F.concat(F.lit('{"app":'), _quoted(F.lit(app)), F.lit(f',"version":{VERSION},"name":'), _quoted(F.col("name")), F.lit(","))
    return rows.select("model_id", F.concat(head, time, F.lit('"model":'), F.col("json"), F.lit(',"ui":'), state, F.lit("}")).alias("json"))


def unwrap(rows: DataFrame) -> DataFrame:
    """(model_id, name, saved_at, ui, json, problem) from wrapped documents (model_id, json).

    Only models of schema_version "1" to the letter are taken; json is null otherwise and problem names the version
    found. Names, times and states that are missing are "Untitled", 0 and {}."""
    version = F.get_json_object("json", "$.model.schema_version")
    # a number 1 reads like the text "1", so the kind is told by the raw value
    typed = F.get_json_object(F.col("json"), "$.model").rlike(r'"schema_version"\s*:\s*"')
    good = (version == "1") & typed
    is_json = F.get_json_object("json", "$").isNotNull() & F.startswith(F.ltrim("json"), F.lit("{"))
    problem = F.when(~F.coalesce(is_json, F.lit(False)), "not a JSON object").when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("unsupported schema_version "), F.coalesce(version, F.lit("(none)"))))
    told = rows.select("model_id", "json", problem.alias("problem"))
    ok = F.col("problem").isNull()

    def field(name: str, other: str) -> Column:
        return F.when(ok, F.coalesce(F.get_json_object("json", f"$.{name}"), F.lit(other)))

    return told.select(
        "model_id", field("name", UNTITLED).alias("name"), field("savedAt", "0").cast("long").alias("saved_at"), field("ui", "{}").alias("ui"),
        F.when(ok, F.get_json_object("json", "$.model")).alias("json"), "problem",
    )
