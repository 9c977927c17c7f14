"""Booklets, project files and exports on odd rows and against known figures."""

import json

import pytest

from gridloom.plans import construction
from gridloom.sources import booklets, documents, exports, grids, projects


def test_booklet_without_block_structure(spark):
    rows = booklets.sections(construction.settled(construction.plan(grids.authored(spark, ("mini", "checker")), "historical"))).collect()
    book = {(r["model_id"], r["section"], r["part"], r["ord"]): list(r["cells"]) for r in rows}
    assert len(book) == len(rows)
    for m in ("mini", "checker"):
        assert [r["title"] for r in sorted(rows, key=lambda r: r["section"]) if r["model_id"] == m and r["ord"] == 0 and r["part"] in (0, 1)]
        assert {r["section"] for r in rows if r["model_id"] == m} == set(range(1, 9))
        assert book[m, 4, 0, 0] == ["No strip sets for this strategy."] and (m, 4, 1, 0) not in book
    assert book["checker", 6, 0, 0] == ["No border bands."]
    assert book["mini", 6, 0, 0] == ['Border 1: Background cream, 1/4" finished band on all four sides.']
    assert book["mini", 5, 1, 1] == ["Piece each cell row. Sew each of the 5 rows of 7 cells left to right."]
    assert book["checker", 5, 1, 1] == ['Piece Block A (make 2). 2 x 2 cells of 1" finished. Row 1: sew r w left to right. Row 2: sew w r left to right. Join the 2 rows to finish the block.']
    assert book["checker", 2, 1, 1] == ["Red", "r", "#c03030", "8"]


def test_modern_substeps_name_the_merged_pieces(spark):
    steps = construction.assembly(construction.plan(grids.authored(spark, ("checker", "tiny")), "modern")).where("size(substeps) > 0").collect()
    found = {(r["model_id"], r["title"]): list(r["substeps"]) for r in steps}
    assert found["tiny", "Attach border 1"] == ["Sew the two side pieces, press toward the border.", "Sew the top and bottom pieces, press toward the border."]
    assert found["checker", "Piece Block A from merged pieces (make 2)"] == ['1" x 1" r at row 1, col 1', '1" x 1" w at row 1, col 2', '1" x 1" w at row 2, col 1', '1" x 1" r at row 2, col 2']


def test_booklet_tells_authored_motifs(spark):
    m = grids.authored(spark, ("checker",))
    doc = documents.to_json(m).first()["json"]
    for density, end in ((8.5, " at 8.5 stitches per inch."), (None, ".")):
        quilting = {"motifs": [{"name": "feather", "x": 0, "y": 0, "width": 8, "height": 8}] * 2, "density": density}
        rows = spark.createDataFrame([("m", json.dumps(json.loads(doc) | {"quilting": quilting}))], "model_id string, json string")
        plan = construction.plan(documents.models_of(documents.parse(rows)), "historical")
        note = booklets.sections(plan).where("section = 8 and ord = 2").first()["cells"]
        assert list(note) == ["Quilting: 2 authored motif(s)" + end]


def test_project_files_round_trip(spark):
    m = grids.authored(spark, ("tiny", "small"))
    named = grids.Models(m.quilts.selectExpr("*", "concat('a \"', model_id, '\" \\\\ é') as other").drop("name").withColumnRenamed("other", "name"), m.cells, m.fabrics, m.borders)
    ui = spark.createDataFrame([("tiny", '{"zoom":2}')], "model_id string, ui string")
    made = projects.wrap(named, 'an "app"', ui)
    for r in made.collect():
        doc = json.loads(r["json"])
        assert list(doc) == ["app", "version", "name", "model", "ui"] and doc["app"] == 'an "app"' and doc["name"] == f'a "{r["model_id"]}" \\ é'
    read = {r["model_id"]: r for r in projects.unwrap(made).collect()}
    assert read["tiny"]["ui"] == '{"zoom":2}' and read["small"]["ui"] == "{}" and read["tiny"]["saved_at"] == 0 and read["tiny"]["problem"] is None
    assert json.loads(read["tiny"]["json"]) == json.loads(documents.to_json(named).where("model_id = 'tiny'").first()["json"])
    assert read["tiny"]["name"] == 'a "tiny" \\ é'


@pytest.mark.parametrize("text, problem", [
    (None, "not a JSON object"), ("", "not a JSON object"), ("[1]", "not a JSON object"), ("{", "not a JSON object"), ("{}", "unsupported schema_version (none)"), ('{"model":null}', "unsupported schema_version (none)"),
    ('{"model":{"schema_version":1}}', "unsupported schema_version 1"), ('{"model":{"schema_version":"1.0"}}', "unsupported schema_version 1.0"), ('{"model":{"schema_version":"1"}}', None),
])
def test_projects_of_other_versions_are_refused(spark, text, problem):
    row = projects.unwrap(spark.createDataFrame([("x", text)], "model_id string, json string")).first()
    assert row["problem"] == problem
    assert (row["name"], row["saved_at"], row["ui"]) == ((None, None, None) if problem else ("Untitled", 0, "{}"))
    assert row["json"] == (None if problem else '{"schema_version":"1"}')


def test_unknown_formats_are_refused_before_anything_is_written(spark, tmp_path):
    plan = construction.plan(grids.authored(spark, ("tiny",)), "historical")
    with pytest.raises(KeyError, match="'svg'"):
        exports.export(plan, str(tmp_path / "out"), ["yardage", "svg"])
    assert not (tmp_path / "out").exists()
    assert exports.export(plan, str(tmp_path / "out"), ["yardage"]) == [f"{tmp_path}/out/yardage_md"]
    assert exports.export(plan, str(tmp_path / "none"), []) == []


def test_viewer_configs_of_known_models(spark):
    found = {r["model_id"]: json.loads(r["json"]) for r in exports.viewer_config(grids.authored(spark, ("checker", "mini"))).collect()}
    assert (found["checker"]["block"], found["checker"]["checker"], found["checker"]["layout"]) == (2, True, [[0, 1], [1, 0]])
    assert found["checker"]["blockTypes"] == [[["r", "w"], ["w", "r"]], [["w", "r"], ["r", "w"]]]
    assert (found["mini"]["block"], found["mini"]["checker"], found["mini"]["layout"], found["mini"]["blockTypes"]) == (1, False, None, None)
    assert found["mini"]["borders"] == [2] and found["checker"]["borders"] == []
    assert list(found["mini"]) == ["rows", "cols", "cellSize", "borders", "block", "checker", "wof", "presets", "blockTypes", "layout"]
