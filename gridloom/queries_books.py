"""Registered queries of substeps, booklets, project files, viewer configurations and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import ORACLES, register
from gridloom.plans import construction
from gridloom.queries import _PRESETS, BLOCKS_CTE, MODELS_CTE, SETS_CTE, SIZE_CTE, _inch, _models, _plain, _sql
from gridloom.queries_paths import _quarters
from gridloom.sources import booklets, documents, exports, projects, reports, scratch

_SUBS = """
cuts AS (SELECT model_id, (SELECT count(*) FROM sets s WHERE s.model_id = c.model_id) + 1 AS number, set - 1 AS ord, 'SS' || set || ': cut ' || CAST(needed AS BIGINT) || ' segments (' || sets || ' sets x ' || per_set || ' per set).' AS text FROM sets c),
sides AS (SELECT * FROM (VALUES (0, 'Sew the two side pieces, press toward the border.'), (1, 'Sew the top and bottom pieces, press toward the border.')) AS t(ord, text)),
piecing AS (SELECT model_id, type + 1 AS number, row AS ord, 'Row ' || (row + 1) || ': sew ' || array_to_string(sequence, ' ') || ' left to right.' AS text FROM block_rows
 UNION ALL SELECT model_id, type + 1, size, 'Join the ' || size || ' rows to finish the block.' FROM types)"""


def _bands_sql(steps: str) -> str:
    return f"SELECT model_id, number, s.ord, s.text FROM {steps} CROSS JOIN sides s WHERE starts_with(title, 'Attach border ')"


@register("assembly_substeps", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, SETS_CTE, _SUBS, f"strip AS ({ORACLES['assembly_strip']})", f"historical AS ({ORACLES['assembly_historical']})"],
 f"""SELECT 'strip' AS strategy, * FROM (SELECT * FROM cuts WHERE model_id IN (SELECT model_id FROM sized) UNION ALL {_bands_sql('strip')})
 UNION ALL SELECT 'historical', * FROM (SELECT * FROM piecing UNION ALL {_bands_sql('historical')})""", "number ord"))
def assembly_substeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substeps of the strip and historical plans, a row each."""
    m = _models(spark, sf_dir)

    def listed(strategy: str) -> DataFrame:
        steps = construction.assembly(construction.plan(m, strategy))
        return steps.select(F.lit(strategy).alias("strategy"), "model_id", "number", F.posexplode("substeps").alias("ord", "text"))

    return _plain(listed("strip").unionByName(listed("historical")))


_BOOK = f"""
told AS (SELECT q.*, finished_width, finished_height, perimeter + 80 AS binding_length, piece_count, difficulty, time_minutes, heuristic_label FROM quilts q JOIN finished USING (model_id) JOIN mt USING (model_id)),
subs AS (SELECT model_id, number, string_agg(text, ' ' ORDER BY ord) AS text FROM (SELECT * FROM cuts UNION ALL {_bands_sql('st')}) GROUP BY ALL),
heads(section, part, text) AS (VALUES (2, 1, 'Fabric | ID | Color | Cells'), (2, 2, 'Purchase | Length | Yards'), (3, 1, 'Fabric | Piece | Component | Quantity | Cut size | Finished size'), (4, 1, 'Set | Strips | Strip cut width | Sets to make | Segments per set | Segments needed')),
titles(section, title) AS (VALUES (1, 'Introduction'), (2, 'Fabrics'), (3, 'Cutting'), (4, 'Strip sets'), (5, 'Assembly'), (6, 'Borders'), (7, 'Binding'), (8, 'Finishing')),
book AS (
 SELECT model_id, 1 AS section, 0 AS part, 'paragraph' AS kind, 0 AS ord, name || ' finishes at ' || {_inch('finished_width')} || ' wide by ' || {_inch('finished_height')} || ' tall.' AS text FROM told
 UNION ALL SELECT model_id, 1, 0, 'paragraph', 1, 'This booklet plans the quilt with the strip strategy. The finished top has ' || piece_count || ' pieces.' FROM told
 UNION ALL SELECT model_id, 1, 0, 'paragraph', 2, 'Difficulty is ' || difficulty || ' on a ' || heuristic_label || '.' FROM told
 UNION ALL SELECT model_id, 1, 0, 'paragraph', 3, 'Estimated piecing time is ' || time_minutes || ' minutes on a ' || heuristic_label || '.' FROM told
 UNION ALL SELECT model_id, 2, 0, 'paragraph', 0, 'Palette fabrics and the yardage to buy, rounded up per fabric.' FROM told
 UNION ALL SELECT model_id, section, part, 'table', 0, text FROM told CROSS JOIN heads
 UNION ALL SELECT model_id, 2, 1, 'table', ord + 1, name || ' | ' || fabric_id || ' | ' || color || ' | ' || (SELECT count(*) FROM cells c WHERE c.model_id = f.model_id AND c.fabric_id = f.fabric_id) FROM fabrics f
 UNION ALL SELECT model_id, 2, 2, 'table', row_number() OVER (PARTITION BY model_id ORDER BY grp, ord), name || ' | ' || {_inch('length_needed')} || ' | ' || {_quarters('quarter_yards')} || ' yd' FROM pu
 UNION ALL SELECT model_id, 3, 1, 'table', line, fabric_name || ' | ' || label || ' | ' || component || ' | ' || quantity || ' | ' || cut_size || ' | ' || finished_size FROM li
 UNION ALL SELECT model_id, 4, 0, 'paragraph', 0, 'Crosscut every strip set at ' || {_inch('(cell_size + 4)')} || '.' FROM told
 UNION ALL SELECT model_id, 4, 1, 'table', set, 'SS' || set || ' | ' || array_to_string(sequence, ' ') || ' | ' || {_inch('width')} || ' | ' || sets || ' | ' || per_set || ' | ' || CAST(needed AS BIGINT) FROM sets
 UNION ALL SELECT st.model_id, 5, 1, 'numbered', number, title || '. ' || detail || coalesce(' ' || subs.text, '') FROM st LEFT JOIN subs USING (model_id, number)
 UNION ALL SELECT b.model_id, 6, 0, 'paragraph', b.ord, 'Border ' || (b.ord + 1) || ': ' || f.name || ', ' || {_inch('width')} || ' finished band on all four sides.' FROM borders b JOIN fabrics f USING (model_id, fabric_id)
 UNION ALL SELECT model_id, 6, 0, 'paragraph', 0, 'No border bands.' FROM told WHERE model_id NOT IN (SELECT model_id FROM borders)
 UNION ALL SELECT t.model_id, 7, 0, 'paragraph', 0, 'Bind with ' || f.name || '. Cut ' || {_inch('20')} || ' strips and join ' || CAST(ceil(binding_length / 336.0) AS BIGINT) || ' widths of fabric for ' || {_inch('binding_length')} || ' of binding.' FROM told t JOIN fabrics f ON f.model_id = t.model_id AND f.fabric_id = t.binding_fabric_id
 UNION ALL SELECT model_id, 8, 0, 'paragraph', 0, 'Backing: piece ' || CAST(ceil((finished_width + 64) / 336.0) AS BIGINT) || ' panel(s) for ' || {_inch('length_needed')} || ' of 42-inch fabric.' FROM told JOIN pu USING (model_id) WHERE purpose = 'backing'
 UNION ALL SELECT model_id, 8, 0, 'paragraph', 1, 'Batting: at least ' || {_inch('(finished_width + 64)')} || ' by ' || {_inch('(finished_height + 64)')} || ', the finished top plus 8" on each dimension.' FROM told
 UNION ALL SELECT model_id, 8, 0, 'paragraph', 2, 'Quilting: no motifs are authored. Quilt as desired, for example an allover edge-to-edge design.' FROM told)"""


@register("booklet_sections", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, SETS_CTE, _SUBS, f"mt AS ({ORACLES['metrics_strip']})", f"li AS ({ORACLES['cutlist_strip']})", f"pu AS ({ORACLES['purchase_strip']})", f"st AS ({ORACLES['assembly_strip']})", _BOOK],
 "SELECT model_id, section, title, part, kind, ord, text FROM book JOIN titles USING (section) WHERE model_id IN (SELECT model_id FROM sized)", "section part ord"))
def booklet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The booklets of the strip plans, tables' columns parted by bars."""
    rows = booklets.sections(construction.settled(construction.plan(_models(spark, sf_dir), "strip")))
    return _plain(rows.select("model_id", "section", "title", "part", "kind", "ord", F.array_join("cells", " | ").alias("text")))


_SPOILT = "CASE k % 4 WHEN 1 THEN 'unsupported schema_version 1.1' WHEN 2 THEN 'unsupported schema_version (none)' WHEN 3 THEN 'unsupported schema_version 1' END"


@register("project_files", _sql([MODELS_CTE, f"told AS (SELECT model_id, k, {_SPOILT} AS problem FROM seeds)"], """SELECT model_id, problem, CASE WHEN problem IS NULL THEN 'Quilt ' || k END AS name,
 CASE WHEN problem IS NULL THEN CASE WHEN k % 3 = 0 THEN 0 ELSE k * 1000 END END AS saved_at, CASE WHEN problem IS NULL THEN CASE WHEN k % 5 = 0 THEN '{}' ELSE '{"zoom":' || k || '}' END END AS ui,
 CASE WHEN problem IS NULL THEN (SELECT count(*) FROM cells c WHERE c.model_id = t.model_id) END AS cells FROM told t""", "saved_at cells"))
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autosaved documents, three of four of another version, one of these the number 1 in place of its text, read again."""
    m = _models(spark, sf_dir)
    k = F.regexp_extract("model_id", "[0-9]+", 0).cast("long")
    ui = m.quilts.where(k % 5 > 0).select("model_id", F.to_json(F.struct(k.alias("zoom"))).alias("ui"))
    saved = m.quilts.where(k % 3 > 0).select("model_id", (k * 1000).alias("saved_at"))
    made = projects.wrap(m, "editor", ui, saved)
    found = '"schema_version":"1"'
    versions = F.when(k % 4 == 1, '"schema_version":"1.1"').when(k % 4 == 2, '"version":"1"').when(k % 4 == 3, '"schema_version":1').otherwise(found)
    read = projects.unwrap(made.select("model_id", F.replace("json", F.lit(found), versions).alias("json")))
    cells = documents.cells_of(documents.parse(read.where("json is not null").select("model_id", "json"))).groupBy("model_id").agg(F.count("*").alias("cells"))
    return read.drop("json").join(cells, "model_id", "left")


_CONFIG_CTE = """
kinds AS (SELECT model_id, count(*) AS n, '[' || string_agg(rows, ',' ORDER BY type) || ']' AS txt FROM (SELECT model_id, type, '[' || string_agg('["' || array_to_string(sequence, '","') || '"]', ',' ORDER BY row) || ']' AS rows FROM block_rows GROUP BY ALL) GROUP BY model_id),
placed AS (SELECT model_id, max(size) AS size, '[' || string_agg(row, ',' ORDER BY br) || ']' AS txt, bool_and(even) AS even FROM (SELECT model_id, size, br, '[' || string_agg(type, ',' ORDER BY bc) || ']' AS row, bool_and(type = (br + bc) % 2) AS even FROM layout GROUP BY ALL) GROUP BY model_id)"""


@register("viewer_configs", _sql([MODELS_CTE, BLOCKS_CTE, SETS_CTE, _PRESETS, _CONFIG_CTE], """SELECT model_id, '{"rows":' || rows || ',"cols":' || cols || ',"cellSize":' || cell_size || ',"borders":[' || coalesce((SELECT string_agg(width, ',' ORDER BY ord) FROM borders b WHERE b.model_id = q.model_id), '')
 || '],"block":' || coalesce(size, 1) || ',"checker":' || CASE WHEN n = 2 AND even THEN 'true' ELSE 'false' END || ',"wof":336,"presets":[' || (SELECT string_agg('{"name":"' || name || '","w":' || w || ',"h":' || h || '}', ',' ORDER BY (w + h, w)) FROM presets)
 || '],"blockTypes":' || coalesce(k.txt, 'null') || ',"layout":' || coalesce(p.txt, 'null') || '}' AS json FROM quilts q LEFT JOIN kinds k USING (model_id) LEFT JOIN placed p USING (model_id)"""))
def viewer_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.viewer_config(_models(spark, sf_dir))


_YARDAGE = ORACLES["yardage_markdown"].replace(ORACLES["yardage_historical"], ORACLES["purchase_strip"]).replace("(historical strategy)", "(strip strategy)")


@register("exported_reports", _sql([f"cl AS ({ORACLES['cutlist_markdown']})", f"li AS ({ORACLES['cutlist_strip']})", f"ya AS ({_YARDAGE})", f"bo AS ({ORACLES['booklet_sections']})", f"vi AS ({ORACLES['viewer_configs']})"], """
 SELECT 'cutlist_md' AS name, model_id, length(text) AS size FROM cl UNION ALL SELECT 'cutlist_csv', model_id, count(*) FROM li GROUP BY model_id UNION ALL SELECT 'yardage_md', model_id, length(text) FROM ya
 UNION ALL SELECT 'booklet', model_id, count(*) FROM bo GROUP BY model_id UNION ALL SELECT 'viewer', model_id, length(json) FROM vi WHERE model_id IN (SELECT model_id FROM bo)""", "size"))
def exported_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats of the strip plans, written as files and read again: characters of texts, lines of tables."""
    path = scratch.folder(spark) + "/exports"
    exports.export(construction.plan(_models(spark, sf_dir), "strip"), path)

    def read(name: str, column: str | None) -> DataFrame:
        rows = reports.read_csv(spark, f"{path}/{name}") if name == "cutlist_csv" else spark.read.schema(f"model_id string, {column or 'ord'} string").json(f"{path}/{name}")
        size = F.sum(F.char_length(column)) if column else F.count("*")
        return rows.groupBy("model_id").agg(size.alias("size")).select(F.lit(name).alias("name"), "model_id", "size")

    every = read("cutlist_csv", None).unionByName(read("booklet", None))
    for name, column in (("cutlist_md", "text"), ("yardage_md", "text"), ("viewer", "json")):
        every = every.unionByName(read(name, column))
    return every
