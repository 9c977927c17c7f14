"""Registered queries of pointer paths, seams, comparisons, borders, settings and picture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import register, table
from gridloom.functions import report
from gridloom.operators import analytics, paths, seams, structure
from gridloom.plans import construction
from gridloom.queries import _EDGES, EVENTS_CTE, MODELS_CTE, SIZE_CTE, _inch, _models, _plain, _sql
from gridloom.queries_images import _LINES_OF, _RASTER, SCALE, _lines_of
from gridloom.sources import grids, pictures, reports, scratch

# --- pointer paths ------------------------------------------------------------------------------------------

_WALKS = """
samples AS (SELECT user_id AS path_id, event_id AS place, event_id * 7 % 23 AS r, event_id * event_id % 19 AS c FROM events),
ends AS (SELECT path_id, place, r, c, lead(r) OVER o AS r1, lead(c) OVER o AS c1, lag(r) OVER o AS b FROM samples WINDOW o AS (PARTITION BY path_id ORDER BY place)),
segments AS (SELECT path_id, place, r, c, coalesce(r1, r) AS r1, coalesce(c1, c) AS c1 FROM ends WHERE r1 IS NOT NULL OR b IS NULL),
crossings AS (SELECT path_id, place, r, c, i, 0 AS dr, CAST(sign(c1 - c) AS BIGINT) AS dc, (2 * i + 1) * abs(r1 - r) AS t FROM segments, range(30) AS t(i) WHERE i < abs(c1 - c)
 UNION ALL SELECT path_id, place, r, c, i, CAST(sign(r1 - r) AS BIGINT), 0, (2 * i + 1) * abs(c1 - c) FROM segments, range(30) AS t(i) WHERE i < abs(r1 - r)),
steps AS (SELECT path_id, place, row_number() OVER o AS step, r + sum(dr) OVER o AS r, c + sum(dc) OVER o AS c FROM crossings WINDOW o AS (PARTITION BY path_id, place ORDER BY t, abs(dr), i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
walk AS (SELECT path_id, place, 0 AS step, r, c FROM segments UNION ALL SELECT * FROM steps)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), e.alias("place"), (e * 7 % 23).alias("r"), (e * e % 19).alias("c"))


@register("stroke_cells", _sql(_WALKS, "SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY spot) - 1 AS ord, r, c FROM (SELECT path_id, r, c, min((place, step)) AS spot FROM walk GROUP BY ALL)", "path_id ord r c"))
def stroke_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each user's pointer passes, in order."""
    return _plain(paths.strokes(_samples(spark, sf_dir)))


@register("stroke_edges", _sql([_WALKS, """pairs AS (SELECT *, lag(r) OVER o AS br, lag(c) OVER o AS bc FROM walk WINDOW o AS (PARTITION BY path_id ORDER BY place, step)),
met AS (SELECT path_id, least(r, br) AS r, least(c, bc) AS c, CASE WHEN r = br THEN 'v' ELSE 'h' END AS dir, min((place, step)) AS spot FROM pairs WHERE abs(r - br) + abs(c - bc) = 1 GROUP BY ALL)"""],
 "SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY spot) - 1 AS ord, r, c, dir FROM met", "path_id ord r c"))
def stroke_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(paths.crossed(_samples(spark, sf_dir)))


# --- seams ----------------------------------------------------------------------------------------------------


@register("modern_claims")
def modern_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in reading order, of the models and of the events' grids."""
    cells = _models(spark, sf_dir).cells.unionByName(grids.from_events(table(spark, sf_dir, "events")))
    return seams.claims(cells)


@register("modern_seams")
def modern_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _models(spark, sf_dir).cells
    return _plain(seams.estimate(cells, seams.merges(cells, "modern")))


@register("fixed_merges", _sql([MODELS_CTE, _EDGES], "SELECT model_id, r, c, dir FROM edges WHERE same AND (dir = 'v' AND (r + c) % 3 <> 0 OR dir = 'h' AND (r + c) % 4 = 0)", "r c"))
def fixed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strip merges, some split again, and others added, of which those of two fabrics are not valid."""
    cells = _models(spark, sf_dir).cells
    spot = F.col("r") + F.col("c")
    splits = cells.where(spot % 3 == 0).select("model_id", "r", "c", F.lit("v").alias("dir"), F.lit("split").alias("action"))
    merges = cells.where(spot % 4 == 0).select("model_id", "r", "c", F.lit("h").alias("dir"), F.lit("merge").alias("action"))
    return _plain(seams.merges(cells, "strip", splits.unionByName(merges)))


# --- comparison and borders --------------------------------------------------------------------------------------

_SEEN = """rgb AS (SELECT model_id, ord, fabric_id, [CAST('0x' || substr(color, 2, 2) AS BIGINT), CAST('0x' || substr(color, 4, 2) AS BIGINT), CAST('0x' || substr(color, 6, 2) AS BIGINT)] AS v FROM fabrics),
near AS (SELECT r.model_id, r.fabric_id AS seen, arg_min(t.fabric_id, list_sum(list_transform(list_zip(list_transform(r.v, lambda x: x - 3), t.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS truth FROM rgb r JOIN rgb t USING (model_id) GROUP BY ALL),
seen AS (SELECT model_id, r, c, fabric_id AS truth, CASE WHEN (r * 7 + c) % 10 = 0 THEN 'f0' ELSE fabric_id END AS seen FROM cells)"""


@register("compared_models", _sql([MODELS_CTE, _SEEN], """SELECT s.model_id, count(*) AS compared, avg(CAST(s.truth = n.truth AS DOUBLE)) AS accuracy, true AS dims_match, (SELECT count(*) FROM fabrics f WHERE f.model_id = s.model_id) AS matched,
 round(((CAST(substr(s.model_id, 2) AS BIGINT)) % 10) / 10.0, 9) AS grid_confidence FROM seen s JOIN near n ON n.model_id = s.model_id AND n.seen = s.seen GROUP BY s.model_id""", "compared matched", "accuracy grid_confidence"))
def compared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models against themselves with renamed, slightly darker fabrics and some cells of another fabric."""
    m = _models(spark, sf_dir)

    def renamed(c: str):
        return F.concat(F.lit("seen "), F.col(c))

    darker = F.format_string("#%02x%02x%02x", *[(F.conv(F.substring("color", i, 2), 16, 10).cast("int") - 3) for i in (2, 4, 6)])
    fabrics = m.fabrics.withColumn("color", darker).withColumn("fabric_id", renamed("fabric_id"))
    wrong = (F.col("r") * 7 + F.col("c")) % 10 == 0
    cells = m.cells.withColumn("fabric_id", F.when(wrong, F.lit("seen f0")).otherwise(renamed("fabric_id")))
    quilts = m.quilts.withColumn("stage_confidence", F.create_map(F.lit("grid"), F.regexp_extract("model_id", "[0-9]+", 0).cast("int") % 10 / F.lit(10.0)))
    found = analytics.compared_models(m, grids.Models(quilts, cells, fabrics, m.borders))
    return _plain(found.select("model_id", "compared", "accuracy", "dims_match", F.size("mapping").alias("matched"), F.element_at("stages", F.lit("grid")).alias("grid_confidence")))


_STRIPS = """strips AS (
 SELECT model_id, 'left' AS side, c AS i, cols AS extent, fabric_id FROM framed JOIN fd USING (model_id) UNION ALL SELECT model_id, 'right', cols - 1 - c, cols, fabric_id FROM framed JOIN fd USING (model_id)
 UNION ALL SELECT model_id, 'top', r, rows, fabric_id FROM framed JOIN fd USING (model_id) UNION ALL SELECT model_id, 'bottom', rows - 1 - r, rows, fabric_id FROM framed JOIN fd USING (model_id)),
counts AS (SELECT model_id, side, i, fabric_id, count(*) AS n FROM strips WHERE i < extent // 4 GROUP BY ALL),
scores AS (SELECT model_id, side, i, arg_min(fabric_id, (-n, fabric_id)) AS fabric_id, least(1.0, max(n) / greatest(1, sum(n) - floor(0.15 * sum(n)))) AS score FROM counts GROUP BY model_id, side, i),
lead_strips AS (SELECT * FROM (SELECT *, min(CASE WHEN score < 0.93 THEN i END) OVER (PARTITION BY model_id, side) AS stop FROM scores) WHERE stop IS NULL OR i < stop),
told AS (SELECT d.model_id, rows, cols, (SELECT count(*) FROM lead_strips s WHERE s.model_id = d.model_id AND side = 'left') AS l, (SELECT count(*) FROM lead_strips s WHERE s.model_id = d.model_id AND side = 'right') AS r,
 (SELECT count(*) FROM lead_strips s WHERE s.model_id = d.model_id AND side = 'top') AS t, (SELECT count(*) FROM lead_strips s WHERE s.model_id = d.model_id AND side = 'bottom') AS b,
 (SELECT arg_min(fabric_id, (-n, fabric_id)) FROM (SELECT fabric_id, count(*) AS n FROM lead_strips s WHERE s.model_id = d.model_id GROUP BY fabric_id)) AS fabric_id, (SELECT avg(score) FROM lead_strips s WHERE s.model_id = d.model_id) AS confidence FROM fd d)"""


@register("found_borders", _sql([MODELS_CTE, """framed AS (SELECT model_id, r, c, CASE WHEN k % 2 = 0 AND (r < 1 + k % 3 OR c = 0 OR r = rows - 1) THEN 'f1' ELSE fabric_id END AS fabric_id FROM cells JOIN seeds USING (model_id) JOIN dims USING (model_id)),
fd AS (SELECT * FROM dims)""", _STRIPS], "SELECT model_id, l AS left, r AS right, t AS top, b AS bottom, 7.5 * l AS left_px, 7.5 * r AS right_px, 6.25 * t AS top_px, 6.25 * b AS bottom_px, fabric_id, coalesce(confidence, 1.0) AS confidence FROM told", '"left" "right" top bottom', "left_px right_px top_px bottom_px confidence"))
def found_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other model gets a frame of one fabric on three sides."""
    m = _models(spark, sf_dir)
    k = F.regexp_extract("model_id", "[0-9]+", 0).cast("int")
    size = structure.dims(m.cells)
    framed = (k % 2 == 0) & ((F.col("r") < 1 + k % 3) | (F.col("c") == 0) | (F.col("r") == F.col("rows") - 1))
    cells = m.cells.join(size, "model_id").withColumn("fabric_id", F.when(framed, "f1").otherwise(F.col("fabric_id"))).select(*m.cells.columns)
    edges = size.select("model_id", F.transform(F.sequence(F.lit(0), F.col("cols").cast("int")), lambda i: i * 7.5).alias("xs"), F.transform(F.sequence(F.lit(0), F.col("rows").cast("int")), lambda i: i * 6.25).alias("ys"))
    return _plain(analytics.borders_found(cells, edges))


# --- settings and files --------------------------------------------------------------------------------------------


@register("settings_json", _sql(MODELS_CTE, """SELECT model_id, '{"center":{"rows":' || rows || ',"cols":' || cols || ',"cell_size":' || cell_size || '},"borders":[' || coalesce((SELECT string_agg('{"fabric_id":"' || fabric_id || '","width":' || width || '}', ',' ORDER BY ord) FROM borders b WHERE b.model_id = q.model_id), '') || ']}' AS json FROM quilts q"""))
def settings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _models(spark, sf_dir)
    bands = m.borders.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fabric_id", "width"))), lambda b: F.struct(b["fabric_id"].alias("fabric_id"), b["width"].alias("width"))).alias("bands"))
    none = F.array().cast("array<struct<fabric_id: string, width: int>>")
    q = m.quilts.join(bands, "model_id", "left")
    return q.select("model_id", report.settings_json(F.col("rows"), F.col("cols"), F.col("cell_size"), F.coalesce("bands", none)).alias("json"))


def _quarters(x: str) -> str:
    part = f"list_extract(['1/4','1/2','3/4'], CAST({x} % 4 AS BIGINT))"
    return f"CASE WHEN {x} % 4 = 0 THEN CAST(CAST({x} // 4 AS BIGINT) AS VARCHAR) WHEN {x} // 4 = 0 THEN {part} ELSE CAST({x} // 4 AS BIGINT) || ' ' || {part} END"


@register("settings_summaries", _sql([MODELS_CTE, SIZE_CTE, """used AS (SELECT model_id, fabric_id, sum(area) AS area FROM (
 SELECT model_id, fabric_id, count(*) * (cell_size + 4) * (cell_size + 4) AS area FROM cells JOIN quilts USING (model_id) GROUP BY model_id, fabric_id, cell_size
 UNION ALL SELECT model_id, fabric_id, 2 * ((width + 4) * (rows * cell_size + 2 * before + 4) + (cols * cell_size + 2 * before + 2 * width + 4) * (width + 4))
 FROM (SELECT *, coalesce(sum(width) OVER (PARTITION BY model_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM borders) JOIN quilts USING (model_id)) GROUP BY ALL),
bought AS (SELECT model_id, ord, name, CAST(ceil(ceil(area / 336.0) / 72.0) AS BIGINT) AS n FROM used JOIN fabrics USING (model_id, fabric_id)),
rest AS (SELECT model_id, CAST(ceil(ceil(ceil((perimeter + 80) / 336.0) * 20 * 336 / 336.0) / 72.0) AS BIGINT) AS binding, CAST(ceil(ceil((finished_width + 64) / 336.0) * (finished_height + 64) / 72.0) AS BIGINT) AS backing FROM finished)"""],
 f"""SELECT model_id, 'Pattern — ' || q.name || chr(10) || 'Finished size: ' || {_inch('finished_width')} || ' × ' || {_inch('finished_height')} || chr(10) || 'Squares: ' || cols || ' × ' || rows || ' at ' || {_inch('cell_size')} || ' each (' || rows * cols || ' squares)' || chr(10)
 || 'Borders: ' || coalesce((SELECT string_agg({_inch('width')}, ' + ' ORDER BY ord) FROM borders b WHERE b.model_id = q.model_id), '') || chr(10) || 'Fabric yardage:' || chr(10)
 || (SELECT string_agg('  - ' || name || ': ' || {_quarters('n')} || ' yd', chr(10) ORDER BY ord) FROM bought b WHERE b.model_id = q.model_id) || chr(10) || 'Binding: ' || {_quarters('binding')} || ' yd' || chr(10) || 'Backing: ' || {_quarters('backing')} || ' yd' || chr(10)
 || 'Batting: ' || {_inch('(finished_width + 64)')} || ' × ' || {_inch('(finished_height + 64)')} || ' (' || {_quarters('((finished_height + 64 + 71) // 72)')} || ' yd)' AS text FROM quilts q JOIN finished USING (model_id) JOIN rest USING (model_id)"""))
def settings_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = construction.plan(_models(spark, sf_dir), "historical")
    return reports.settings_summary(p, construction.purchase(p))


@register("all_plans")
def all_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every strategy, a row a model and strategy."""
    return construction.every_plan(_models(spark, sf_dir))


@register("picture_files", _sql([MODELS_CTE, SIZE_CTE, _RASTER], _LINES_OF.format("flat"), "y n red green blue"))
def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat pictures, written as PNG files with their truths beside them and scanned again."""
    m = _models(spark, sf_dir)
    path = scratch.folder(spark) + "/pictures"
    pictures.save(pictures.raster(m, SCALE), path, pictures.truths(m, SCALE)).write.parquet(f"{path}_written")
    return _plain(_lines_of(pictures.scan(spark, path)))
