"""Registered queries of pixel statistics, palettes, geometry and texts, each with its DuckDB equivalent.

Pixels are cut from the lineitem table, so their number follows the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import ORACLES, register, table
from gridloom.functions import report
from gridloom.functions.lengths import ceil_div
from gridloom.operators import analytics, edits, pixels, seams, structure
from gridloom.plans import construction
from gridloom.queries import _LINES, BLOCKS_CTE, EVENTS_CTE, MODELS_CTE, SETS_CTE, SIZE_CTE, _inch, _models, _plain, _sql
from gridloom.sources import documents, grids, reports, scratch

_PIXELS = """px AS (SELECT l_suppkey % 40 AS image_id, l_orderkey % 40 AS y, l_partkey % 40 AS x, l_linenumber % 4 AS strip,
 CAST(l_quantity AS DOUBLE) AS l, CAST(l_discount AS DOUBLE) * 400 AS a, CAST(l_tax AS DOUBLE) * 400 AS b FROM lineitem)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_suppkey") % 40).cast("long").alias("image_id"), (F.col("l_orderkey") % 40).cast("long").alias("y"), (F.col("l_partkey") % 40).cast("long").alias("x"), (F.col("l_linenumber") % 4).cast("long").alias("strip"),
        F.col("l_quantity").cast("double").alias("l"), (F.col("l_discount").cast("double") * 400).alias("a"), (F.col("l_tax").cast("double") * 400).alias("b"),
    )


_STRIPS = """m AS (SELECT image_id, strip, median(l) AS m_l, median(a) AS m_a, median(b) AS m_b FROM px GROUP BY ALL),
d AS (SELECT px.*, sqrt((l - m_l) * (l - m_l) + (a - m_a) * (a - m_a) + (b - m_b) * (b - m_b)) AS d FROM px JOIN m USING (image_id, strip)),
r AS (SELECT image_id, strip, median(d) AS mad, greatest(15.0, 4 * median(d)) AS radius FROM d GROUP BY ALL)"""


@register("strip_statistics", _sql([_PIXELS, _STRIPS], "SELECT m.image_id, m.strip, m_l, m_a, m_b, any_value(mad) AS mad, any_value(radius) AS radius, avg(CAST(d <= radius AS DOUBLE)) AS inliers FROM d JOIN r USING (image_id, strip) JOIN m USING (image_id, strip) GROUP BY ALL", "image_id strip", "m_l m_a m_b mad radius inliers"))
def strip_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(pixels.strip_stats(_pixels(spark, sf_dir)))


@register("background_shares", _sql([_PIXELS, "models AS (SELECT DISTINCT image_id, s AS strip, 10.0 + 8 * s AS m_l, 5.0 * s AS m_a, 4.0 * s AS m_b, 12.0 AS radius FROM px, range(4) AS t(s))"],
 "SELECT image_id, avg(CAST(EXISTS (SELECT 1 FROM models m WHERE m.image_id = px.image_id AND sqrt((l - m_l) * (l - m_l) + (a - m_a) * (a - m_a) + (b - m_b) * (b - m_b)) <= radius) AS DOUBLE)) AS share FROM px GROUP BY image_id", "image_id", "share"))
def background_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    s = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")
    models = p.select("image_id").distinct().select("image_id", s).select("image_id", (10.0 + 8 * F.col("s")).alias("m_l"), (5.0 * F.col("s")).alias("m_a"), (4.0 * F.col("s")).alias("m_b"), F.lit(12.0).alias("radius"))
    return _plain(pixels.background_share(p, models))


@register("illumination_gates", _sql(_PIXELS, "SELECT image_id, quantile_cont(l, 0.05) AS p5, quantile_cont(l, 0.95) AS p95, quantile_cont(l, 0.05) > 0 AND quantile_cont(l, 0.95) / quantile_cont(l, 0.05) > 1.2 AS uneven FROM px GROUP BY image_id", "image_id", "p5 p95"))
def illumination_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(pixels.illumination_gate(_pixels(spark, sf_dir)))


@register("illumination_fits", _sql("", "SELECT s_suppkey AS image_id, i AS term, round(CASE i WHEN 0 THEN 90.0 + s_suppkey % 7 WHEN 1 THEN s_suppkey % 5 - 2.0 WHEN 2 THEN 3.0 WHEN 3 THEN (s_suppkey % 3) * 1.5 WHEN 4 THEN -0.5 ELSE (s_nationkey % 4) * 2.0 END, 5) AS coefficient FROM supplier, range(6) AS t(i)", "image_id term", "coefficient"))
def illumination_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of known terms over 9 x 7 pixels, a supplier each, are found again."""
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = table(spark, sf_dir, "supplier").select("*", side(9).alias("x")).select("*", side(7).alias("y"))
    x, y, k = F.col("x") / F.lit(8.0), F.col("y") / F.lit(6.0), F.col("s_suppkey")
    field = 90.0 + k % 7 + (k % 5 - 2) * x + 3 * y + (k % 3) * 1.5 * x * x - 0.5 * y * y + (F.col("s_nationkey") % 4) * 2.0 * x * y
    found = pixels.illumination_fit(p.select(k.alias("image_id"), "x", "y", field.alias("l")))
    # + 0.0 makes a negative zero a plain one
    return found.select(F.col("image_id").cast("long").alias("image_id"), F.posexplode("coefficients").alias("term", "c")).select("image_id", F.col("term").cast("long").alias("term"), (F.round("c", 5) + 0.0).alias("coefficient"))


_CENTERS = """c AS (SELECT vec_id AS center_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE vec_id < 6),
e AS (SELECT vec_id AS point_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
dist AS (SELECT point_id, center_id, sqrt(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM e, c),
two AS (SELECT point_id, list(d ORDER BY d) AS ds FROM dist GROUP BY point_id)"""


@register("silhouettes", _sql(_CENTERS, "SELECT point_id % 10 AS group_id, avg((ds[2] - ds[1]) / CASE WHEN ds[2] = 0 THEN 1 ELSE ds[2] END) AS silhouette FROM two GROUP BY 1", "group_id", "silhouette"))
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centers = e.where("vec_id < 6").select(F.col("vec_id").alias("center_id"), F.col("v").alias("w"))
    near = analytics.nearest_two(e.select(F.col("vec_id").alias("point_id"), "v"), centers)
    return _plain(pixels.silhouette(near.select((F.col("point_id") % 10).cast("long").alias("group_id"), "d1", "d2")))


_MEDIANS = "cells AS (SELECT image_id, y // 10 AS r, x // 8 AS c, median(l) AS l, median(a) AS a, median(b) AS b FROM px WHERE y < 40 AND x < 40 GROUP BY ALL)"


@register("assigned_cells", _sql([_PIXELS, _MEDIANS, "centers AS (SELECT s AS center_id, 12.0 + 9 * s AS cl, 8.0 * s AS ca, 30.0 - 7 * s AS cb FROM range(4) AS t(s))",
 "dist AS (SELECT image_id, r, c, center_id, sqrt((l - cl) * (l - cl) + (a - ca) * (a - ca) + (b - cb) * (b - cb)) AS d FROM cells, centers)",
 "two AS (SELECT image_id, r, c, arg_min(center_id, (round(d, 9), center_id)) AS center_id, list(d ORDER BY d) AS ds FROM dist GROUP BY ALL)"],
 "SELECT image_id, r, c, center_id, CASE WHEN ds[2] > 0 THEN (ds[2] - ds[1]) / ds[2] ELSE 0 END AS margin FROM two", "image_id r c center_id", "margin"))
def assigned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median colors of 4 x 5 cells, and the nearest of four centers."""
    p = _pixels(spark, sf_dir)
    bounds = p.select("image_id").distinct().select("image_id", F.array(*[F.lit(8.2 * 0 + 8.0 * i + 0.3) for i in range(6)]).alias("xs"), F.array(*[F.lit(10.0 * i - 0.2) for i in range(5)]).alias("ys"))
    cells = pixels.cell_medians(p, bounds)
    s = F.col("id")
    centers = spark.range(4).select(s.alias("center_id"), F.array(12.0 + 9 * s, 8.0 * s, 30.0 - 7 * s).alias("w"))
    near = analytics.nearest_two(cells.select(F.struct("image_id", "r", "c").alias("point_id"), "v"), centers)
    return _plain(near.select("point_id.*", "center_id", "margin"))


_PALETTES = """e AS (SELECT vec_id, vec_id // 10 AS m, vec_id % 10 AS k, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS v FROM embeddings),
t AS (SELECT m, lpad(CAST(k AS VARCHAR), 2, '0') AS tid, v FROM e WHERE k < 5), r AS (SELECT m, k - 5 AS ord, 'r' || k AS rid, v FROM e WHERE k >= 5 AND k < 9),
pd AS (SELECT r.m, r.ord, rid, tid, sqrt(list_sum(list_transform(list_zip(r.v, t.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM r JOIN t USING (m)),
s0 AS (SELECT m, ord, rid, arg_min(tid, (d, tid)) AS tid FROM pd WHERE ord = 0 GROUP BY ALL)""" + "".join(
    f", s{k} AS (SELECT m, ord, rid, arg_min(tid, (d, tid)) AS tid FROM pd WHERE ord = {k} AND NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT m, tid FROM s{j}' for j in range(k))}) u WHERE u.m = pd.m AND u.tid = pd.tid) GROUP BY ALL)" for k in range(1, 4)
) + ", matched AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4)) + ")"


def _palettes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 4))
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("model_id"), (F.col("vec_id") % 10).cast("int").alias("k"), vector.alias("v"))
    truth = e.where("k < 5").select("model_id", F.col("k").alias("ord"), F.lpad(F.col("k").cast("string"), 2, "0").alias("fabric_id"), "v")
    return truth, e.where("k between 5 and 8").select("model_id", (F.col("k") - 5).alias("ord"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("fabric_id"), "v")


@register("matched_palettes", _sql(_PALETTES, "SELECT m AS model_id, matched.ord, rid AS fabric_id, matched.tid AS truth_id, d FROM matched JOIN pd USING (m, rid, tid)", "model_id ord", "d"))
def matched_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(pixels.matched_palettes(*_palettes(spark, sf_dir)))


@register("palette_fidelities", _sql([_PALETTES, "rest AS (SELECT m, tid, min(d) AS d FROM pd WHERE NOT EXISTS (SELECT 1 FROM matched x WHERE x.m = pd.m AND x.tid = pd.tid) GROUP BY ALL)"],
 "SELECT m AS model_id, max(d) AS worst FROM (SELECT m, d FROM matched JOIN pd USING (m, rid, tid) UNION ALL SELECT m, d FROM rest) GROUP BY m", "model_id", "worst"))
def palette_fidelities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(pixels.palette_fidelity(*_palettes(spark, sf_dir)))


@register("ordered_palettes", _sql("e AS (SELECT vec_id, vec_id // 10 AS image_id, embedding[1] AS light FROM embeddings)", "SELECT image_id, vec_id AS center_id, row_number() OVER (PARTITION BY image_id ORDER BY light, vec_id) - 1 AS ord FROM e", "image_id center_id ord"))
def ordered_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("image_id"), F.col("vec_id").alias("center_id"), F.col("embedding").alias("v"))
    return _plain(pixels.ordered_palette(e).select("image_id", "center_id", "ord"))


_RECTS = "q AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0, 1.0 + l_partkey % 37 AS w, 1.0 + l_orderkey % 29 AS h, CAST(l_orderkey % 50 AS DOUBLE) AS u0, CAST(l_partkey % 40 AS DOUBLE) AS v0, 1.0 + l_suppkey % 31 AS s, 1.0 + l_partkey % 23 AS t FROM lineitem)"


@register("quad_overlaps", _sql([_RECTS, "i AS (SELECT *, greatest(0, least(x0 + w, u0 + s) - greatest(x0, u0)) * greatest(0, least(y0 + h, v0 + t) - greatest(y0, v0)) AS shared FROM q)"], "SELECT l_orderkey, l_linenumber, shared / (w * h + s * t - shared) AS overlap FROM i", "l_orderkey l_linenumber", "overlap"))
def quad_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright rectangles, one of them listed against the turn of the other."""
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")

    def quad(x, y, w, h, back: bool):
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in (reversed(corners) if back else corners)])

    one, two = quad(p % 50, s % 40, p % 37 + 1, o % 29 + 1, False), quad(o % 50, p % 40, s % 31 + 1, p % 23 + 1, True)
    return _plain(table(spark, sf_dir, "lineitem").select(o.cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), pixels.quad_overlap(one, two).alias("overlap")))


@register("whole_ratios", _sql("", "SELECT event_id, CASE WHEN p > 0 AND q > 0 THEN p / q ELSE 0 END AS ratio, CASE WHEN p > 0 AND q > 0 THEN round_even(p / q, 0) >= 1 AND abs(p / q - round_even(p / q, 0)) <= 0.15 ELSE false END AS whole FROM (SELECT event_id, CAST(event_id % 83 AS DOUBLE) AS p, (event_id % 17) / 2.0 AS q FROM events)", "event_id", "ratio"))
def whole_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ratio, whole = pixels.whole_ratio(i % 83, (i % 17) / F.lit(2.0))
    return _plain(table(spark, sf_dir, "events").select(i.cast("long").alias("event_id"), ratio.alias("ratio"), whole.alias("whole")))


# --- texts ----------------------------------------------------------------------------------------------

_STAGES = "st AS (SELECT event_id, list_transform(range(6), lambda k: ((event_id * (3 + 2 * k)) % 26 + 75) / 100.0) AS s FROM events)"


@register("stage_confidences", _sql([_STAGES, "p AS (SELECT event_id, s, list_min(s) AS least, list_avg(s) AS mean, CAST(floor(list_sum(s) / 6 * 100 + 0.5) AS BIGINT) AS percent FROM st)"],
 "SELECT event_id, least, mean, CASE WHEN s[1] >= 0.95 THEN 'Very sure' WHEN s[1] >= 0.85 THEN 'Solid' WHEN s[1] >= 0.8 THEN 'Good' ELSE 'Check it' END AS word, percent, CASE WHEN percent >= 92 THEN 'very sure' WHEN percent >= 84 THEN 'solid' WHEN percent >= 78 THEN 'good - check the flags' ELSE 'needs your eye' END AS overall FROM p", "event_id percent", "least mean"))
def stage_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and mean of six stages, the first one's word and the overall word."""
    i = F.col("event_id")
    s = F.array(*[((i * (3 + 2 * k)) % 26 + 75) / F.lit(100.0) for k in range(6)])
    rows = table(spark, sf_dir, "events").select("event_id", s.alias("s")).withColumn("percent", report.overall_percent(F.col("s")))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / 6
    return _plain(rows.select("event_id", F.array_min("s").alias("least"), mean.alias("mean"), report.confidence_word(F.get("s", F.lit(0))).alias("word"), "percent", report.overall_word(F.col("percent")).alias("overall")))


@register("trusted_palettes", "SELECT event_id, (event_id % 100) / 100.0 >= 0.8 AND event_id % 9 BETWEEN 2 AND 6 AS trusted FROM events")
def trusted_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", report.trusted_palette((i % 100) / F.lit(100.0), i % 9).alias("trusted"))


_CASES = "cs AS (SELECT event_id, list_extract(['no_grid', 'non_square_repeat', 'readable_no_repeat', 'readable'], event_id % 5) AS v, list_extract(['no_quilt_found', 'weak_periodicity', 'other'], event_id % 4) AS g, event_id % 7 AS k, 20 + event_id % 30 AS cols, 4 + event_id % 11 AS size, event_id % 2 = 0 AS sized FROM events)"
_PHRASE = f"CASE WHEN k >= 1 THEN CASE WHEN sized THEN 'It repeats every ' || rtrim({_inch('(k * size)')}, '\"') || ' in.' WHEN cols // greatest(k, 1) >= 2 THEN 'It repeats about ' || (cols // greatest(k, 1)) || ' times across its width.' END END"


@register("verdict_stories", _sql(_CASES, f"""SELECT event_id, CASE v WHEN 'no_grid' THEN 'failure' WHEN 'non_square_repeat' THEN 'nonsquare' ELSE 'percent' END AS mode,
 CASE v WHEN 'no_grid' THEN 'Could not read this photo' WHEN 'non_square_repeat' THEN 'blocks repeat - squares uncertain' ELSE '' END AS pill,
 CASE WHEN v = 'no_grid' THEN CASE g WHEN 'no_quilt_found' THEN 'We could not tell the quilt apart from the background.' WHEN 'weak_periodicity' THEN 'The square pattern is too faint to read confidently.' ELSE 'The pattern did not read as a grid of squares.' END END AS reason,
 CASE WHEN v = 'readable_no_repeat' THEN 'No repeating block found - common for samplers and medallion quilts.' WHEN coalesce(v, 'readable') = 'readable' THEN {_PHRASE} END AS caption,
 CASE WHEN v = 'no_grid' THEN CASE WHEN g = 'no_quilt_found' THEN 0 ELSE 2 END END AS first_dashed FROM cs""", "first_dashed"))
def verdict_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    verdict = F.get(F.array(*[F.lit(x) for x in ("no_grid", "non_square_repeat", "readable_no_repeat", "readable")]), (i % 5 - 1).cast("int"))
    diagnosis = F.get(F.array(*[F.lit(x) for x in ("no_quilt_found", "weak_periodicity", "other")]), (i % 4 - 1).cast("int"))
    phrase = report.period_phrase(i % 7, 20 + i % 30, 4 + i % 11, i % 2 == 0)
    return _plain(table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in report.story(verdict, diagnosis, phrase).items()]))


@register("display_texts", _sql("", f"""SELECT o_orderkey, i AS eighths, format('{{:.1f}}', floor(i / 8.0 * 2.54 * 10 + 0.5) / 10) AS cm, CASE WHEN i < 720 THEN 'phone' ELSE 'desktop' END AS device, format('{{:.3f}}', i / 7.0) AS fixed,
 CASE WHEN i % 4 = 0 THEN CAST(i // 4 AS VARCHAR) WHEN i // 4 = 0 THEN list_extract(['1/4', '1/2', '3/4'], i % 4) ELSE (i // 4) || ' ' || list_extract(['1/4', '1/2', '3/4'], i % 4) END AS yards, (i + 71) // 72 AS batting_quarters,
 CASE WHEN i % 3 = 0 THEN {_inch('i')} || ' x ' || {_inch('(i + 8)')} ELSE 'Requested ' || {_inch('(i + i % 3)')} || ' x ' || {_inch('(i + 8)')} || ' - achieved ' || {_inch('i')} || ' x ' || {_inch('(i + 8)')} END AS achieved
 FROM (SELECT o_orderkey, o_custkey AS i FROM orders)""", "eighths batting_quarters"))
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_custkey")
    texts = {"cm": report.cm_shown(i), "device": report.device_class(i), "fixed": report.fixed(i / F.lit(7.0)), "yards": report.quarters_shown(i), "batting_quarters": ceil_div(i, 72), "achieved": report.achieved_shown(i + i % 3, i + 8, i, i + 8)}
    return _plain(table(spark, sf_dir, "orders").select("o_orderkey", i.alias("eighths"), *[c.alias(n) for n, c in texts.items()]))


# --- documents and reports --------------------------------------------------------------------------------


@register("documents_whole", _sql(MODELS_CTE, """SELECT model_id, 'note of ' || model_id AS notes, cell_size + 5 AS binding_strip_width, k % 3 AS motifs, CASE WHEN k % 10 > 0 THEN cell_size / 4.0 END AS density, CASE WHEN k % 2 = 0 THEN 'photo' ELSE 'authored' END AS source, (k % 5) / 4.0 AS grid_confidence, cell_size FROM quilts JOIN seeds USING (model_id)""", "binding_strip_width motifs cell_size", "density grid_confidence"))
def documents_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a document holds beside its grid comes back after writing files and reading them."""
    m = _models(spark, sf_dir)
    k = F.regexp_extract("model_id", "[0-9]+", 0).cast("int")
    motif = F.struct(F.lit("feather").alias("name"), *[F.lit(v).alias(n) for n, v in (("x", 0), ("y", 1), ("width", 8), ("height", 9))])
    q = m.quilts.withColumns({
        "notes": F.concat(F.lit("note of "), "model_id"), "binding_strip_width": F.col("cell_size") + 5, "motifs": F.array_repeat(motif, k % 3), "density": F.when(k % 10 > 0, F.col("cell_size") / 4.0),
        "source": F.when(k % 2 == 0, "photo").otherwise("authored"), "stage_confidence": F.create_map(F.lit("grid"), k % 5 / F.lit(4.0)),
    })
    path = scratch.folder(spark) + "/documents"
    documents.save(grids.Models(q, m.cells, m.fabrics, m.borders), path)
    back = documents.quilts_of(documents.parse(documents.saved(spark, path)))
    return _plain(back.select("model_id", "notes", "binding_strip_width", F.size("motifs").alias("motifs"), "density", "source", F.element_at("stage_confidence", F.lit("grid")).alias("grid_confidence"), "cell_size"))


@register("cutlist_csv", ORACLES["cutlist_strip"])
def cutlist_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut list, written as CSV files and read again."""
    path = scratch.folder(spark) + "/cutlist"
    reports.write_csv(construction.plan(_models(spark, sf_dir), "strip"), path)
    return _plain(reports.read_csv(spark, path))


_CHART = f"""chart AS (SELECT model_id, string_agg('| SS' || set || ' | ' || array_to_string(sequence, ' ') || ' | ' || {_inch('width')} || ' | ' || sets || ' | ' || per_set || ' | ' || CAST(needed AS BIGINT) || ' |', chr(10) ORDER BY set) AS rows FROM sets GROUP BY model_id),
parts AS (SELECT li.model_id, f.ord, '## ' || fabric_name || ' (' || li.fabric_id || ')' || chr(10) || chr(10) || '| Piece | Component | Source | Quantity | Cut size | Finished size |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10)
 || string_agg('| ' || label || ' | ' || component || ' | ' || CASE source WHEN 'strip_set' THEN 'strip sets' ELSE source END || ' | ' || quantity || ' | ' || cut_size || ' | ' || finished_size || ' |', chr(10) ORDER BY line) || chr(10) AS part
 FROM li JOIN fabrics f USING (model_id, fabric_id) GROUP BY li.model_id, f.ord, fabric_name, li.fabric_id),
body AS (SELECT model_id, string_agg(part, chr(10) ORDER BY ord) AS body FROM parts GROUP BY model_id)"""


@register("cutlist_markdown", _sql([MODELS_CTE, BLOCKS_CTE, SETS_CTE, f"li AS ({ORACLES['cutlist_strip']})", _CHART], f"""SELECT model_id, '# Cut list - ' || name || ' (strip strategy)' || chr(10) || chr(10) || coalesce(body
 || chr(10) || '## Strip cutting chart' || chr(10) || chr(10) || '| Set | Strips (top to bottom) | Strip cut width | Sets to make | Segments per set | Segments needed |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10)
 || chart.rows || chr(10) || chr(10) || 'Crosscut every set at ' || {_inch('(cell_size + 4)')} || '.' || chr(10), '') AS text FROM quilts LEFT JOIN body USING (model_id) LEFT JOIN chart USING (model_id) WHERE model_id IN (SELECT model_id FROM sized)"""))
def cutlist_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cut_list_markdown(construction.plan(_models(spark, sf_dir), "strip"))


@register("yardage_markdown", _sql([f"y AS ({ORACLES['yardage_historical']})"], f"""SELECT model_id, '# Yardage (historical strategy)' || chr(10) || chr(10) || '| Fabric | Length needed | Yards |' || chr(10) || '| --- | --- | --- |' || chr(10)
 || string_agg('| ' || CASE WHEN fabric_id IS NULL THEN name ELSE name || ' (' || fabric_id || ')' END || ' | ' || {_inch('length_needed')} || ' | ' || CASE WHEN quarter_yards % 4 = 0 THEN CAST(quarter_yards // 4 AS VARCHAR) WHEN quarter_yards // 4 = 0 THEN list_extract(['1/4','1/2','3/4'], quarter_yards % 4) ELSE (quarter_yards // 4) || ' ' || list_extract(['1/4','1/2','3/4'], quarter_yards % 4) END || ' yd |', chr(10) ORDER BY grp, ord)
 || chr(10) || chr(10) || 'Yardage rounds up to the nearest 1/4 yard per fabric. Backing is a dedicated line item, never a palette fabric.' || chr(10) AS text FROM y GROUP BY model_id"""))
def yardage_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.yardage_markdown(construction.yardage(construction.plan(_models(spark, sf_dir), "historical")), "historical")


@register("areas_reconciled", _sql([MODELS_CTE, SIZE_CTE, """bands_of AS (SELECT model_id, sum(2 * width * (rows * cell_size + 2 * before) + 2 * width * (cols * cell_size + 2 * before + 2 * width)) AS area
 FROM (SELECT *, coalesce(sum(width) OVER (PARTITION BY model_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM borders) JOIN quilts USING (model_id) GROUP BY model_id),
squares AS (SELECT model_id, count(*) * cell_size * cell_size AS area FROM cells JOIN quilts USING (model_id) GROUP BY model_id, cell_size)"""],
 "SELECT model_id, s.area + coalesce(b.area, 0) AS pieces_area, finished_width * finished_height AS top_area FROM finished JOIN squares s USING (model_id) LEFT JOIN bands_of b USING (model_id)", "pieces_area top_area"))
def areas_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(construction.reconciled(construction.plan(_models(spark, sf_dir), "modern")))


_JOINS = """across AS (SELECT model_id, br, count(*) AS across, string_agg(chr(CAST(65 + type AS INTEGER)), ' ' ORDER BY bc) AS letters FROM layout GROUP BY ALL), down AS (SELECT model_id, count(*) AS down FROM across GROUP BY ALL)"""


@register("assembly_historical", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, _JOINS], f"""SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY phase, ord) AS number, title, detail FROM (
 SELECT model_id, 0 AS phase, type AS ord, 'Piece Block ' || chr(CAST(65 + type AS INTEGER)) || ' (make ' || n || ')' AS title, size || ' x ' || size || ' cells of ' || {_inch('cell_size')} || ' finished.' AS detail FROM types JOIN quilts USING (model_id)
 UNION ALL SELECT model_id, 0, 0, 'Piece each cell row', 'Sew each of the ' || rows || ' rows of ' || cols || ' cells left to right.' FROM quilts WHERE model_id NOT IN (SELECT model_id FROM types)
 UNION ALL SELECT model_id, 3, br, 'Join block row ' || (br + 1) || ' of ' || down, 'Sew the ' || across || ' blocks left to right: ' || letters || '.' FROM across JOIN down USING (model_id)
 UNION ALL SELECT model_id, 4, 0, 'Join the block rows', 'Sew the ' || down || ' rows together top to bottom.' FROM down
 UNION ALL SELECT model_id, 4, 0, 'Join the cell rows', 'Sew the ' || rows || ' rows of cells together top to bottom.' FROM quilts WHERE model_id NOT IN (SELECT model_id FROM types)
 UNION ALL SELECT model_id, 5, ord, 'Attach border ' || (ord + 1), {_inch('width')} || ' finished band, all four sides.' FROM borders
 UNION ALL SELECT model_id, 6, 0, 'Prepare the binding', 'Join ' || CAST(ceil((perimeter + 80) / 336.0) AS BIGINT) || ' WOF strips of ' || {_inch('20')} || ' end to end; press in half lengthwise.' FROM finished
 UNION ALL SELECT model_id, 7, 0, 'Bind the quilt', 'Attach the binding to the quilt edge; miter the corners.' FROM quilts)""", "number"))
def assembly_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.assembly_steps(construction.plan(_models(spark, sf_dir), "historical"))


@register("model_summaries", _sql([MODELS_CTE, SIZE_CTE], "SELECT model_id, rows, cols, (SELECT count(*) FROM fabrics f WHERE f.model_id = q.model_id) AS fabric_count, finished_width, finished_height, finished_width + 64 AS batting_width, finished_height + 64 AS batting_height, CAST(ceil((finished_height + 64) / 72.0) AS BIGINT) AS batting_quarters FROM quilts q JOIN finished USING (model_id)", "rows cols fabric_count finished_width finished_height batting_width batting_height batting_quarters"))
def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(analytics.summary(_models(spark, sf_dir)))


# --- edits ------------------------------------------------------------------------------------------------


def _event_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.from_events(table(spark, sf_dir, "events"))


@register("painted_cells", _sql(EVENTS_CTE, "SELECT model_id, r, c, CASE WHEN r = c THEN 'late' WHEN r % 6 = 0 THEN 'early' ELSE fabric_id END AS fabric_id, CASE WHEN r = c OR r % 6 = 0 THEN 1.0 ELSE confidence END AS confidence FROM cells", "r c", "confidence"))
def painted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stroke over every sixth row, then one over the diagonal; one beyond the grid does nothing."""
    cells = _event_models(spark, sf_dir)
    early = cells.where("r % 6 = 0").select("model_id", F.lit(1).alias("ord"), "r", "c", F.lit("early").alias("fabric_id"))
    late = cells.where("r = c").select("model_id", F.lit(2).alias("ord"), "r", "c", F.lit("late").alias("fabric_id"))
    beyond = early.select("model_id", F.lit(3).alias("ord"), (F.col("r") + 1000).alias("r"), "c", "fabric_id")
    return _plain(edits.painted(cells, early.unionByName(late).unionByName(beyond)))


@register("edited_palettes", _sql(MODELS_CTE, "SELECT model_id, ord, fabric_id, CASE WHEN ord = 0 THEN 'New ' || fabric_id ELSE name END AS name, CASE WHEN ord = 1 THEN '#000000' ELSE color END AS color FROM fabrics UNION ALL SELECT model_id, max(ord) + 1, 'f' || count(*), 'Fabric ' || (count(*) + 1), '#b8a06a' FROM fabrics GROUP BY model_id", "ord"))
def edited_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _models(spark, sf_dir).fabrics
    changes = f.select("model_id", "fabric_id", F.when(F.col("ord") == 0, F.concat(F.lit("New "), "fabric_id")).alias("new_name"), F.when(F.col("ord") == 1, "#000000").alias("new_color"))
    return _plain(edits.with_fabric(edits.redone(f, changes)))


@register("removable_fabrics", _sql(MODELS_CTE, "SELECT model_id, fabric_id, NOT (EXISTS (SELECT 1 FROM cells c WHERE c.model_id = f.model_id AND c.fabric_id = f.fabric_id) OR EXISTS (SELECT 1 FROM borders b WHERE b.model_id = f.model_id AND b.fabric_id = f.fabric_id) OR EXISTS (SELECT 1 FROM quilts q WHERE q.model_id = f.model_id AND q.binding_fabric_id = f.fabric_id)) AS removable FROM (SELECT model_id, fabric_id FROM fabrics UNION ALL SELECT model_id, 'f' || count(*) FROM fabrics GROUP BY model_id) f"))
def removable_fabrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _models(spark, sf_dir)
    return edits.removable(grids.Models(m.quilts, m.cells, edits.with_fabric(m.fabrics), m.borders))


@register("edited_borders", _sql(MODELS_CTE, "SELECT model_id, 0 AS ord, min_by(fabric_id, ord) AS fabric_id, 16 AS width FROM fabrics GROUP BY model_id UNION ALL SELECT model_id, ord + 1, CASE WHEN width > 14 THEN (SELECT max(fabric_id) FROM fabrics f WHERE f.model_id = b.model_id) ELSE fabric_id END, CASE WHEN width > 14 THEN width + 3 ELSE width END FROM borders b", "ord width"))
def edited_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide borders change width and fabric, impossible changes are left out, a new innermost one comes, and the
    removal of a border that isn't there changes nothing."""
    m = _models(spark, sf_dir)
    most = m.fabrics.groupBy("model_id").agg(F.max("fabric_id").alias("new_fabric"))
    good = m.borders.where("width > 14").join(most, "model_id").select("model_id", "ord", (F.col("width") + 3).alias("new_width"), "new_fabric")
    bad = m.borders.where("width <= 14").select("model_id", "ord", F.lit(0).alias("new_width"), F.lit(None).cast("string").alias("new_fabric"))
    changed = edits.changed_border(m, good.unionByName(bad))
    more = edits.with_border(grids.Models(m.quilts, m.cells, m.fabrics, changed))
    return _plain(edits.without_border(more, m.quilts.select("model_id", F.lit(9).alias("ord"))))


_SEAMS = "e AS (SELECT a.model_id, a.r, a.c, 'v' AS dir FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.r = b.r AND b.c = a.c + 1 AND a.fabric_id = b.fabric_id), runs AS (SELECT model_id, r, c, c - row_number() OVER (PARTITION BY model_id, r ORDER BY c) AS run FROM e)"


@register("dragged_seams", _sql([MODELS_CTE, _SEAMS], "SELECT model_id, r, c, 'v' AS dir, 'merge' AS action FROM cells WHERE r % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.model_id = cells.model_id AND e.r = cells.r AND e.c = cells.c) UNION ALL SELECT model_id, 1, 0, 'h', 'split' FROM quilts", "r c"))
def dragged_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _models(spark, sf_dir)
    old = m.quilts.select("model_id", F.lit(1).alias("r"), F.lit(0).alias("c"), F.lit("h").alias("dir"), F.lit("split").alias("action"))
    drag = m.cells.where("r % 2 = 0").select("model_id", "r", "c", F.lit("v").alias("dir"))
    return _plain(edits.dragged(old, seams.merges(m.cells, "strip"), drag))


@register("tapped_seams", _sql([MODELS_CTE, _SEAMS], "SELECT model_id, r, c, 'v' AS dir, 'split' AS action FROM runs x WHERE r = 0 AND run = (SELECT run FROM runs y WHERE y.model_id = x.model_id AND y.r = 0 AND y.c = 0)", "r c"))
def tapped_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tap on the first cell splits the run it lies in."""
    m = _models(spark, sf_dir)
    none = grids.literal(spark, "model_id string, r int, c int, dir string, action string", []).where("false")
    taps = m.quilts.select("model_id", F.lit(0).alias("r"), F.lit(0).alias("c"))
    return _plain(edits.tapped(m.cells, none, seams.merges(m.cells, "strip"), taps))


@register("resized_models", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, _LINES, """want AS (SELECT q.model_id, rows, cols, cell_size, band, CASE WHEN (SELECT count(*) FROM types t WHERE t.model_id = q.model_id) > 1 THEN (SELECT max(size) FROM types t WHERE t.model_id = q.model_id) ELSE 1 END AS block, finished_width + 100 AS w FROM quilts q JOIN finished USING (model_id)),
 fit AS (SELECT *, block * greatest(1, (greatest(w - 2 * band, 0) + block * cell_size // 2) // (block * cell_size)) AS nc FROM want),
 least_of AS (SELECT model_id, coalesce((SELECT min(p) FROM range(1, 60) AS t(p) WHERE p < n AND NOT EXISTS (SELECT 1 FROM lines a JOIN lines b ON a.model_id = b.model_id AND a.axis = b.axis AND a.i = b.i + p
 WHERE a.model_id = x.model_id AND a.axis = 'col' AND a.sig <> b.sig)), n) AS period FROM (SELECT model_id, count(*) AS n FROM lines WHERE axis = 'col' GROUP BY ALL) x)"""],
 "SELECT f.model_id, c.r, x AS c, c.fabric_id FROM fit f JOIN least_of USING (model_id), range(200) AS t(x), cells c WHERE x < nc AND c.model_id = f.model_id AND c.c = CASE WHEN x < cols THEN x ELSE x % period END", "r c"))
def resized_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 eighths are added to the width of each model, in whole blocks or single squares."""
    m = _models(spark, sf_dir)
    bands = m.borders.groupBy("model_id").agg(F.sum("width").alias("band"))
    wide = m.quilts.join(bands, "model_id", "left").select("model_id", (F.col("cols") * F.col("cell_size") + 2 * F.coalesce("band", F.lit(0)) + 100).cast("int").alias("target_width"), F.lit(None).cast("int").alias("target_height"))
    return _plain(edits.resized(m, wide).select("model_id", "r", "c", "fabric_id"))


@register("viewer_yardages", _sql(MODELS_CTE, "SELECT f.model_id, f.fabric_id, count(c.r) AS cells, CAST(ceil(ceil(count(c.r) * (cell_size + 4) * (cell_size + 4) / 336.0) / 72.0) AS BIGINT) AS quarter_yards FROM fabrics f JOIN quilts USING (model_id) LEFT JOIN cells c ON c.model_id = f.model_id AND c.fabric_id = f.fabric_id GROUP BY f.model_id, f.fabric_id, cell_size", "cells quarter_yards"))
def viewer_yardages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(edits.viewer_yardage(_models(spark, sf_dir)))


@register("tiled_grids", _sql(EVENTS_CTE, "SELECT d.model_id, r2 AS r, c2 AS c, fabric_id FROM dims d, range(30) AS a(r2), range(26) AS b(c2), cells WHERE r2 < rows + 5 AND c2 < cols + 6 AND cells.model_id = d.model_id AND cells.r = r2 % rows AND cells.c = c2 % cols", "r c"))
def tiled_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _event_models(spark, sf_dir)
    larger = structure.dims(cells).select("model_id", (F.col("rows") + 5).alias("new_rows"), (F.col("cols") + 6).alias("new_cols"))
    return _plain(edits.tiled(cells, larger))


@register("flat_rectangles", _sql([MODELS_CTE, SIZE_CTE], """SELECT model_id, layer, CAST(floor(x * 10 / 8.0 + 0.5) AS BIGINT) AS x0, CAST(floor(y * 10 / 8.0 + 0.5) AS BIGINT) AS y0, CAST(floor(u * 10 / 8.0 + 0.5) AS BIGINT) - 1 AS x1, CAST(floor(v * 10 / 8.0 + 0.5) AS BIGINT) - 1 AS y1, color FROM (
 SELECT model_id, -1 AS layer, band + c * cell_size AS x, band + r * cell_size AS y, band + (c + 1) * cell_size AS u, band + (r + 1) * cell_size AS v, color FROM cells JOIN quilts USING (model_id) JOIN finished USING (model_id) JOIN fabrics USING (model_id, fabric_id)
 UNION ALL SELECT model_id, layer, inset, inset, finished_width - inset, finished_height - inset, color FROM (SELECT *, row_number() OVER o - 1 AS layer, coalesce(sum(width) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inset FROM borders WINDOW o AS (PARTITION BY model_id ORDER BY ord DESC)) b
 JOIN finished USING (model_id) JOIN fabrics USING (model_id, fabric_id))""", "layer x0 y0 x1 y1"))
def flat_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(edits.rectangles(_models(spark, sf_dir)))
