"""Registered queries of the grid operators, each with its DuckDB equivalent where SQL has one.

Models are made from the suppliers, grids are cut from the events; both sides build them by the same rules, and
their number follows the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import register, table
from gridloom.functions import colors, lengths, screen
from gridloom.operators import analytics, profiles, seams, sizing, structure
from gridloom.plans import construction
from gridloom.sources import documents, grids


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long and fractions rounded to nine digits, so that engines agree."""
    def one(name: str, kind: str):
        if kind in ("tinyint", "smallint", "int"):
            return F.col(name).cast("long").alias(name)
        return F.round(name, 9).alias(name) if kind == "double" else F.col(name)

    return df.select(*[one(*x) for x in df.dtypes])


def _models(spark: SparkSession, sf_dir: str) -> grids.Models:
    return grids.from_suppliers(table(spark, sf_dir, "supplier"))


def _values(rows: list[tuple]) -> str:
    def shown(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(shown(v) for v in r) + ")" for r in rows)


MODELS_CTE = """
seeds AS (SELECT 's' || s_suppkey AS model_id, s_suppkey AS k, CAST(coalesce(s_nationkey, 0) AS BIGINT) AS n, s_suppkey % 4 + 2 AS p, s_suppkey % 3 + 2 AS across,
 (s_suppkey // 3) % 4 + 2 AS down, (s_suppkey // 2) % 4 + 2 AS nf FROM supplier WHERE s_suppkey IS NOT NULL),
quilts AS (SELECT model_id, 'Quilt ' || k AS name, p * down + CAST(k % 7 = 0 AS BIGINT) AS rows, p * across AS cols, n % 9 * 2 + 8 AS cell_size, 'f' || n % nf AS binding_fabric_id FROM seeds),
fabrics AS (SELECT model_id, i AS ord, 'f' || i AS fabric_id, 'Fabric ' || (i + 1) AS name, printf('#%02x%02x%02x', i * 50 + 40 + k % 13, i * 45 + 50 + n, 220 - i * 50 + k % 29) AS color FROM seeds, range(5) AS t(i) WHERE i < nf),
borders AS (SELECT model_id, i AS ord, 'f' || i % nf AS fabric_id, (k + i * 5) % 12 * 2 + 8 AS width FROM seeds, range(2) AS t(i) WHERE i < k % 3),
cells AS (
  SELECT model_id, y AS r, x AS c, ((k * 31 + y * 17 + x * 7) % 100) / 100.0 AS confidence,
         'f' || ((y % p) * (k % 3 + 1) + (x % p) * 2 + (y // p + x // p) % 2 * (n % 2 + 1) + (y % p) * (x % p) % 3) % nf AS fabric_id
  FROM seeds JOIN quilts USING (model_id), range(26) AS a(y), range(20) AS b(x) WHERE y < rows AND x < cols
),
dims AS (SELECT model_id, max(r) + 1 AS rows, max(c) + 1 AS cols FROM cells GROUP BY model_id)"""
EVENTS_CTE = """
cells AS (
  SELECT CAST(event_id // 500 AS VARCHAR) AS model_id, (event_id % 500) // 20 AS r, event_id % 20 AS c, event_type AS fabric_id,
         ((event_id * 37) % 100) / 100.0 AS confidence FROM events
),
dims AS (SELECT model_id, max(r) + 1 AS rows, max(c) + 1 AS cols FROM cells GROUP BY model_id)"""
BLOCKS_CTE = """
steps AS (SELECT model_id, p FROM dims, range(2, CAST(least(rows, cols) AS BIGINT) + 1) AS t(p) WHERE rows % p = 0 AND cols % p = 0),
blocks AS (SELECT model_id, p, r // p AS br, c // p AS bc, string_agg(fabric_id, ',' ORDER BY r % p, c % p) AS sig FROM cells JOIN steps USING (model_id) GROUP BY ALL),
sized AS (SELECT model_id, min(p) AS p FROM (SELECT model_id, p, count(DISTINCT sig) AS n FROM blocks GROUP BY ALL) WHERE n <= 8 GROUP BY model_id),
chosen AS (SELECT blocks.* FROM blocks JOIN sized USING (model_id, p)),
numbered AS (SELECT model_id, sig, row_number() OVER (PARTITION BY model_id ORDER BY min(br * 100000 + bc)) - 1 AS type FROM chosen GROUP BY model_id, sig),
layout AS (SELECT model_id, p AS size, br, bc, type, sig FROM chosen JOIN numbered USING (model_id, sig)),
types AS (SELECT model_id, size, type, sig, count(*) AS n FROM layout GROUP BY ALL)"""
SETS_CTE = """
block_rows AS (SELECT model_id, type, n, i AS row, list_slice(string_split(sig, ','), i * size + 1, (i + 1) * size) AS sequence FROM types, range(size) AS t(i)),
sets AS (
  SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY min(type * 1000 + row)) AS set, sequence, cell_size + 4 AS width, sum(n) AS needed, 336 // (cell_size + 4) AS per_set,
         CAST(ceil(sum(n) / (336 // (cell_size + 4))) AS BIGINT) AS sets
  FROM block_rows JOIN quilts USING (model_id) GROUP BY model_id, sequence, cell_size
)"""
SIZE_CTE = """
bands AS (SELECT q.model_id, coalesce(sum(width), 0) AS band FROM quilts q LEFT JOIN borders b USING (model_id) GROUP BY q.model_id),
finished AS (
  SELECT model_id, band, cols * cell_size + 2 * band AS finished_width, rows * cell_size + 2 * band AS finished_height,
         2 * (cols * cell_size + rows * cell_size + 4 * band) AS perimeter FROM quilts JOIN bands USING (model_id)
)"""


def _inch(x: str) -> str:
    """DuckDB text for a length as a mixed fraction."""
    a = f"abs({x})"
    part = f"list_extract(['1/8','1/4','3/8','1/2','5/8','3/4','7/8'], CAST({a} % 8 AS BIGINT))"
    body = f"CASE WHEN {a} % 8 = 0 THEN CAST({a} // 8 AS VARCHAR) WHEN {a} // 8 = 0 THEN {part} ELSE CAST({a} // 8 AS VARCHAR) || ' ' || {part} END"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {body} || '\"')"


def _sql(ctes: str | list[str], body: str, longs: str = "", doubles: str = "") -> str:
    """A query over CTEs whose named columns are brought to BIGINT, or to nine digits."""
    ctes = ctes if isinstance(ctes, str) else ",".join(ctes)
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in doubles.split()]
    star = f"* REPLACE ({', '.join(casts)})" if casts else "*"
    return f"WITH {ctes} SELECT {star} FROM ({body})" if ctes else f"SELECT {star} FROM ({body})"


# --- sources ------------------------------------------------------------------------------------------


@register("grid_generate", _sql(MODELS_CTE, "SELECT model_id, r, c, fabric_id FROM cells", "r c"))
def grid_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_models(spark, sf_dir).cells.select("model_id", "r", "c", "fabric_id"))


@register("grid_blank", _sql(MODELS_CTE, "SELECT model_id, i // 18 AS r, i % 18 AS c, CASE WHEN k % 100 >= 80 AND nf BETWEEN 2 AND 6 THEN 'f0' ELSE 'bg' END AS fabric_id FROM seeds, range(432) AS t(i)", "r c"))
def grid_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank grid a model, of the recovered palette's first fabric where that palette is trusted."""
    m = _models(spark, sf_dir)
    trust = m.quilts.select("model_id", (F.regexp_extract("model_id", "[0-9]+", 0).cast("long") % 100 / F.lit(100.0)).alias("confidence"))
    return _plain(grids.blanks(trust, m.fabrics).cells.select("model_id", "r", "c", "fabric_id"))


@register("grid_from_events", _sql(EVENTS_CTE, "SELECT model_id, r, c, fabric_id, confidence FROM cells", "r c", "confidence"))
def grid_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(grids.from_events(table(spark, sf_dir, "events")))


@register("documents_round_trip", _sql(MODELS_CTE, "SELECT model_id, r, c, fabric_id FROM cells", "r c"))
def documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models are written as JSON documents and read again."""
    models = _models(spark, sf_dir)
    return _plain(documents.cells_of(documents.parse(documents.to_json(models))).select("model_id", "r", "c", "fabric_id"))


_DEFECTS = "CASE k % 5 WHEN 0 THEN 'missing schema_version' WHEN 1 THEN 'unsupported schema_version' WHEN 2 THEN 'not a JSON object' END"


@register("documents_rejected", _sql(MODELS_CTE, f"SELECT model_id, {_DEFECTS} AS problem FROM seeds"))
def documents_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the models, three of five spoilt, one of five wrapped by an application."""
    made = documents.to_json(_models(spark, sf_dir))
    defect = F.regexp_extract("model_id", "[0-9]+", 0).cast("long") % 5
    version = '"schema_version":"[^"]*",?'
    spoilt = F.when(defect == 0, F.regexp_replace("json", version, "")).when(defect == 1, F.regexp_replace("json", version, '"schema_version":"2",'))
    spoilt = spoilt.when(defect == 2, F.substring("json", 2, 20)).when(defect == 3, F.concat(F.lit('{"app":"editor","model":'), "json", F.lit("}"))).otherwise(F.col("json"))
    return documents.parse(made.select("model_id", spoilt.alias("json"))).select("model_id", "problem")


# --- scalar functions -----------------------------------------------------------------------------------


@register("length_shown", _sql("", f"SELECT o_orderkey, CAST(o_custkey AS BIGINT) - 100 AS eighths, {_inch('(CAST(o_custkey AS BIGINT) - 100)')} AS shown FROM orders", "o_orderkey eighths"))
def length_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_custkey") - 100).alias("eighths")
    return table(spark, sf_dir, "orders").select("o_orderkey", x, lengths.shown(F.col("o_custkey") - 100).alias("shown"))


@register("part_size_shown", _sql("", f"SELECT p_partkey, {_inch('p_size')} AS shown, CASE WHEN p_size // 4 = 0 THEN '' ELSE CAST(p_size // 4 AS VARCHAR) END AS whole FROM part", "p_partkey"))
def part_size_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    whole = lengths.int_div(F.col("p_size"), 4)
    return p.select("p_partkey", lengths.shown(F.col("p_size")).alias("shown"), F.when(whole == 0, "").otherwise(whole.cast("string")).alias("whole"))


#: Ways to write a length of w inches and n fractions, the text and what it means in eighths (null: no length).
_WRITTEN = [
    ("w", "w * 8"), ("w || '.5'", "w * 8 + 4"), ("w || '½'", "w * 8 + 4"), ("w || ' 1/2'", "w * 8 + 4"), ("'3/4'", "6"), ("w || ' ' || n || '/8\"'", "w * 8 + n"), ("w || ' in'", "w * 8"), ("w || ' inches'", "w * 8"),
    ("'⅞'", "7"), ("w || '.3'", None), ("w || ' 2/3'", None), ("'abc'", None), ("''", None), ("'-' || w", None), ("n || '/0'", None), ("w || '.125'", "w * 8 + 1"), ("w || ' ¼'", "w * 8 + 2"),
]
_ROUNDED = [("w || '.3'", "w * 8 + 2"), ("w || ' 2/3'", "w * 8 + 5"), ("w || '.05'", "w * 8"), ("w || '.0625'", "w * 8 + 1"), ("w", "w * 8"), ("'x'", None), ("n || '/3 in'", "floor(n * 8 / 3.0 + 0.5)")]


def _written_sql(ways: list[tuple[str, str | None]]) -> str:
    def chosen(i: int, kind: str) -> str:
        return f"CASE p_partkey % {len(ways)} " + " ".join(f"WHEN {k} THEN CAST({x[i]} AS {kind})" for k, x in enumerate(ways) if x[i] is not None) + " END"

    return f"SELECT p_partkey, {chosen(0, 'VARCHAR')} AS txt, {chosen(1, 'BIGINT')} AS eighths FROM (SELECT p_partkey, p_size AS w, p_partkey % 7 + 1 AS n FROM part)"


def _written(spark: SparkSession, sf_dir: str, ways: list[tuple[str, str | None]]) -> DataFrame:
    """Each part's size as a length, written in turn in each of these ways."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 7 + 1).alias("n"))
    texts = F.array(*[F.expr(f"cast({text} as string)") for text, _ in ways])
    return p.select("p_partkey", F.get(texts, (F.col("p_partkey") % len(ways)).cast("int")).alias("txt"))


@register("length_parsed", _written_sql(_WRITTEN))
def length_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_written(spark, sf_dir, _WRITTEN).select("p_partkey", "txt", lengths.parsed(F.col("txt")).alias("eighths")))


@register("length_parsed_rounded", _written_sql(_ROUNDED))
def length_parsed_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_written(spark, sf_dir, _ROUNDED).select("p_partkey", "txt", lengths.parsed_rounded(F.col("txt")).alias("eighths")))


@register("integer_arithmetic", _sql("", "SELECT o_orderkey, i AS x, (i + 3) // 7 AS half_up, (i + 6) // 7 AS ceiling, greatest(160, least(1120, ((i + 1) // 2) * 2)) AS quarter, CAST(floor(i * 8 / 2.54 + 0.5) AS BIGINT) AS cm FROM (SELECT o_orderkey, o_custkey AS i FROM orders)", "x half_up ceiling quarter cm"))
def integer_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_custkey")
    return _plain(table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), lengths.half_up_div(x, 7).alias("half_up"), lengths.ceil_div(x, 7).alias("ceiling"), lengths.quarter_inch(x).alias("quarter"), lengths.from_cm(x).alias("cm")))


@register("yards_shown", """SELECT p_partkey, i AS quarters, CASE WHEN i // 4 = 0 AND i % 4 > 0 THEN list_extract(['1/4','1/2','3/4'], i % 4) WHEN i % 4 > 0 THEN (i // 4) || ' ' || list_extract(['1/4','1/2','3/4'], i % 4) ELSE CAST(i // 4 AS VARCHAR) END || ' yd' AS shown FROM (SELECT p_partkey, p_partkey % 90 AS i FROM part)""")
def yards_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = F.col("p_partkey") % 90
    return table(spark, sf_dir, "part").select("p_partkey", quarters.alias("quarters"), lengths.yards_shown(quarters).alias("shown"))


@register("color_rgb", _sql(MODELS_CTE, "SELECT model_id, fabric_id, CAST('0x' || substr(color, 2, 2) AS INTEGER) AS red, CAST('0x' || substr(color, 4, 2) AS INTEGER) AS green, CAST('0x' || substr(color, 6, 2) AS INTEGER) AS blue FROM fabrics", "red green blue"))
def color_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = colors.rgb(F.col("color"))
    return _plain(_models(spark, sf_dir).fabrics.select("model_id", "fabric_id", *[x.alias(n) for n, x in zip(("red", "green", "blue"), rgb, strict=True)]))


@register("color_lab")
def color_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = colors.lab(F.col("color"))
    return _models(spark, sf_dir).fabrics.select("model_id", "fabric_id", *[x.alias(n) for n, x in zip(("light", "a", "b"), lab, strict=True)])


@register("slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", screen.slug(F.col("p_name")).alias("slug"))


@register("downscaled", _sql("", """SELECT o_orderkey, i AS wide, 3000 AS high, CASE WHEN greatest(i, 3000) <= 2000 THEN i ELSE CAST(floor(i * 2000.0 / greatest(i, 3000) + 0.5) AS BIGINT) END AS new_wide, CAST(floor(3000 * 2000.0 / greatest(i, 3000) + 0.5) AS BIGINT) AS new_high FROM (SELECT o_orderkey, o_orderkey * 53 % 8900 + 100 AS i FROM orders)""", "wide high new_wide new_high"))
def downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("o_orderkey") * 53 % 8900 + 100
    w, h = screen.downscaled(wide, F.lit(3000), 2000)
    return _plain(table(spark, sf_dir, "orders").select("o_orderkey", wide.alias("wide"), F.lit(3000).alias("high"), w.alias("new_wide"), h.alias("new_high")))


@register("pixels", _sql("", "SELECT o_orderkey, i AS eighths, CAST(floor(i * 10 / 8.0 + 0.5) AS BIGINT) AS px, CAST(floor(i / 12.0) AS BIGINT) AS cell, CAST(greatest(0, least(44, floor(i / 12.0))) AS BIGINT) AS clamped FROM (SELECT o_orderkey, o_orderkey % 730 - 30 AS i FROM orders)", "eighths px cell clamped"))
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderkey") % 730 - 30
    return _plain(table(spark, sf_dir, "orders").select("o_orderkey", x.alias("eighths"), screen.pixel(x, 10).alias("px"), screen.cell_at(x, 12).alias("cell"), screen.cell_at(x, 12, 45).alias("clamped")))


# --- validation and census -----------------------------------------------------------------------------


@register("census", _sql(MODELS_CTE, "SELECT f.model_id, f.ord, f.fabric_id, f.name, count(c.r) AS cells FROM fabrics f LEFT JOIN cells c USING (model_id, fabric_id) GROUP BY ALL", "ord cells"))
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(analytics.census(_models(spark, sf_dir)))


@register("event_census", _sql(EVENTS_CTE, "SELECT model_id, fabric_id, count(*) AS cells FROM cells GROUP BY ALL", "cells"))
def event_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.from_events(table(spark, sf_dir, "events")).groupBy("model_id", "fabric_id").agg(F.count("*").alias("cells"))


_BROKEN = """
kept AS (SELECT c.* REPLACE (CASE WHEN k % 11 = 3 AND r = 0 THEN 1.5 ELSE confidence END AS confidence) FROM cells c JOIN seeds USING (model_id) WHERE NOT (k % 11 = 1 AND r = 1 AND c = 1)),
known AS (SELECT f.model_id, ord, CASE WHEN k % 11 = 7 AND ord = 1 THEN 'f0' ELSE fabric_id END AS fabric_id, CASE WHEN k % 11 = 6 THEN 'red' WHEN k % 11 = 8 THEN upper(color) ELSE color END AS color FROM fabrics f JOIN seeds USING (model_id) WHERE NOT (k % 11 = 2 AND ord = 1)),
sized AS (SELECT q.* REPLACE (CASE WHEN k % 11 = 4 THEN 0 ELSE cell_size END AS cell_size) FROM quilts q JOIN seeds USING (model_id)),
bands AS (SELECT b.* REPLACE (CASE WHEN k % 11 = 5 THEN -width ELSE width END AS width) FROM borders b JOIN seeds USING (model_id))"""


@register("violations", _sql([MODELS_CTE, _BROKEN], """
 SELECT model_id, 'dimensions' AS rule, count(*) AS n FROM quilts q WHERE rows * cols <> (SELECT count(*) FROM kept k WHERE k.model_id = q.model_id) GROUP BY model_id
 UNION ALL SELECT model_id, 'confidence', count(*) FROM kept WHERE confidence < 0 OR confidence > 1 GROUP BY model_id
 UNION ALL SELECT model_id, 'color', count(*) FROM known WHERE NOT regexp_full_match(lower(color), '#[0-9a-f]{6}') GROUP BY model_id
 UNION ALL SELECT model_id, 'unique fabric', count(*) FROM (SELECT model_id, fabric_id FROM known GROUP BY ALL HAVING count(*) > 1) GROUP BY model_id
 UNION ALL SELECT model_id, 'unknown fabric', count(*) FROM (SELECT model_id, fabric_id FROM kept UNION SELECT model_id, fabric_id FROM borders UNION SELECT model_id, binding_fabric_id FROM quilts) u WHERE (model_id, fabric_id) NOT IN (SELECT (model_id, fabric_id) FROM known) GROUP BY model_id
 UNION ALL SELECT model_id, 'positive size', count(*) FROM sized WHERE cell_size <= 0 GROUP BY model_id UNION ALL SELECT model_id, 'positive band', count(*) FROM bands WHERE width <= 0 GROUP BY model_id""", "n"))
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven of eleven models break a rule each on purpose; an eighth writes its colors in capitals, which none forbids."""
    m = _models(spark, sf_dir)
    k = F.regexp_extract("model_id", "[0-9]+", 0).cast("int") % 11

    def broken(df: DataFrame, column: str, when, value) -> DataFrame:
        return df.withColumn(column, F.when(when, value).otherwise(F.col(column)))

    cells = broken(m.cells.where(~((k == 1) & (F.col("r") == 1) & (F.col("c") == 1))), "confidence", (k == 3) & (F.col("r") == 0), 1.5)
    fabrics = m.fabrics.where(~((k == 2) & (F.col("ord") == 1)))
    fabrics = broken(fabrics, "fabric_id", (k == 7) & (F.col("ord") == 1), "f0")
    fabrics = broken(broken(fabrics, "color", k == 6, "red"), "color", k == 8, F.upper("color"))
    return analytics.violations(grids.Models(broken(m.quilts, "cell_size", k == 4, 0), cells, fabrics, broken(m.borders, "width", k == 5, -F.col("width"))))


@register("uncertain_cells", _sql(EVENTS_CTE, "SELECT model_id, sum(CAST(confidence < 0.9 AS INTEGER)) AS uncertain, count(*) AS cells FROM cells GROUP BY model_id", "uncertain cells"))
def uncertain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(analytics.uncertain(grids.from_events(table(spark, sf_dir, "events"))))


@register("plausible_counts", "SELECT p_partkey, i AS extent, j AS n, j >= 2 AND j <= i // 5 AS plausible FROM (SELECT p_partkey, p_partkey % 60 AS i, CAST(p_size AS BIGINT) % 14 AS j FROM part)")
def plausible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 60).alias("extent"), (F.col("p_size").cast("long") % 14).alias("n"))
    return rows.select("p_partkey", "extent", "n", analytics.plausible(F.col("extent"), F.col("n")).alias("plausible"))


_TREE = """CASE WHEN g < 0.6 AND NOT coalesce(s >= 1.5 AND l AND m >= 0.7, false) THEN CASE WHEN coalesce(s >= 1.5 AND k > 1.05, false) THEN 'non_square_repeat' ELSE 'no_grid' END
 WHEN p < 0.45 THEN CASE WHEN f THEN 'readable' ELSE 'readable_no_repeat' END WHEN h > 1.05 THEN 'non_square_repeat' ELSE 'readable' END"""


@register("verdicts", f"""SELECT event_id, {_TREE} AS verdict FROM (SELECT event_id, (event_id % 100) / 100.0 AS g, ((event_id * 7) % 100) / 100.0 AS p, ((event_id * 13) % 200) / 100.0 AS h, event_id % 2 = 0 AS f,
  CASE WHEN event_id % 3 > 0 THEN ((event_id * 11) % 300) / 100.0 END AS s, event_id % 5 = 0 AS l, ((event_id * 17) % 100) / 100.0 AS m, ((event_id * 19) % 200) / 100.0 AS k FROM events)""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")

    def part(k: int, n: int):
        return ((i * k) % n) / F.lit(100.0)

    v = analytics.verdict(part(1, 100), part(7, 100), part(13, 200), i % 2 == 0, F.when(i % 3 > 0, part(11, 300)), i % 5 == 0, part(17, 100), part(19, 200))
    return table(spark, sf_dir, "events").select("event_id", v.alias("verdict"))


# --- structure ------------------------------------------------------------------------------------------


@register("block_layout", _sql([MODELS_CTE, BLOCKS_CTE], "SELECT model_id, size, br, bc, type, sig FROM layout", "size br bc type"))
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(structure.block_layout(_models(spark, sf_dir).cells))


@register("block_types", _sql([MODELS_CTE, BLOCKS_CTE], "SELECT model_id, size, type, sig, n AS count FROM types", "size type count"))
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(structure.block_types(_models(spark, sf_dir).cells))


@register("strip_sets", _sql([MODELS_CTE, BLOCKS_CTE, SETS_CTE], "SELECT model_id, set, array_to_string(sequence, ' ') AS sequence, width, needed, per_set, sets FROM sets", "set width needed per_set sets"))
def strip_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _models(spark, sf_dir)
    return _plain(structure.strip_sets(structure.block_types(m.cells), m.quilts).withColumn("sequence", F.array_join("sequence", " ")))


_LINES = """lines AS (SELECT model_id, 'row' AS axis, r AS i, string_agg(fabric_id, ',' ORDER BY c) AS sig FROM cells GROUP BY ALL
 UNION ALL SELECT model_id, 'col', c, string_agg(fabric_id, ',' ORDER BY r) FROM cells GROUP BY ALL)"""


@register("least_periods", _sql([MODELS_CTE, _LINES], """SELECT model_id, axis, n, coalesce((SELECT min(p) FROM range(1, 60) AS t(p) WHERE p < n AND NOT EXISTS
 (SELECT 1 FROM lines a JOIN lines b ON a.model_id = b.model_id AND a.axis = b.axis AND a.i = b.i + p WHERE a.model_id = x.model_id AND a.axis = x.axis AND a.sig <> b.sig)), n) AS period
 FROM (SELECT model_id, axis, count(*) AS n FROM lines GROUP BY ALL) x""", "n period"))
def least_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(structure.least_periods(_models(spark, sf_dir).cells))


_SHIFTS = """shifts AS (
 SELECT a.model_id, 'r' AS axis, s AS shift, avg(CAST(a.fabric_id = b.fabric_id AS DOUBLE)) AS score FROM dims JOIN cells a USING (model_id), range(1, 60) AS t(s), cells b
 WHERE s <= rows // 2 AND b.model_id = a.model_id AND b.c = a.c AND b.r = a.r + s GROUP BY ALL
 UNION ALL SELECT a.model_id, 'c', s, avg(CAST(a.fabric_id = b.fabric_id AS DOUBLE)) FROM dims JOIN cells a USING (model_id), range(1, 60) AS t(s), cells b
 WHERE s <= cols // 2 AND b.model_id = a.model_id AND b.r = a.r AND b.c = a.c + s GROUP BY ALL),
picked AS (SELECT model_id, axis, coalesce(min(shift) FILTER (WHERE score >= 0.999), min(shift) FILTER (WHERE best > 0 AND score >= 0.95 * best), 0) AS period
 FROM (SELECT *, max(score) OVER (PARTITION BY model_id, axis) AS best FROM shifts) GROUP BY ALL),
scored AS (SELECT p.model_id, p.axis, p.period, coalesce(s.score, 0) AS score FROM picked p LEFT JOIN shifts s ON s.model_id = p.model_id AND s.axis = p.axis AND s.shift = p.period)"""
_REPEATS = "SELECT model_id, coalesce(max(period) FILTER (WHERE axis = 'r'), 0) AS period_rows, coalesce(max(period) FILTER (WHERE axis = 'c'), 0) AS period_cols, min(score) AS confidence FROM scored GROUP BY model_id"


@register("repeats", _sql([MODELS_CTE, _SHIFTS], _REPEATS, "period_rows period_cols", "confidence"))
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(structure.repeats(_models(spark, sf_dir).cells))


@register("event_repeats", _sql([EVENTS_CTE, _SHIFTS], _REPEATS, "period_rows period_cols", "confidence"))
def event_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(structure.repeats(grids.from_events(table(spark, sf_dir, "events"))))


@register("regridded", _sql([MODELS_CTE, _LINES, """axes AS (SELECT model_id, axis, n, coalesce((SELECT min(p) FROM range(1, 60) AS t(p) WHERE p < n AND NOT EXISTS
 (SELECT 1 FROM lines a JOIN lines b ON a.model_id = b.model_id AND a.axis = b.axis AND a.i = b.i + p WHERE a.model_id = x.model_id AND a.axis = x.axis AND a.sig <> b.sig)), n) AS period
 FROM (SELECT model_id, axis, count(*) AS n FROM lines GROUP BY ALL) x),
t AS (SELECT s.model_id, d.rows, d.cols, d.rows + s.k % 9 - 3 AS nr, d.cols + s.k % 5 - 1 AS nc, v.period AS pr, h.period AS pc FROM seeds s JOIN dims d USING (model_id)
 JOIN axes v ON v.model_id = s.model_id AND v.axis = 'row' JOIN axes h ON h.model_id = s.model_id AND h.axis = 'col')"""], """SELECT t.model_id, r2 AS r, c2 AS c, fabric_id, CASE WHEN r2 < rows AND c2 < cols THEN confidence ELSE 1.0 END AS confidence
 FROM t, range(40) AS a(r2), range(40) AS b(c2), cells
 WHERE r2 < nr AND c2 < nc AND cells.model_id = t.model_id AND cells.r = CASE WHEN r2 < rows THEN r2 ELSE r2 % pr END AND cells.c = CASE WHEN c2 < cols THEN c2 ELSE c2 % pc END""", "r c", "confidence"))
def regridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model some rows smaller or larger, and some columns."""
    m = _models(spark, sf_dir)
    k = F.regexp_extract("model_id", "[0-9]+", 0).cast("int")
    target = m.quilts.select("model_id", (F.col("rows") + k % 9 - 3).alias("new_rows"), (F.col("cols") + k % 5 - 1).alias("new_cols"))
    return _plain(structure.regridded(m.cells, target))


# --- plans ----------------------------------------------------------------------------------------------


def _plan(spark: SparkSession, sf_dir: str, strategy: str) -> construction.Plan:
    return construction.plan(_models(spark, sf_dir), strategy)


_STRIP_LINES = """
edges_of AS (SELECT *, rows * cell_size + 2 * before AS high, cols * cell_size + 2 * before + 2 * width AS wide
 FROM (SELECT *, coalesce(sum(width) OVER (PARTITION BY model_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM borders) JOIN quilts USING (model_id)),
listed AS (
 SELECT model_id, 1 AS grp, f.ord, fabric_id, 'center' AS component, 'strip_set' AS source, count(*) AS quantity, cell_size + 4 AS cw, cell_size + 4 AS ch, cell_size AS fw, cell_size AS fh
 FROM cells JOIN quilts USING (model_id) JOIN fabrics f USING (model_id, fabric_id) GROUP BY ALL
 UNION ALL SELECT model_id, 2, 2 * ord, fabric_id, 'border', 'rotary', 2, width + 4, high + 4, width, high FROM edges_of
 UNION ALL SELECT model_id, 2, 2 * ord + 1, fabric_id, 'border', 'rotary', 2, wide + 4, width + 4, wide, width FROM edges_of
 UNION ALL SELECT model_id, 3, 0, binding_fabric_id, 'binding', 'rotary', CAST(ceil((perimeter + 80) / 336.0) AS BIGINT), 20, 336, 20, 336 FROM finished JOIN quilts USING (model_id)),
plan_lines AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY grp, ord) AS line FROM listed WHERE model_id IN (SELECT model_id FROM sized))"""
_LABEL = f"""CASE component WHEN 'center' THEN {_inch('fw')} || ' square, cut ' || {_inch('cw')} || ' x ' || {_inch('ch')}
 WHEN 'binding' THEN 'binding strip, ' || {_inch('cw')} || ' x WOF' ELSE 'border ' || (p.ord // 2 + 1) || CASE p.ord % 2 WHEN 0 THEN ' side' ELSE ' top/bottom' END || ', ' || {_inch('fw')} || ' x ' || {_inch('fh')} || ' finished' END"""


@register("cutlist_strip", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, _STRIP_LINES], f"""SELECT p.model_id, line, p.fabric_id, f.name AS fabric_name, component, source, {_LABEL} AS label, quantity, cw AS cut_width_eighths, ch AS cut_height_eighths, fw AS finished_width_eighths, fh AS finished_height_eighths,
 {_inch('cw')} || ' x ' || {_inch('ch')} AS cut_size, {_inch('fw')} || ' x ' || {_inch('fh')} AS finished_size
 FROM plan_lines p JOIN fabrics f USING (model_id, fabric_id)""", "line quantity cut_width_eighths cut_height_eighths finished_width_eighths finished_height_eighths"))
def cutlist_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(construction.cut_list(construction.plan(_models(spark, sf_dir), "strip")))


_AREAS = """
edge AS (
 SELECT model_id, fabric_id, 'border' AS component, 2 * ((width + 4) * (rows * cell_size + 2 * before + 4) + (cols * cell_size + 2 * before + 2 * width + 4) * (width + 4)) AS area
 FROM (SELECT *, coalesce(sum(width) OVER (PARTITION BY model_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM borders) JOIN quilts USING (model_id)
 UNION ALL SELECT model_id, binding_fabric_id, 'binding', ceil((perimeter + 80) / 336.0) * 20 * 336 FROM finished JOIN quilts USING (model_id)),
squares AS (SELECT model_id, fabric_id, count(*) * (cell_size + 4) * (cell_size + 4) AS area FROM cells JOIN quilts USING (model_id) GROUP BY model_id, fabric_id, cell_size)"""
_BACKING = "SELECT model_id, 9 AS grp, 0 AS ord, CAST(NULL AS VARCHAR) AS fabric_id, 'Backing' AS name, 'backing' AS purpose, ceil((finished_width + 64) / 336.0) * (finished_height + 64) AS len FROM finished"
_YARD = "SELECT model_id, grp, ord, fabric_id, name, purpose, len AS length_needed, ceil(len / 72.0) AS quarter_yards FROM"


@register("yardage_historical", _sql([MODELS_CTE, SIZE_CTE, _AREAS], f"""{_YARD} (SELECT f.model_id, 1 AS grp, f.ord, f.fabric_id, f.name, 'fabric' AS purpose, ceil(coalesce((SELECT sum(area) FROM (SELECT model_id, fabric_id, area FROM edge UNION ALL SELECT * FROM squares) x WHERE x.model_id = f.model_id AND x.fabric_id = f.fabric_id), 0) / 336.0) AS len FROM fabrics f UNION ALL {_BACKING})""", "grp ord length_needed quarter_yards"))
def yardage_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(construction.yardage(_plan(spark, sf_dir, "historical")))


@register("purchase_strip", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, SETS_CTE, _AREAS, "used AS (SELECT model_id, unnest(sequence) AS fabric_id, width * 336 * sets AS area FROM sets)"], f"""{_YARD} (
 SELECT f.model_id, 1 AS grp, f.ord, f.fabric_id, f.name, 'top' AS purpose, ceil(sum(area) / 336.0) AS len FROM fabrics f JOIN (SELECT model_id, fabric_id, area FROM edge WHERE component = 'border' UNION ALL SELECT * FROM used) x USING (model_id, fabric_id) GROUP BY ALL
 UNION ALL SELECT f.model_id, 2, f.ord, f.fabric_id, 'Binding - ' || f.name, 'binding', ceil(area / 336.0) FROM fabrics f JOIN edge USING (model_id, fabric_id) WHERE component = 'binding'
 UNION ALL {_BACKING}) WHERE model_id IN (SELECT model_id FROM sized)""", "grp ord length_needed quarter_yards"))
def purchase_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(construction.purchase(_plan(spark, sf_dir, "strip")))


_SHAPES = """
shape AS (SELECT q.model_id, q.rows, q.cols, l.size, l.down, l.across, (SELECT count(*) FROM borders b WHERE b.model_id = q.model_id) AS bands, CAST(ceil((perimeter + 80) / 336.0) AS BIGINT) AS strips,
 finished_width * finished_height / 9216.0 AS sqft FROM quilts q JOIN finished USING (model_id) LEFT JOIN (SELECT model_id, size, max(br) + 1 AS down, max(bc) + 1 AS across FROM layout GROUP BY ALL) l USING (model_id)),
ends AS (SELECT model_id, CASE WHEN size IS NOT NULL THEN down * (across - 1) + down - 1 ELSE rows - 1 END + 4 * bands + strips AS finishing FROM shape),
bought AS (SELECT model_id, sum(area) AS area, sum(ceil(ceil(area / 336.0) / 72.0) * 72 * 336) AS bought FROM fabric_area GROUP BY model_id)"""
_METRICS = """SELECT model_id, strategy, piece_count, cut_count, seam_count, strip_set_count, (bought - area) / bought AS waste, round_even(log10(piece_count) + seam_count / sqft, 0) AS difficulty,
 round_even(piece_count * 1.5 + strip_set_count * 10, 0) AS time_minutes, 0.0 AS bias_percent, 'rough heuristic' AS heuristic_label FROM ({}) JOIN shape USING (model_id) JOIN bought USING (model_id)"""
_ALL_AREAS = "fabric_area AS (SELECT model_id, fabric_id, sum(area) AS area FROM (SELECT model_id, fabric_id, area FROM edge UNION ALL SELECT model_id, fabric_id, area FROM {}) GROUP BY ALL)"
_COUNTS = "piece_count cut_count seam_count strip_set_count difficulty time_minutes"


@register("metrics_historical", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, _AREAS, _ALL_AREAS.format("squares"), _SHAPES], _METRICS.format("""SELECT model_id, 'historical' AS strategy, rows * cols + 4 * bands AS piece_count, rows * cols + 4 * bands + strips AS cut_count,
 CASE WHEN size IS NOT NULL THEN down * across * (size * size - 1) ELSE rows * (cols - 1) END + finishing AS seam_count, 0 AS strip_set_count FROM shape JOIN ends USING (model_id)"""), _COUNTS, "waste bias_percent"))
def metrics_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.metrics(_plan(spark, sf_dir, "historical"))


@register("metrics_strip", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, SETS_CTE, _AREAS, "used AS (SELECT model_id, unnest(sequence) AS fabric_id, width * 336 * sets AS area FROM sets)", _ALL_AREAS.format("used"), _SHAPES],
 _METRICS.format("""SELECT model_id, 'strip' AS strategy, rows * cols + 4 * bands AS piece_count, set_cuts + 4 * bands + strips AS cut_count, sewn + down * across * (size - 1) + finishing AS seam_count, n_sets AS strip_set_count
 FROM shape JOIN ends USING (model_id) JOIN (SELECT model_id, sum(sets) AS n_sets, sum(sets * len(sequence) + needed) AS set_cuts, sum((len(sequence) - 1) * sets) AS sewn FROM sets GROUP BY model_id) USING (model_id)"""), _COUNTS, "waste bias_percent"))
def metrics_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.metrics(_plan(spark, sf_dir, "strip"))


@register("metrics_modern")
def metrics_modern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.metrics(_plan(spark, sf_dir, "modern"))


@register("assembly_steps", _sql([MODELS_CTE, BLOCKS_CTE, SETS_CTE], """SELECT model_id, (SELECT count(*) FROM sets s WHERE s.model_id = q.model_id) + 1 + (SELECT count(*) FROM types t WHERE t.model_id = q.model_id)
 + (SELECT max(br) + 2 FROM layout l WHERE l.model_id = q.model_id) + (SELECT count(*) FROM borders b WHERE b.model_id = q.model_id) + 2 AS steps FROM quilts q WHERE model_id IN (SELECT model_id FROM sized)""", "steps"))
def assembly_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps the strip plan takes."""
    return construction.assembly_steps(construction.plan(_models(spark, sf_dir), "strip")).groupBy("model_id").agg(F.count("*").alias("steps"))


@register("assembly_strip", _sql([MODELS_CTE, SIZE_CTE, BLOCKS_CTE, SETS_CTE, """
across AS (SELECT model_id, br, count(*) AS across, string_agg(chr(CAST(65 + type AS INTEGER)), ' ' ORDER BY bc) AS letters FROM layout GROUP BY ALL), down AS (SELECT model_id, count(*) AS down FROM across GROUP BY ALL)"""], f"""SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY phase, ord) AS number, title, detail FROM (
 SELECT model_id, 0 AS phase, set AS ord, 'Sew strip set SS' || set || ' (make ' || sets || ')' AS title, len(sequence) || ' WOF strips cut ' || {_inch('width')} || ', sewn lengthwise in order: ' || array_to_string(sequence, ' ') || '.' AS detail FROM sets
 UNION ALL SELECT model_id, 1, 0, 'Crosscut the strip sets', 'Crosscut every set at ' || {_inch('(cell_size + 4)')} || '.' FROM quilts
 UNION ALL SELECT model_id, 2, type, 'Assemble Block ' || chr(CAST(65 + type AS INTEGER)) || ' (make ' || n || ')', 'Stack segments top to bottom: ' || string_agg('SS' || set, ' ' ORDER BY row) || '.' FROM block_rows JOIN sets USING (model_id, sequence) GROUP BY model_id, type, n
 UNION ALL SELECT model_id, 3, br, 'Join block row ' || (br + 1) || ' of ' || down, 'Sew the ' || across || ' blocks left to right: ' || letters || '.' FROM across JOIN down USING (model_id)
 UNION ALL SELECT model_id, 4, 0, 'Join the block rows', 'Sew the ' || down || ' rows together top to bottom.' FROM down
 UNION ALL SELECT model_id, 5, ord, 'Attach border ' || (ord + 1), {_inch('width')} || ' finished band, all four sides.' FROM borders
 UNION ALL SELECT model_id, 6, 0, 'Prepare the binding', 'Join ' || CAST(ceil((perimeter + 80) / 336.0) AS BIGINT) || ' WOF strips of ' || {_inch('20')} || ' end to end; press in half lengthwise.' FROM finished
 UNION ALL SELECT model_id, 7, 0, 'Bind the quilt', 'Attach the binding to the quilt edge; miter the corners.' FROM quilts) WHERE model_id IN (SELECT model_id FROM sized)""", "number"))
def assembly_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.assembly_steps(construction.plan(_models(spark, sf_dir), "strip"))


@register("rectangle_cover")
def rectangle_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construction.rectangles(_models(spark, sf_dir))


# --- sizing ---------------------------------------------------------------------------------------------


@register("finished_columns", _sql([MODELS_CTE, SIZE_CTE], "SELECT *, perimeter + 80 AS binding_length, finished_width + 64 AS batting_width, finished_height + 64 AS batting_height FROM finished", "band finished_width finished_height perimeter binding_length batting_width batting_height"))
def finished_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _models(spark, sf_dir)
    return _plain(sizing.finished_columns(m.quilts, m.borders))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("int")
    w = (F.col("o_orderkey") * 7 % 1340 + 60).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(55).alias("rows"), F.lit(45).alias("cols"), F.lit(12).alias("cell_size"), F.lit(30).alias("band"), F.array(F.lit(30)).alias("bands"), F.lit(5).alias("block"),
        F.when(w % 3 != 0, w).alias("target_width"), F.when(w % 3 != 1, w + 60).alias("target_height"), none.alias("target_cell"),
    )


_T = "targets AS (SELECT o_orderkey, i, CASE WHEN i % 3 <> 0 THEN i END AS w, CASE WHEN i % 3 <> 1 THEN i + 60 END AS h FROM (SELECT o_orderkey, 60 + o_orderkey * 7 % 1340 AS i FROM orders))"


@register("resize_locked", _sql([_T, "x AS (SELECT *, greatest(1, CASE WHEN w IS NOT NULL THEN (greatest(w - 60, 0) + 22) // 45 ELSE (greatest(h - 60, 0) + 27) // 55 END) AS new_cell FROM targets)"], "SELECT o_orderkey, w AS target_width, h AS target_height, new_cell, 45 * new_cell + 60 AS achieved_width, 55 * new_cell + 60 AS achieved_height FROM x", "target_width target_height new_cell achieved_width achieved_height"))
def resize_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(sizing.locked(_targets(spark, sf_dir)).select("o_orderkey", "target_width", "target_height", "new_cell", "achieved_width", "achieved_height"))


@register("resize_unlocked", _sql([_T, "x AS (SELECT *, CASE WHEN w IS NULL THEN 45 ELSE 5 * greatest(1, (greatest(w - 60, 0) + 30) // 60) END AS nc, CASE WHEN h IS NULL THEN 55 ELSE 5 * greatest(1, (greatest(h - 60, 0) + 30) // 60) END AS nr FROM targets)"], "SELECT o_orderkey, w AS target_width, h AS target_height, nr AS new_rows, nc AS new_cols, nc * 12 + 60 AS achieved_width, nr * 12 + 60 AS achieved_height FROM x", "target_width target_height new_rows new_cols achieved_width achieved_height"))
def resize_unlocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(sizing.unlocked(_targets(spark, sf_dir)).select("o_orderkey", "target_width", "target_height", "new_rows", "new_cols", "achieved_width", "achieved_height"))


_Q = "greatest(160, least(1120, ({0} + 1) // 2 * 2))"


@register("resize_scaled", _sql([_T, f"x AS (SELECT *, greatest(6, least(32, least(coalesce(greatest(1, (greatest({_Q.format('w')} - 60, 0) + 22) // 45), 99999), coalesce(greatest(1, (greatest({_Q.format('h')} - 60, 0) + 27) // 55), 99999)))) AS new_cell FROM (SELECT o_orderkey, i, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM targets))".replace("greatest(1, (greatest(greatest(160, least(1120, (w + 1) // 2 * 2)) - 60, 0) + 22) // 45)", "CASE WHEN w IS NOT NULL THEN greatest(1, (greatest(greatest(160, least(1120, (w + 1) // 2 * 2)) - 60, 0) + 22) // 45) END").replace("greatest(1, (greatest(greatest(160, least(1120, (h + 1) // 2 * 2)) - 60, 0) + 27) // 55)", "CASE WHEN h IS NOT NULL THEN greatest(1, (greatest(greatest(160, least(1120, (h + 1) // 2 * 2)) - 60, 0) + 27) // 55) END"), "y AS (SELECT *, greatest(2, least(112, (30 * new_cell + 6) // 12)) AS band FROM x)"], "SELECT o_orderkey, w AS target_width, h AS target_height, new_cell, band, 45 * new_cell + 2 * band AS achieved_width, 55 * new_cell + 2 * band AS achieved_height FROM y", "target_width target_height new_cell band achieved_width achieved_height"))
def resize_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(sizing.rescaled(_targets(spark, sf_dir)).select("o_orderkey", "target_width", "target_height", "new_cell", F.get("new_bands", F.lit(0)).alias("band"), "achieved_width", "achieved_height"))


@register("finished_size", _sql([_T, "x AS (SELECT *, greatest(6, least(32, least(coalesce(CASE WHEN w IS NOT NULL THEN (w * 12 + 300) // 600 END, 99999), coalesce(CASE WHEN h IS NOT NULL THEN (h * 12 + 360) // 720 END, 99999)))) AS new_cell FROM targets)", "y AS (SELECT *, greatest(2, (30 * new_cell + 6) // 12) AS band FROM x)"], "SELECT o_orderkey, w AS target_width, h AS target_height, new_cell, band, 45 * new_cell + 2 * band AS achieved_width, 55 * new_cell + 2 * band AS achieved_height FROM y", "target_width target_height new_cell band achieved_width achieved_height"))
def finished_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(sizing.finished(_targets(spark, sf_dir)).select("o_orderkey", "target_width", "target_height", "new_cell", F.get("new_bands", F.lit(0)).alias("band"), "achieved_width", "achieved_height"))


_PRESETS = f"presets(name, w, h) AS (VALUES {_values(list(sizing.PRESETS))})"


@register("presets", _sql([MODELS_CTE, SIZE_CTE, _PRESETS], "SELECT model_id, name, w AS width, h AS height FROM finished JOIN presets ON finished_width <= w AND finished_height <= h", "width height"))
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets that each quilt fits into."""
    m = _models(spark, sf_dir)
    sized = sizing.finished_columns(m.quilts, m.borders)
    p = F.broadcast(sizing.presets(spark))  # a handful of rows
    return _plain(sized.join(p, (F.col("finished_width") <= F.col("width")) & (F.col("finished_height") <= F.col("height"))).select("model_id", p["name"], "width", "height"))


@register("preset_by_aspect", _sql([_PRESETS], """SELECT o_orderkey, aspect, (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM presets WHERE aspect > 0 AND abs(CASE WHEN aspect >= 1 THEN aspect ELSE 1 / aspect END - greatest(w, h) / least(w, h)) <= 0.04) AS preset
 FROM (SELECT o_orderkey, (o_orderkey % 200 + 40) / 97.0 AS aspect FROM orders)""", "o_orderkey", "aspect"))
def preset_by_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(sizing.by_aspect(table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 200 + 40) / F.lit(97.0)).alias("aspect"))))


@register("preset_by_size", _sql([_PRESETS], "SELECT o_orderkey, width, height, (SELECT arg_min(name, ord) FROM (SELECT *, row_number() OVER () AS ord FROM presets) WHERE abs(w - width) <= 0.56 AND abs(h - height) <= 0.56) AS preset FROM (SELECT o_orderkey, w + o_orderkey % 3 - 1 AS width, h + o_orderkey // 3 % 2 AS height FROM orders, presets WHERE length(name) = 4 + o_orderkey % 3 OR o_orderkey % 4 = 0)", "width height"))
def preset_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes on and beside those of the presets."""
    k = F.col("o_orderkey")
    p = F.broadcast(sizing.presets(spark))  # a handful of rows
    beside = table(spark, sf_dir, "orders").join(p, (F.length("name") == 4 + k % 3) | (k % 4 == 0))
    near = beside.select("o_orderkey", (F.col("width") + k % 3 - 1).alias("width"), (F.col("height") + lengths.int_div(k, 3) % 2).alias("height"))
    return _plain(sizing.by_size(near))


# --- analytics on grids ----------------------------------------------------------------------------------


@register("border_scan", _sql([MODELS_CTE, """strips AS (
 SELECT model_id, 'left' AS side, c AS i, cols AS extent, fabric_id FROM cells JOIN dims USING (model_id) UNION ALL SELECT model_id, 'right', cols - 1 - c, cols, fabric_id FROM cells JOIN dims USING (model_id)
 UNION ALL SELECT model_id, 'top', r, rows, fabric_id FROM cells JOIN dims USING (model_id) UNION ALL SELECT model_id, 'bottom', rows - 1 - r, rows, fabric_id FROM cells JOIN dims USING (model_id)),
counts AS (SELECT model_id, side, i, fabric_id, count(*) AS n FROM strips WHERE i < extent // 4 GROUP BY ALL),
scores AS (SELECT model_id, side, i, arg_min(fabric_id, (-n, fabric_id)) AS fabric_id, least(1.0, max(n) / greatest(1, sum(n) - floor(0.15 * sum(n)))) AS score FROM counts GROUP BY model_id, side, i),
lead_strips AS (SELECT * FROM (SELECT *, min(CASE WHEN score < 0.93 THEN i END) OVER (PARTITION BY model_id, side) AS stop FROM scores) WHERE stop IS NULL OR i < stop)"""],
 "SELECT model_id, side, sum(n) AS strips, arg_min(fabric_id, (-n, fabric_id)) AS fabric_id, sum(s) / sum(n) AS score FROM (SELECT model_id, side, fabric_id, count(*) AS n, sum(score) AS s FROM lead_strips GROUP BY ALL) GROUP BY model_id, side", "strips", "score"))
def border_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(analytics.border_scan(_models(spark, sf_dir).cells))


@register("voted_cells", _sql([EVENTS_CTE, """tally AS (SELECT model_id, r % 5 AS kr, c % 4 AS kc, fabric_id, sum(confidence) AS w FROM cells GROUP BY ALL),
best AS (SELECT model_id, kr, kc, fabric_id, w FROM (SELECT *, row_number() OVER (PARTITION BY model_id, kr, kc ORDER BY round(w, 6) DESC, fabric_id) AS k FROM tally) WHERE k = 1)"""],
 "SELECT c.model_id, r, c, c.fabric_id, CASE WHEN rows >= 15 AND cols >= 12 AND confidence < 0.8 THEN CASE WHEN w > 0 THEN b.fabric_id ELSE (SELECT min(fabric_id) FROM cells x WHERE x.model_id = c.model_id) END ELSE c.fabric_id END AS voted FROM cells c JOIN dims USING (model_id) JOIN best b ON b.model_id = c.model_id AND kr = r % 5 AND kc = c % 4", "r c"))
def voted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.from_events(table(spark, sf_dir, "events"))
    # hundredths add up exactly only as decimals
    cells = cells.withColumn("confidence", F.col("confidence").cast("decimal(10,2)"))
    full = structure.dims(cells).where("rows >= 15 and cols >= 12")
    periods = full.select("model_id", F.lit(5).alias("period_rows"), F.lit(4).alias("period_cols"))
    return _plain(analytics.voted(cells, periods).select("model_id", "r", "c", "fabric_id", "voted"))


@register("compared_cells", _sql(EVENTS_CTE, "SELECT a.model_id, count(*) AS compared, avg(CAST(a.fabric_id = CASE b.fabric_id WHEN 'click' THEN 'view' ELSE '?' END AS DOUBLE)) AS accuracy, true AS dims_match FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.r = b.r AND a.c = b.c GROUP BY a.model_id", "compared", "accuracy"))
def compared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.from_events(table(spark, sf_dir, "events"))
    mapping = cells.select("model_id").distinct().select("model_id", F.lit("click").alias("fabric_id"), F.lit("view").alias("truth_id"))
    return _plain(analytics.compared(cells, cells, mapping))


@register("nearest_label", _sql("c AS (SELECT vec_id AS center_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE vec_id < 6), d AS (SELECT e.vec_id AS point_id, center_id, sqrt(list_sum(list_transform(list_zip(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM embeddings e, c), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, center_id) AS k, lead(d) OVER (PARTITION BY point_id ORDER BY d, center_id) AS d2 FROM d)", "SELECT point_id, center_id, d AS d1, d2, (d2 - d) / d2 AS margin FROM k WHERE k = 1", "", "d1 d2 margin"))
def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centers = e.where("vec_id < 6").select(F.col("vec_id").alias("center_id"), F.col("v").alias("w"))
    return _plain(analytics.nearest_two(e.select(F.col("vec_id").alias("point_id"), "v"), centers))


_EDGES = """edges AS (SELECT a.model_id, a.r, a.c, 'v' AS dir, a.fabric_id = b.fabric_id AS same FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.r = b.r AND b.c = a.c + 1
 UNION ALL SELECT a.model_id, a.r, a.c, 'h', a.fabric_id = b.fabric_id FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.c = b.c AND b.r = a.r + 1)"""


@register("seam_edges", _sql([EVENTS_CTE, _EDGES], "SELECT * FROM edges", "r c"))
def seam_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(seams.edges(grids.from_events(table(spark, sf_dir, "events"))))


@register("strip_seams", _sql([MODELS_CTE, _EDGES], "SELECT model_id, (SELECT count(*) FROM cells c WHERE c.model_id = e.model_id) - count(*) FILTER (WHERE same AND dir = 'v') AS pieces, count(*) - count(*) FILTER (WHERE same AND dir = 'v') AS seams FROM edges e GROUP BY model_id", "pieces seams"))
def strip_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip's pieces are runs in a row, so their number follows from the merged edges."""
    cells = _models(spark, sf_dir).cells
    return _plain(seams.estimate(cells, seams.merges(cells, "strip")))


# --- profiles --------------------------------------------------------------------------------------------

_HOURS = "profile AS (SELECT event_type AS series_id, user_id % 97 AS pos, sum(CAST(event_id % 7 AS BIGINT)) AS value FROM events GROUP BY ALL)"


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), (F.col("user_id") % 97).alias("pos")).agg(F.sum(F.col("event_id") % 7).cast("double").alias("value"))


@register("autocorrelation", _sql([_HOURS, "x AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS x FROM profile)", "z AS (SELECT series_id, sum(x * x) AS z FROM x GROUP BY series_id)"], "SELECT a.series_id, b.pos - a.pos AS lag, CASE WHEN z > 0 THEN sum(a.x * b.x) / z ELSE 0 END AS corr FROM x a JOIN x b ON a.series_id = b.series_id AND b.pos >= a.pos JOIN z ON z.series_id = a.series_id GROUP BY a.series_id, b.pos - a.pos, z", "lag", "corr"))
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(profiles.autocorrelation(_profile(spark, sf_dir)))


@register("spikes", _sql([_HOURS, "x AS (SELECT *, avg(value) OVER w + stddev_pop(value) OVER w AS bar, lag(value) OVER o AS b, lead(value) OVER o AS a FROM profile WINDOW w AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY pos))", "p AS (SELECT series_id, pos, coalesce(CAST(value > bar AND value >= b AND value >= a AS INTEGER), 0) AS p FROM x)"], "SELECT series_id, pos, greatest(p, coalesce(lag(p) OVER (PARTITION BY series_id ORDER BY pos), 0), coalesce(lead(p) OVER (PARTITION BY series_id ORDER BY pos), 0)) AS spike FROM p", "pos", "spike"))
def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(profiles.spikes(_profile(spark, sf_dir)))


_COMBS = (("eight", 160, 8, (3,)), ("turns", 610, 30, (4, 18)), ("halves", 400, 15, (2, 9)))
_PITCHES = [
    "profile AS (SELECT event_type AS series_id, user_id % 97 AS pos, sum(CAST(event_id % 7 AS BIGINT)) AS value FROM events GROUP BY ALL "
    + " ".join(f"UNION ALL SELECT '{name}', i, CASE WHEN i % {period} IN ({', '.join(map(str, at))}) THEN 10 ELSE 0 END FROM range({n}) AS t(i)" for name, n, period, at in _COMBS) + ")",
    "x AS (SELECT *, avg(value) OVER w + stddev_pop(value) OVER w AS bar, lag(value) OVER o AS b, lead(value) OVER o AS a FROM profile WINDOW w AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY pos))",
    "tops AS (SELECT series_id, pos, coalesce(CAST(value > bar AND value >= b AND value >= a AS INTEGER), 0) AS p FROM x)",
    "spike AS (SELECT series_id, pos, greatest(p, coalesce(lag(p) OVER o, 0), coalesce(lead(p) OVER o, 0)) AS spike FROM tops WINDOW o AS (PARTITION BY series_id ORDER BY pos))",
    "m AS (SELECT series_id, pos, spike - avg(spike) OVER w AS x, max(pos) OVER w AS final FROM spike WINDOW w AS (PARTITION BY series_id))",
    "z AS (SELECT series_id, sum(x * x) AS z FROM m GROUP BY series_id)",
    "c AS (SELECT a.series_id, a.final, b.pos - a.pos AS d, round(CASE WHEN z > 0 THEN sum(a.x * b.x) / z ELSE 0 END, 9) AS corr FROM m a JOIN m b ON a.series_id = b.series_id AND b.pos >= a.pos JOIN z ON z.series_id = a.series_id GROUP BY a.series_id, a.final, b.pos - a.pos, z)",
    "sided AS (SELECT *, lag(corr) OVER o AS b, lead(corr) OVER o AS a FROM c WHERE d >= 5 AND d < least(40, final) WINDOW o AS (PARTITION BY series_id ORDER BY d))",
    "peaks AS (SELECT *, max(corr) OVER (PARTITION BY series_id) AS top FROM sided WHERE corr >= b AND corr >= a AND corr > 0)",
    "base AS (SELECT series_id, final, min(d) AS base FROM peaks WHERE corr >= 0.5 * top GROUP BY series_id, final)",
    "fit AS (SELECT i.series_id, base, h.corr AS height, base + CASE WHEN abs(b.corr - 2 * h.corr + a.corr) > 1e-9 THEN greatest(-0.5, least(0.5, 0.5 * (b.corr - a.corr) / (b.corr - 2 * h.corr + a.corr))) ELSE 0 END AS p FROM base i "
    "JOIN c h ON h.series_id = i.series_id AND h.d = base JOIN c b ON b.series_id = i.series_id AND b.d = base - 1 JOIN c a ON a.series_id = i.series_id AND a.d = base + 1)",
    "near AS (SELECT i.series_id, k, d, corr, row_number() OVER (PARTITION BY i.series_id, k ORDER BY corr DESC, d) AS place FROM base i, range(2, 7) AS t(k), c WHERE c.series_id = i.series_id AND abs(d - k * base) <= 2 AND k * base + 2 <= i.final)",
    "means AS (SELECT series_id, avg(d / k) AS mean FROM near WHERE place = 1 AND corr > 0 GROUP BY series_id)",
    "pitches AS (SELECT fit.series_id, base, least(1, height) AS prominence, round(CASE WHEN abs(mean - p) / mean > 0.01 THEN mean ELSE p END, 9) AS pitch FROM fit LEFT JOIN means USING (series_id))",
    "tries AS (SELECT p.series_id, pitch, final + 1 AS n, k * 0.25 AS offset_px FROM pitches p JOIN base USING (series_id), range(0, 160) AS t(k) WHERE k < ceil(pitch / 0.25))",
    "lines AS (SELECT series_id, offset_px, greatest(0, least(n - 1, CAST(round_even(offset_px + i * pitch, 0) AS BIGINT))) AS pos FROM tries, range(0, 200) AS t(i) WHERE i < greatest(1, ceil((n - offset_px) / pitch)))",
    "scores AS (SELECT series_id, offset_px, sum(value) AS score FROM lines JOIN profile USING (series_id, pos) GROUP BY series_id, offset_px)",
    "best AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, offset_px) AS place FROM scores)",
]


@register("pitch_and_phase", _sql(_PITCHES, "SELECT series_id, base AS lag, pitch, prominence, offset_px, score FROM pitches JOIN best USING (series_id) WHERE place = 1", "lag", "pitch prominence offset_px score"))
def pitch_and_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch and phase of the events' series, and of three combs: one regular, and two whose spacings take turns."""
    p = _profile(spark, sf_dir)
    for name, n, period, at in _COMBS:
        value = F.when((F.col("id") % period).isin(*at), 10.0).otherwise(0.0)
        p = p.unionByName(spark.range(0, n).select(F.lit(name).alias("series_id"), F.col("id").alias("pos"), value.alias("value")))
    pitches = profiles.pitch(p, 40)
    found = pitches.join(profiles.phase(p, pitches), "series_id")
    return _plain(found.select("series_id", "lag", "pitch", "prominence", F.col("offset").alias("offset_px"), "score"))
