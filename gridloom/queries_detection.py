"""Registered queries of photos' borders and of the quilts found in them, tier by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import register, table
from gridloom.operators import detection, quads
from gridloom.queries import _models, _plain, _sql
from gridloom.queries_images import _photos
from gridloom.sources import scratch

_BORDER = """
px AS (SELECT l_suppkey % 40 AS image_id, l_orderkey % 40 AS y, l_partkey % 40 AS x, q,
 CASE g WHEN 0 THEN 62 + q % 4 WHEN 1 THEN 200 + q % 5 WHEN 2 THEN q * 5 ELSE 100 + l_orderkey % 40 * 2 END AS red, CASE g WHEN 2 THEN 250 - q * 5 ELSE 64 END AS green, CASE g WHEN 1 THEN 90 ELSE 64 END AS blue
 FROM (SELECT *, l_suppkey % 4 AS g, CAST(l_quantity AS BIGINT) AS q FROM lineitem)),
sz AS (SELECT image_id, max(y) + 1 AS high, max(x) + 1 AS wide FROM px GROUP BY image_id),
st AS (SELECT px.*, high, wide, unnest(list_filter([CASE WHEN y < t THEN 0 END, CASE WHEN y >= high - t THEN 1 END, CASE WHEN x < t THEN 2 END, CASE WHEN x >= wide - t THEN 3 END], lambda v: v IS NOT NULL)) AS strip
 FROM px JOIN (SELECT *, greatest(4, round_even(0.04 * least(high, wide), 0)) AS t FROM sz) USING (image_id)),
md AS (SELECT image_id, strip, median(red) AS mr, median(green) AS mg, median(blue) AS mb FROM st GROUP BY GROUPING SETS ((image_id, strip), (image_id))),
ds AS (SELECT st.image_id, md.strip, sqrt((red - mr) * (red - mr) + (green - mg) * (green - mg) + (blue - mb) * (blue - mb)) AS d FROM st JOIN md ON st.image_id = md.image_id AND (st.strip = md.strip OR md.strip IS NULL)),
ma AS (SELECT image_id, strip, median(d) AS mad FROM ds GROUP BY ALL),
inl AS (SELECT ds.image_id, ds.strip, any_value(mad) AS mad, avg(CAST(d <= greatest(15.0, 4 * mad) AS DOUBLE)) AS inliers FROM ds JOIN ma ON ds.image_id = ma.image_id AND ds.strip IS NOT DISTINCT FROM ma.strip GROUP BY ds.image_id, ds.strip),
al AS (SELECT image_id, bool_and(mad <= 12 AND inliers >= 0.9) AS even, (SELECT max(sqrt((a.mr - b.mr) ** 2 + (a.mg - b.mg) ** 2 + (a.mb - b.mb) ** 2)) FROM md a JOIN md b ON a.image_id = b.image_id WHERE a.image_id = i.image_id AND a.strip IS NOT NULL AND b.strip IS NOT NULL) AS apart
 FROM inl i WHERE strip IS NOT NULL GROUP BY image_id),
tiers AS (SELECT sz.*, mr, mg, mb, mad, CASE WHEN sqrt((mr - 64) ** 2 + (mg - 64) ** 2 + (mb - 64) ** 2) <= 8 THEN 0 WHEN even AND apart <= 20 THEN 1 ELSE 3 END AS tier
 FROM sz JOIN md ON md.image_id = sz.image_id AND md.strip IS NULL JOIN ma ON ma.image_id = sz.image_id AND ma.strip IS NULL JOIN al ON al.image_id = sz.image_id)"""


def _edged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    q, g, y = F.col("l_quantity").cast("long"), F.col("l_suppkey") % 4, F.col("l_orderkey") % 40
    return t.select(
        (F.col("l_suppkey") % 40).alias("image_id"), y.alias("y"), (F.col("l_partkey") % 40).alias("x"),
        F.when(g == 0, 62 + q % 4).when(g == 1, 200 + q % 5).when(g == 2, q * 5).otherwise(100 + y * 2).alias("red"), F.when(g == 2, 250 - q * 5).otherwise(64).alias("green"), F.when(g == 1, 90).otherwise(64).alias("blue"),
    )


@register("border_models", _sql(_BORDER, """SELECT image_id, high, wide, tier, CASE tier WHEN 0 THEN 64 WHEN 1 THEN mr END AS red, CASE tier WHEN 0 THEN 64 WHEN 1 THEN mg END AS green, CASE tier WHEN 0 THEN 64 WHEN 1 THEN mb END AS blue,
 CASE tier WHEN 0 THEN 40 WHEN 1 THEN greatest(25, 6 * mad) END AS tolerance FROM tiers""", "image_id high wide tier", "red green blue tolerance"))
def border_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds told by the borders of pictures from lineitem: known, even, noisy, and of sides that differ."""
    return _plain(detection.border_models(_edged(spark, sf_dir)))


def _grounds(photos: DataFrame) -> DataFrame:
    """Photos of which one of three keeps the known background, one has another, and one has noise."""
    k = F.regexp_extract("image_id", "[0-9]+", 0).cast("long")
    x, y = F.col("x"), F.col("y")
    bare = (F.col("red") == quads.BACKGROUND[0]) & (F.col("green") == quads.BACKGROUND[1]) & (F.col("blue") == quads.BACKGROUND[2])
    noise = F.pmod(F.xxhash64("image_id", "y", "x"), F.lit(256)).cast("int")
    other = {"red": 16 + (x + y) % 3, "green": 90 + k % 7, "blue": F.lit(20)}
    return photos.select("image_id", "y", "x", *[F.when(bare & (k % 3 == 1), other[c].cast("int")).when(bare & (k % 3 == 2), noise if c == "red" else 255 - noise).otherwise(F.col(c)).alias(c) for c in quads.CHANNELS])


@register("detected_quads")
def detected_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quilts' quads in photos on three kinds of ground, with the size and preset that they suggest, and the upright
    pictures' confidence."""
    path = scratch.folder(spark) + "/photos"
    _grounds(_photos(_models(spark, sf_dir))).write.parquet(path)
    photos = spark.read.parquet(path)
    found = detection.detect(photos)
    told = detection.rectified(photos, found)[1]
    return _plain(detection.predicted(found).drop("corners").join(told.select("image_id", "identity", "confidence", "warp"), "image_id"))
