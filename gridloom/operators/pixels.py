"""Statistics of pixel tables (image_id, y, x and one column a channel), and geometry of quads.

An image is never one row: everything is a grouped aggregate, so that a large image or many small ones
spread alike. Palettes and boundaries are small by nature, an array a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of a strip's surface model, the gate of the illumination fit, the ratio's tolerance.
RADIUS_FLOOR, RADIUS_MADS, GATE, RATIO_EPSILON = 15.0, 4.0, 1.20, 0.15
CHANNELS = ("l", "a", "b")


def distance(channels: Sequence[str], to: str) -> Column:
    """Euclidean distance of the channels to columns of these names with a prefix."""
    return F.sqrt(sum(((F.col(c) - F.col(f"{to}{c}")) * (F.col(c) - F.col(f"{to}{c}")) for c in channels), F.lit(0.0)))


def strip_stats(pixels: DataFrame, keys: Sequence[str] = ("image_id", "strip"), channels: Sequence[str] = CHANNELS) -> DataFrame:
    """keys, m_<channel> (exact medians), mad (median distance to them), radius and the share of pixels inside it."""
    medians = pixels.groupBy(*keys).agg(*[F.median(c).alias(f"m_{c}") for c in channels])
    apart = pixels.join(medians, list(keys)).withColumn("d", distance(channels, "m_"))
    mads = apart.groupBy(*keys).agg(F.median("d").alias("mad")).withColumn("radius", F.greatest(F.lit(RADIUS_FLOOR), RADIUS_MADS * F.col("mad")))
    inside = apart.join(mads, list(keys)).groupBy(*keys, "mad", "radius").agg(F.avg((F.col("d") <= F.col("radius")).cast("double")).alias("inliers"))
    return medians.join(inside, list(keys))


def background_share(pixels: DataFrame, models: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """(image_id, share): of an image's pixels those within the radius of any of its surface models
    (image_id, m_<channel>, radius); a handful of models an image, as one array."""
    listed = models.groupBy("image_id").agg(F.collect_list(F.struct("radius", *[f"m_{c}" for c in channels])).alias("models"))

    def near(m: Column) -> Column:
        return F.sqrt(sum(((F.col(c) - m[f"m_{c}"]) * (F.col(c) - m[f"m_{c}"]) for c in channels), F.lit(0.0))) <= m["radius"]

    matched = pixels.join(listed, "image_id", "left").withColumn("hit", F.coalesce(F.exists("models", near), F.lit(False)))
    return matched.groupBy("image_id").agg(F.avg(F.col("hit").cast("double")).alias("share"))


def illumination_gate(pixels: DataFrame, channel: str = "l") -> DataFrame:
    """(image_id, p5, p95, uneven): whether the 95th percentile is over 1.2 times the 5th, both interpolated."""
    p = pixels.groupBy("image_id").agg(F.percentile(channel, F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    low, high = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return p.select("image_id", low.alias("p5"), high.alias("p95"), ((low > 0) & (F.try_divide(high, low) > GATE)).alias("uneven"))


def _eliminated(m: Column, n: int) -> Column:
    """The solution of n equations, rows of n + 1 numbers, by elimination with the largest pivot."""

    def step(rows: Column, i: Column) -> Column:
        rest = F.slice(rows, i + 1, n)
        best = F.array_max(F.transform(rest, lambda r: F.abs(F.get(r, i))))
        at = i + F.array_position(F.transform(rest, lambda r: F.abs(F.get(r, i)) == best), True) - 1
        swapped = F.transform(rows, lambda r, k: F.when(k == i, F.get(rows, at.cast("int"))).when(k == at, F.get(rows, i)).otherwise(r))
        scaled = F.transform(F.array(swapped), lambda s: F.transform(s, lambda r, k: F.when(k == i, F.transform(r, lambda x: x / F.get(r, i))).otherwise(r)))
        return F.get(F.transform(scaled, lambda s: F.transform(s, lambda r, k: F.when(k == i, r).otherwise(F.zip_with(r, F.get(s, i), lambda x, y: x - y * F.get(r, i))))), F.lit(0))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), m, step)
    return F.transform(solved, lambda r: F.get(r, F.lit(n)))


def illumination_fit(pixels: DataFrame, channel: str = "l") -> DataFrame:
    """(image_id, coefficients): the least-squares field over 1, x, y, x*x, y*y, x*y, coordinates from 0 to 1. The
    27 sums of the normal equations are one aggregate; solving them takes a row an image."""
    size = pixels.groupBy("image_id").agg(F.greatest(F.max("x"), F.lit(1)).alias("w"), F.greatest(F.max("y"), F.lit(1)).alias("h"))
    p = pixels.join(size, "image_id").select("image_id", (F.col("x") / F.col("w")).alias("x"), (F.col("y") / F.col("h")).alias("y"), F.col(channel).cast("double").alias("t"))
    x, y = F.col("x"), F.col("y")
    base = (F.lit(1.0), x, y, x * x, y * y, x * y)
    sums = [F.sum(base[i] * base[j]).alias(f"s{i}{j}") for i in range(6) for j in range(i, 6)] + [F.sum(b * F.col("t")).alias(f"t{i}") for i, b in enumerate(base)]
    rows = F.array(*[F.array(*[F.col(f"s{min(i, j)}{max(i, j)}") for j in range(6)], F.col(f"t{i}")) for i in range(6)])
    return p.groupBy("image_id").agg(*sums).select("image_id", _eliminated(rows, 6).alias("coefficients"))


def silhouette(distances: DataFrame) -> DataFrame:
    """(group_id, silhouette) from (group_id, d1, d2): d1 to the point's own center, d2 to the nearest other one."""
    most = F.greatest("d1", "d2")
    return distances.groupBy("group_id").agg(F.avg((F.col("d2") - F.col("d1")) / F.when(most == 0, 1.0).otherwise(most)).alias("silhouette"))


def cell_of(at: Column, boundaries: Column) -> Column:
    """The cell between two boundaries (rounded, halves to even) that a pixel lies in; null outside of all."""
    below = F.size(F.filter(boundaries, lambda b: F.bround(b) <= at)) - 1
    return F.when((below >= 0) & (below < F.size(boundaries) - 1), below)


def cell_medians(pixels: DataFrame, grids: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """(image_id, r, c, v): the median of every channel over a cell's pixels; grids: (image_id, xs, ys) boundaries."""
    placed = pixels.join(grids, "image_id").withColumn("r", cell_of(F.col("y"), F.col("ys"))).withColumn("c", cell_of(F.col("x"), F.col("xs")))
    found = placed.where("r is not null and c is not null").groupBy("image_id", "r", "c").agg(*[F.median(c).alias(c) for c in channels])
    return found.select("image_id", "r", "c", F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))


def ordered_palette(centers: DataFrame) -> DataFrame:
    """centers (image_id, center_id, v) with `ord`, from the darkest first channel on, ties to the smaller id."""
    row = F.struct(F.get("v", F.lit(0)).alias("light"), F.col("center_id"), F.col("v"))
    ranked = centers.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    return ranked.select("image_id", F.posexplode("p").alias("ord", "p")).select("image_id", "ord", "p.center_id", "p.v")


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def matched_palettes(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """(model_id, ord, fabric_id, truth_id, d): in the order of the recovered palette each fabric takes the nearest
    true one that is left (the smaller id of equal ones); those for which none is left have no row. Both:
    (model_id, ord, fabric_id, v). Palettes are folded as arrays of a handful."""
    t = truth.groupBy("model_id").agg(F.collect_list(F.struct("fabric_id", "v")).alias("truth"))
    r = recovered.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("ord", "fabric_id", "v"))).alias("own"))
    start = F.array().cast("array<struct<ord: int, fabric_id: string, truth_id: string, d: double>>")

    def take(done: Column, f: Column) -> Column:
        free = F.filter("truth", lambda x: ~F.exists(done, lambda y: y["truth_id"] == x["fabric_id"]))
        best = F.array_min(F.transform(free, lambda x: F.struct(_apart(f["v"], x["v"]).alias("d"), x["fabric_id"].alias("id"))))
        row = F.struct(f["ord"].cast("int").alias("ord"), f["fabric_id"].cast("string").alias("fabric_id"), best["id"].cast("string").alias("truth_id"), best["d"].alias("d"))
        return F.when(best.isNotNull(), F.concat(done, F.array(row))).otherwise(done)

    return t.join(r, "model_id").select("model_id", F.inline(F.aggregate("own", start, take)))


def palette_fidelity(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """(model_id, worst): the largest distance of matched fabrics, and of an unmatched one of either side to the
    nearest of the other; infinite where a side is empty."""
    matches = matched_palettes(truth, recovered)

    def unmatched(side: DataFrame, other: DataFrame, by: str) -> DataFrame:
        rest = side.join(matches.select("model_id", F.col(by).alias("fabric_id")), ["model_id", "fabric_id"], "left_anti")
        near = rest.select("model_id", "fabric_id", F.col("v").alias("w")).join(other.select("model_id", "v"), "model_id")
        return near.groupBy("model_id", "fabric_id").agg(F.min(_apart(F.col("v"), F.col("w"))).alias("d")).select("model_id", "d")

    every = matches.select("model_id", "d").unionByName(unmatched(truth, recovered, "truth_id")).unionByName(unmatched(recovered, truth, "fabric_id"))
    worst = every.groupBy("model_id").agg(F.max("d").alias("worst"))
    models = truth.select("model_id").unionByName(recovered.select("model_id")).distinct()
    return models.join(worst, "model_id", "left").select("model_id", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))


def _twice_areas(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Twice the signed areas of polygons, a column each with `size` corners from the top."""
    slot = np.arange(len(x))[:, None]
    u, v = (np.where(slot == size - 1, a[0], np.roll(a, -1, axis=0)) for a in (x, y))
    terms = np.where(slot < size, x * v - u * y, 0.0)
    total = np.zeros(x.shape[1])
    for term in terms:  # in the order of the corners
        total = total + term
    return total


def _half(x: np.ndarray, y: np.ndarray, size: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of convex polygons on the left of the line from a to b: kept corners, and where sides cross it."""
    there = np.arange(len(x))[:, None] < size
    t = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    last, each = np.maximum(size - 1, 0), np.arange(len(size))

    def before(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[last, each][None], v[:-1]])

    s, u, v = before(t), before(x), before(y)
    # as in SQL, what is no number counts as large
    kept, were = ~(t < 0), ~(s < 0)
    way = s / (s - t)
    new = np.stack([(kept != were) & there, kept & there], axis=1).reshape(-1, len(size))
    cx, cy = (np.stack([o + way * (c - o), c], axis=1).reshape(-1, len(size)) for o, c in ((u, x), (v, y)))
    place, left = np.cumsum(new, axis=0) - 1, new.sum(axis=0)
    spot = np.nonzero(new)
    out = np.zeros((2, max(int(left.max(initial=0)), 1), len(size)))
    out[0, place[spot], spot[1]], out[1, place[spot], spot[1]] = cx[spot], cy[spot]
    return out[0], out[1], left


def _overlaps(*corners: pd.Series) -> pd.Series:
    """quad_overlap of many pairs at once; corners are x and y of the first quads' corners, then of the second's."""
    points = np.stack([c.to_numpy(float) for c in corners])
    four = np.full(points.shape[1], 4)
    with np.errstate(all="ignore"):
        turned = []
        for x, y in ((points[0:8:2], points[1:8:2]), (points[8::2], points[9::2])):
            back = _twice_areas(x, y, four) < 0
            x, y = np.where(back, x[::-1], x), np.where(back, y[::-1], y)
            turned.append((x, y, _twice_areas(x, y, four)))
        (x, y, area), (u, v, other) = turned
        size = four
        for i in range(4):
            j = (i + 1) % 4
            x, y, size = _half(x, y, size, u[i], v[i], u[j], v[j])
        inner = np.where(size >= 3, np.abs(_twice_areas(x, y, size)), 0.0)
        return pd.Series(np.where((area <= 0) | (other <= 0), 0.0, inner / (area + other - inner)))


def quad_overlap(one: Column, two: Column) -> Column:
    """Intersection over union of two convex quads (arrays of four points, in either turn); 0 if one has no area, null if
    a corner is missing otherwise. Quads are cut by each other's sides many at a time, as sixteen numbers a row."""
    corners = [F.get(q, F.lit(i))[c].cast("double") for q in (one, two) for i in range(4) for c in ("x", "y")]
    missing = reduce(or_, [c.isNull() for c in corners])
    # what is no number comes back as null
    return F.coalesce(F.pandas_udf(_overlaps, "double")(*corners), F.when(~missing, F.lit(math.nan)))


def whole_ratio(period: Column, pitch: Column) -> tuple[Column, Column]:
    """period / pitch (0 where one isn't positive), and whether it is within 0.15 of a whole number of at least 1."""
    ratio = F.when((period > 0) & (pitch > 0), F.try_divide(period.cast("double"), pitch.cast("double"))).otherwise(0.0)
    return ratio, (F.rint(ratio) >= 1) & (F.abs(ratio - F.rint(ratio)) <= RATIO_EPSILON)
