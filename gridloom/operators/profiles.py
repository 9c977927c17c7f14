"""One-dimensional profiles (series_id, pos, value), positions running from 0: autocorrelation, peaks, phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_PITCH = 5
#: Multiples of a lag that refine it, and how far from each its peak may lie.
_MULTIPLES, _NEAR = (2, 3, 4, 5, 6), 2


def autocorrelation(profile: DataFrame, most_lags: int | None = None) -> DataFrame:
    """(series_id, lag, corr) of mean-centred values, relative to lag 0; zeros for a flat series. All lags, or those
    up to most_lags for callers who need no others: a series of n positions makes n * (n + 1) / 2 products."""
    mean = F.avg("value").over(W.partitionBy("series_id"))
    x = profile.select("series_id", "pos", (F.col("value") - mean).alias("x"))
    n = F.max("pos").over(W.partitionBy("series_id"))
    # no lag beyond what follows the position has a partner
    lags = F.col("n") - F.col("pos") if most_lags is None else F.least(F.col("n") - F.col("pos"), F.lit(most_lags))
    moved = x.withColumn("n", n).select("series_id", "x", F.explode(F.sequence(F.lit(0), lags.cast("int"))).alias("lag"), "pos")
    ahead = x.select("series_id", F.col("pos").alias("at"), F.col("x").alias("y"))
    sums = moved.withColumn("at", F.col("pos") + F.col("lag")).join(ahead, ["series_id", "at"]).groupBy("series_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(W.partitionBy("series_id"))
    return sums.select("series_id", "lag", F.when(zero > 0, F.col("s") / zero).otherwise(0.0).alias("corr"))


def spikes(profile: DataFrame) -> DataFrame:
    """(series_id, pos, spike): 1 at local maxima above mean plus standard deviation and beside them, else 0."""
    whole, order = W.partitionBy("series_id"), W.partitionBy("series_id").orderBy("pos")
    x = profile.select("series_id", "pos", "value", (F.avg("value").over(whole) + F.stddev_pop("value").over(whole)).alias("bar"), F.lag("value").over(order).alias("before"), F.lead("value").over(order).alias("after"))
    top = (F.col("value") > F.col("bar")) & (F.col("value") >= F.col("before")) & (F.col("value") >= F.col("after"))
    peak = x.select("series_id", "pos", F.coalesce(top, F.lit(False)).cast("int").alias("p"))
    beside = [F.coalesce(f("p").over(order), F.lit(0)) for f in (F.lag, F.lead)]
    return peak.select("series_id", "pos", F.greatest("p", *beside).cast("double").alias("spike"))


def pitch(profile: DataFrame, most: int) -> DataFrame:
    """(series_id, pitch, lag, prominence) of the series whose spikes repeat.

    lag is the smallest peak of the spikes' autocorrelation, from 5 to below `most`, that is at least half as high
    as the highest, and prominence its height. pitch refines it: the top of a parabola through the peak and its
    neighbours, or, where that is over 1 % off it, the mean of the nearest peaks at 2 to 6 times the lag, each
    divided by its multiple; so spacings that take turns come out near their mean. Heights equal in nine
    digits tie, and the smaller lag wins. A series that is too short or has no peak gives no row."""
    corr = autocorrelation(spikes(profile).select("series_id", "pos", F.col("spike").alias("value")), _MULTIPLES[-1] * most + _NEAR)
    last = profile.groupBy("series_id").agg(F.max("pos").alias("last"))
    heights = F.map_from_entries(F.collect_list(F.struct(F.col("lag").cast("long"), F.round("corr", 9))))
    curve = corr.groupBy("series_id").agg(heights.alias("c")).join(last, "series_id")

    def at(lag: Column) -> Column:
        return F.coalesce(F.try_element_at("c", lag.cast("long")), F.lit(0.0))

    end = F.least(F.lit(most), F.col("last")).cast("long") - 2
    tops = F.filter(F.sequence(F.lit(LEAST_PITCH + 1).cast("long"), end), lambda i: (at(i) >= at(i - 1)) & (at(i) >= at(i + 1)) & (at(i) > 0))
    peaked = curve.where(end > LEAST_PITCH).withColumn("tops", tops).withColumn("top", F.array_max(F.transform("tops", at)))
    based = peaked.withColumn("lag", F.get(F.filter("tops", lambda i: at(i) >= 0.5 * F.col("top")), F.lit(0))).where("lag is not null")

    lag = F.col("lag")
    before, here, after = at(lag - 1), at(lag), at(lag + 1)
    bend = before - 2 * here + after
    shift = F.when(F.abs(bend) > 1e-9, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / bend))).otherwise(0.0)

    def highest(k: Column) -> Column:
        around = F.sequence(k * lag - _NEAR, k * lag + _NEAR)
        return F.array_max(F.transform(around, lambda j: F.struct(at(j).alias("height"), (-j).alias("j"), k.alias("k"))))

    multiples = F.filter(F.array(*[F.lit(k) for k in _MULTIPLES]), lambda k: k * lag + _NEAR <= F.col("last"))
    found = F.filter(F.transform(multiples, highest), lambda x: x["height"] > 0)
    mean = F.aggregate(found, F.lit(0.0), lambda s, x: s - x["j"] / x["k"]) / F.nullif(F.size(found), F.lit(0))
    fitted = based.select("series_id", "lag", here.alias("height"), (lag + shift).alias("fitted"), mean.alias("mean"))
    far = F.coalesce(F.abs(F.col("mean") - F.col("fitted")) / F.col("mean") > 0.01, F.lit(False))
    refined = F.round(F.when(far, F.col("mean")).otherwise(F.col("fitted")), 9)
    return fitted.select("series_id", refined.alias("pitch"), "lag", F.least(F.lit(1.0), F.col("height")).alias("prominence"))


def phase(profile: DataFrame, pitches: DataFrame, step: float = 0.25) -> DataFrame:
    """(series_id, offset, score): of the offsets below the pitch, the first whose lines gather most. A line
    falls on the nearest position, halves on the even one."""
    n = profile.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    p = pitches.join(n, "series_id").select("series_id", F.col("pitch").cast("double").alias("pitch"), "n")
    tries = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pitch") / step).cast("int") - 1))).withColumn("offset", F.col("k") * F.lit(step))
    count = F.ceil((F.col("n") - F.col("offset")) / F.col("pitch")).cast("int")
    lines = tries.withColumn("line", F.explode(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))))).withColumn("at", F.col("offset") + F.col("line") * F.col("pitch"))
    placed = lines.select("series_id", "offset", F.greatest(F.lit(0), F.least(F.bround("at").cast("long"), F.col("n") - 1)).alias("pos"))
    sums = placed.join(profile, ["series_id", "pos"]).groupBy("series_id", "offset").agg(F.sum("value").alias("score"))
    best = sums.groupBy("series_id").agg(F.max(F.struct("score", (-F.col("offset")).alias("k"))).alias("b"))
    return best.select("series_id", (-F.col("b.k")).alias("offset"), F.col("b.score").alias("score"))
