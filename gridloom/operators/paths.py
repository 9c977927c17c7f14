"""Walks of a pointer over a grid: the cells a line of samples passes, and the edges it crosses.

Steps of a line are numbered without walking it: a step across a column comes after as many steps across rows as lie
before it on the line, which one whole division tells. So a line of any length is a row generator, and each step knows
the cell that it comes from. Lines know how many cells lie before them on their path, so cells are in order without sorting them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.lengths import int_div

#: Samples of a task, about; a path is walked by one task.
TASK_SAMPLES = 50_000


def _steps(segments: DataFrame) -> DataFrame:
    """All columns of segments with _step, _r, _c and the cell before, _br, _bc, which a line's first cell doesn't have."""
    dx, dy = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    s = segments.dropna(subset=["r0", "c0", "r1", "c1"]).withColumns({"_nx": F.abs(dx).cast("long"), "_ny": F.abs(dy).cast("long"), "_sx": F.signum(dx).cast("long"), "_sy": F.signum(dy).cast("long")})
    nx, ny = F.col("_nx"), F.col("_ny")

    def steps(n: Column, of) -> Column:
        # sequence counts down from 0 to -1, so an empty one is made by filter
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n), of)

    def across(i: Column) -> Column:
        rows = int_div((2 * i + 1) * ny + nx - 1, 2 * F.greatest(nx, F.lit(1)))
        return F.struct((i + rows + 1).alias("step"), rows.alias("dr"), (i + 1).alias("dc"), F.lit(True).alias("across"))

    def down(i: Column) -> Column:
        cols = F.least(nx, int_div((2 * i + 1) * nx + ny, 2 * F.greatest(ny, F.lit(1))))
        return F.struct((i + cols + 1).alias("step"), (i + 1).alias("dr"), cols.alias("dc"), F.lit(False).alias("across"))

    zero = F.array(F.struct(*[F.lit(0).cast("long").alias(k) for k in ("step", "dr", "dc")], F.lit(None).cast("boolean").alias("across")))
    each = s.withColumn("_s", F.explode(F.concat(zero, steps(nx, across), steps(ny, down))))
    r, c, turn = (F.col("r0") + F.col("_sy") * F.col("_s.dr")).cast("long"), (F.col("c0") + F.col("_sx") * F.col("_s.dc")).cast("long"), F.col("_s.across")
    before = [F.when(turn, r).when(~turn, r - F.col("_sy")), F.when(turn, c - F.col("_sx")).when(~turn, c)]
    return each.select(*segments.columns, F.col("_s.step").alias("_step"), r.alias("_r"), c.alias("_c"), before[0].alias("_br"), before[1].alias("_bc"))


def line_cells(segments: DataFrame) -> DataFrame:
    """All columns of segments (r0, c0, r1, c1 among them) with step, r, c: the cells from one to the other, both
    included, each sharing an edge with the one before; through a corner the column changes first. Segments with a
    null end have none."""
    return _steps(segments).select(*segments.columns, F.col("_step").alias("step"), F.col("_r").alias("r"), F.col("_c").alias("c"))


def _lines(samples: DataFrame) -> DataFrame:
    """(path_id, place, r0, c0, r1, c1) of the lines between samples that follow each other by place, dealt by path to as many
    tasks as shuffles have, or more, so that the samples of a task, and what is made of them, do not grow with the table.
    Samples are a few numbers each, so Spark would put far more of them together than their cells allow."""
    tasks = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(samples.count() / TASK_SAMPLES))
    order = W.partitionBy("path_id").orderBy("place")
    dealt = samples.select("path_id", "place", "r", "c").repartition(tasks, "path_id")
    ends = dealt.select("path_id", "place", F.col("r").alias("r0"), F.col("c").alias("c0"), F.lead("r").over(order).alias("r1"), F.lead("c").over(order).alias("c1"), F.lag("r").over(order).alias("_before"))
    return ends.where("r1 is not null or _before is null").select("path_id", "place", "r0", "c0", F.coalesce("r1", "r0").alias("r1"), F.coalesce("c1", "c0").alias("c1"))


def walks(samples: DataFrame) -> DataFrame:
    """(path_id, place, step, r, c) from samples (path_id, place, r, c): the cells of the lines between samples that follow
    each other by place; a path of one sample is its cell. Cells where lines meet come twice."""
    return line_cells(_lines(samples)).select("path_id", "place", "step", "r", "c")


def _walked(samples: DataFrame) -> DataFrame:
    """(path_id, at, r, c, br, bc): the cells of walks, their places on the whole path, counted from 0, and the cells before them."""
    order = W.partitionBy("path_id").orderBy("place")
    cells = (F.abs(F.col("r1") - F.col("r0")) + F.abs(F.col("c1") - F.col("c0"))).cast("long") + 1
    lines = _lines(samples).dropna(subset=["r0", "c0", "r1", "c1"])
    told = lines.select("*", F.sum(cells).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_at"), F.lag("r1").over(order).alias("_lr"), F.lag("c1").over(order).alias("_lc"))
    at = F.coalesce("_at", F.lit(0)) + F.col("_step")
    return _steps(told).select("path_id", at.alias("at"), F.col("_r").alias("r"), F.col("_c").alias("c"), F.coalesce("_br", "_lr").alias("br"), F.coalesce("_bc", "_lc").alias("bc"))


def _numbered(met: DataFrame, *names: str) -> DataFrame:
    """The different `names` of each path, in the order in which they are first met. `at` is one number, so the first one of each
    is kept in a hash table and only these are sorted."""
    first = met.groupBy("path_id", *names).agg(F.min("at").alias("at"))
    ord_ = F.row_number().over(W.partitionBy("path_id").orderBy("at"))
    return first.select("path_id", (ord_ - 1).cast("long").alias("ord"), *names)


def strokes(samples: DataFrame) -> DataFrame:
    """(path_id, ord, r, c): the different cells of each walk, in the order in which they are first met."""
    return _numbered(_walked(samples), "r", "c")


def crossed(samples: DataFrame) -> DataFrame:
    """(path_id, ord, r, c, dir): the different edges between cells that each walk crosses, in the order in which they
    are first met; an edge is named by its upper or left cell."""
    dr, dc = F.abs(F.col("r") - F.col("br")), F.abs(F.col("c") - F.col("bc"))
    met = _walked(samples).where(dr + dc == 1)
    return _numbered(met.select("path_id", "at", F.least("r", "br").alias("r"), F.least("c", "bc").alias("c"), F.when(dc == 1, "v").otherwise("h").alias("dir")), "r", "c", "dir")
