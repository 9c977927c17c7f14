"""Repeating structure of grids: blocks, strip sets, periods, repeats and re-tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.lengths import ceil_div, int_div

MOST_TYPES = 8
#: Shares of equal cells from which on a shift is a repeat at once, or relative to the best one.
EXACT, SOFT = 0.999, 0.95


def _sorted_text(key: Column, value: Column, sep: str = "") -> Column:
    """The values of a group joined in the order of the key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"]), sep)


def dims(cells: DataFrame) -> DataFrame:
    return cells.groupBy("model_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))


def block_signatures(cells: DataFrame) -> DataFrame:
    """(model_id, p, br, bc, sig): the content of each p x p block, for every p > 1 that divides both sides."""
    whole = W.partitionBy("model_id")
    sized = cells.where("model_id is not null").select("model_id", "r", "c", "fabric_id", (F.max("r").over(whole) + 1).alias("rows"), (F.max("c").over(whole) + 1).alias("cols"))
    divisors = F.filter(F.sequence(F.lit(2), F.greatest(F.least("rows", "cols"), F.lit(2))), lambda p: (F.col("rows") % p == 0) & (F.col("cols") % p == 0))
    placed = sized.select("model_id", "r", "c", "fabric_id", F.explode(divisors).alias("p"))
    place = F.struct(F.col("r") % F.col("p"), F.col("c") % F.col("p"))
    keys = ["model_id", "p", int_div(F.col("r"), F.col("p")).alias("br"), int_div(F.col("c"), F.col("p")).alias("bc")]
    return placed.groupBy(*keys).agg(_sorted_text(place, F.col("fabric_id"), ",").alias("sig"))


def block_layout(cells: DataFrame) -> DataFrame:
    """(model_id, size, br, bc, type, sig): the smallest block size with at most 8 different blocks, which are
    numbered by first appearance in reading order. Models without such a size have no rows."""
    # windows within a model, in place of joins of the blocks with what is counted of them: blocks are made once, and stay
    # where their model is
    blocks, model, place = block_signatures(cells), W.partitionBy("model_id"), F.struct("br", "bc")
    ranked = blocks.withColumn("types", F.dense_rank().over(W.partitionBy("model_id", "p").orderBy("sig")))
    counted = ranked.withColumn("types", F.max("types").over(W.partitionBy("model_id", "p"))).where(F.col("types") <= MOST_TYPES)
    kept = counted.withColumn("size", F.min("p").over(model)).where("p = size")
    first = kept.withColumn("first", F.min(place).over(W.partitionBy("model_id", "sig")))
    number = F.dense_rank().over(model.orderBy("first")) - 1
    return first.select("model_id", "size", "br", "bc", number.alias("type"), "sig").hint("merge")


def types_of(layout: DataFrame) -> DataFrame:
    """(model_id, size, type, sig, count) of a block layout."""
    return layout.groupBy("model_id", "size", "type", "sig").agg(F.count("*").alias("count")).hint("merge")


def block_types(cells: DataFrame) -> DataFrame:
    """(model_id, size, type, sig, count)."""
    return types_of(block_layout(cells))


def strip_sets(types: DataFrame, quilts: DataFrame) -> DataFrame:
    """(model_id, set, sequence, width, needed, per_set, sets): the distinct rows of block types, numbered by
    first appearance over (type, row), and how many strips cut across the fabric's width they take."""
    row = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size").cast("int") - 1), lambda i: F.slice(F.split("sig", ","), i * F.col("size").cast("int") + 1, F.col("size").cast("int"))))
    rows = types.select("model_id", "type", "count", row.alias("row", "sequence"))
    sums = rows.groupBy("model_id", "sequence").agg(F.sum("count").alias("needed"), F.min(F.struct("type", "row")).alias("first"))
    sets = sums.withColumn("set", F.row_number().over(W.partitionBy("model_id").orderBy("first"))).drop("first")
    width = F.col("cell_size") + 2 * F.col("seam_allowance")
    sized = sets.join(quilts.select("model_id", width.alias("width"), "wof"), "model_id").withColumn("per_set", int_div(F.col("wof"), F.col("width")))
    return sized.select("model_id", "set", "sequence", "width", "needed", "per_set", ceil_div(F.col("needed"), F.col("per_set")).alias("sets")).hint("merge")


def lines(cells: DataFrame) -> DataFrame:
    """(model_id, axis, i, sig): every row and column as a text."""
    rows = cells.groupBy("model_id", F.lit("row").alias("axis"), F.col("r").alias("i")).agg(_sorted_text(F.col("c"), F.col("fabric_id"), ",").alias("sig"))
    cols = cells.groupBy("model_id", F.lit("col").alias("axis"), F.col("c").alias("i")).agg(_sorted_text(F.col("r"), F.col("fabric_id"), ",").alias("sig"))
    return rows.unionByName(cols)


def least_periods(cells: DataFrame) -> DataFrame:
    """(model_id, axis, n, period): the smallest p by which every line equals the one p before it, else n. It
    needn't divide n. A pair of lines is looked at once, keyed by its distance."""
    seq = lines(cells).groupBy("model_id", "axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sig"))), lambda x: x["sig"]).alias("s"))
    n = F.size("s")

    def repeats(p: Column) -> Column:
        return F.forall(F.sequence(p, n - 1), lambda i: F.get(F.col("s"), i) == F.get(F.col("s"), i - p))

    found = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda p: (p < n) & repeats(p))
    return seq.select("model_id", "axis", n.alias("n"), F.coalesce(F.get(found, F.lit(0)), n).alias("period"))


def shift_scores(cells: DataFrame) -> DataFrame:
    """(model_id, axis, shift, score): the share of cells that equal the one `shift` further, per axis."""
    size = dims(cells)

    def along(axis: str, across: str, extent: str) -> DataFrame:
        a = cells.select("model_id", F.col(axis).alias("at"), F.col(across).alias("line"), F.col("fabric_id").alias("f"))
        # every cell goes to the half of the grid's shifts, no further
        spread = a.join(size.select("model_id", F.col(extent).alias("n")), "model_id").where("n > 1")
        spread = spread.select("*", F.explode(F.sequence(F.lit(1), F.greatest(int_div(F.col("n"), 2), F.lit(1)).cast("int"))).alias("shift"))
        moved = spread.select("model_id", (F.col("at") + F.col("shift")).alias("at"), "line", "shift", F.col("f").alias("g"))
        pairs = moved.join(a, ["model_id", "at", "line"])
        return pairs.groupBy("model_id", "shift").agg(F.avg((F.col("f") == F.col("g")).cast("double")).alias("score")).withColumn("axis", F.lit(axis))

    return along("r", "c", "rows").unionByName(along("c", "r", "cols")).select("model_id", "axis", "shift", "score")


def repeats(cells: DataFrame) -> DataFrame:
    """(model_id, period_rows, period_cols, confidence): per axis the first shift that matches exactly, else
    the smallest one comparably strong to the best; 0 if nothing matches."""
    scores = shift_scores(cells).withColumn("best", F.max("score").over(W.partitionBy("model_id", "axis")))
    good = (F.col("score") >= EXACT, (F.col("best") > 0) & (F.col("score") >= SOFT * F.col("best")))
    exact, soft = (F.min(F.when(g, F.struct("shift", "score"))) for g in good)
    axis = scores.groupBy("model_id", "axis").agg(F.coalesce(exact, soft).alias("x"))
    period = F.coalesce(F.col("x.shift"), F.lit(0))
    score = F.coalesce(F.col("x.score"), F.lit(0.0))
    by_axis = axis.groupBy("model_id").agg(
        F.max(F.when(F.col("axis") == "r", period)).alias("pr"), F.max(F.when(F.col("axis") == "c", period)).alias("pc"),
        F.min(score).alias("least"), F.count("*").alias("axes"),
    )
    return dims(cells).join(by_axis, "model_id", "left").select(
        "model_id", F.coalesce("pr", F.lit(0)).alias("period_rows"), F.coalesce("pc", F.lit(0)).alias("period_cols"),
        F.when(F.col("axes") == 2, F.col("least")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def regridded(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of grids brought to (model_id, new_rows, new_cols): what fits stays, the rest continues the least
    row and column periods with confidence 1."""
    periods = least_periods(cells).groupBy("model_id").agg(
        F.max(F.when(F.col("axis") == "row", F.col("period"))).alias("pr"), F.max(F.when(F.col("axis") == "col", F.col("period"))).alias("pc"),
        F.max(F.when(F.col("axis") == "row", F.col("n"))).alias("rows"), F.max(F.when(F.col("axis") == "col", F.col("n"))).alias("cols"),
    )
    spine = targets.join(periods, "model_id").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("new_rows") - 1)))
    spine = spine.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("new_cols") - 1)))
    source = spine.select(
        "model_id", "r", "c", F.when(F.col("r") < F.col("rows"), F.col("r")).otherwise(F.col("r") % F.col("pr")).alias("sr"),
        F.when(F.col("c") < F.col("cols"), F.col("c")).otherwise(F.col("c") % F.col("pc")).alias("sc"),
        ((F.col("r") < F.col("rows")) & (F.col("c") < F.col("cols"))).alias("kept"),
    )
    known = cells.select("model_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "fabric_id", "confidence")
    return source.join(known, ["model_id", "sr", "sc"]).select("model_id", "r", "c", "fabric_id", F.when(F.col("kept"), F.col("confidence")).otherwise(F.lit(1.0)).alias("confidence"))
