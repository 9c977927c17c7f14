"""Mixing sources to target weights by weighted fair queueing, in Spark expressions only.

Each source's documents are shuffled by a keyed hash into a stream that runs through them twice at most.
A document's virtual finish time is the source's cumulative size up to it, divided by the source's
target. Ordered by finish time over all sources and cut off at the total budget, the mix takes from
each source in proportion to its target. Running sums are taken in buckets, so that neither a hot
source nor the whole order passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
SEED = "mix-1"
#: Virtual time is cut into 2**22 steps, 2**11 of which make a coarse one.
_FINE, _COARSE = 22, 11
#: Rows equal in doc_id and text are numbered in so many parts.
_SALTS = 64


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size): shares of the budget by
    weight, none above cap times its source's size; what is cut off goes to the others by weight.
    One row a source."""
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_fill = W.orderBy(F.col("full") / F.col("weight"), "rank")
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("full", F.col("source_size") * cap)
        .withColumn("position", F.row_number().over(by_fill))
        .withColumn("before", F.coalesce(F.sum("full").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("left"))
        .withColumn("is_full", F.col("full") / F.col("weight") <= F.col("level"))
    )
    first_open = F.min(F.when(~F.col("is_full"), F.struct("position", "level"))).over(everything)["level"]
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(F.col("weight") * first_open)
    return filled.select("source", "source_size", "rank", "weight", target.alias("target"))


def _finish(copy: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("cum") + F.lit(copy) * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and taken to rows (doc_id, source, size and any other columns, whatever their names).

    taken is size times the copies in the mix, 0 to 2 of them. A null source is a source of its own, the
    last in order; a null doc_id shuffles like any other; documents of size 0 take nothing; rows of
    one doc_id are ordered by text_hash (a hash of all their columns, if there is none), and among equal rows it is left open which is taken last. An empty table stays empty."""
    spark = sized.sparkSession
    own = [F.col(f"`{c}`") for c in sized.columns if c.lower() not in ("source_size", "target", "taken")]
    tie = F.col("text_hash") if "text_hash" in sized.columns else F.xxhash64(*own)
    # rows without an id have a key each, so that they don't meet in one bucket
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), tie.cast("string")))).cast("binary"))
    items = common.written(sized.select(F.struct(*own).alias("own"), "doc_id", "source", "size", tie.alias("tie"), key.alias("_key")), "mix_items")
    sources = common.written(targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix_sources")
    budget = sources.agg(F.sum("target")).first()[0]
    if budget is None:
        return items.select("own.*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken")).limit(0)
    budget = sources.agg(F.sum("source_size") * F.lit(float(share))).first()[0]

    n = 4 * common.partitions(spark)
    bucketed = items.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int"))
    sums = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("s"))
    before = sums.withColumn("_before", F.sum("s").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).drop("s")
    within = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    run = bucketed.withColumn("_run", F.sum("size").over(within))
    run = run.alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r._bucket") == F.col("b._bucket")), "left")
    run = run.select("r.*", (F.col("_before") + F.col("_run")).alias("cum"))
    timed = run.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    timed = timed.select(*[F.col(f"r.{c}") for c in ("own", "doc_id", "size", "tie", "_key", "cum")], "s.source_size", "s.rank", "s.target")
    timed = common.written(timed.select("*", _finish(0).alias("_f0"), _finish(1).alias("_f1")), "mix_times")

    def step(f: str, bits: int) -> Column:
        """A finish time, up to 4, as a whole number of `bits` bits."""
        return F.least(F.floor(F.col(f) * F.lit(1 << (bits - 2))), F.lit((1 << bits) - 1)).cast("int")

    def copies(rows: DataFrame) -> DataFrame:
        both = [F.struct(F.lit(i).alias("copy"), F.col(f"_f{i}").alias("finish"), step(f"_f{i}", _FINE).alias("fine")) for i in (0, 1)]
        return rows.where("size > 0").select("rank", "_key", "doc_id", "size", "tie", F.explode(F.array(*both)).alias("c")).select("rank", "_key", "doc_id", "size", "tie", "c.*")

    def cut(rows: DataFrame, by: Column, spent: int) -> tuple[int | None, int]:
        """The step in which the budget runs out, and what the steps before it take."""
        totals = rows.groupBy(by.alias("k")).agg(F.sum("size").alias("s"))
        run = totals.withColumn("e", F.sum("s").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) + F.lit(spent))
        row = run.where(F.col("e") > F.lit(budget)).orderBy("k").select("k", (F.col("e") - F.col("s")).alias("b")).first()
        return (row["k"], row["b"]) if row else (None, 0)

    every = copies(timed)
    shift = 1 << (_FINE - _COARSE)
    coarse, spent = cut(every, F.floor(F.col("fine") / shift), 0)
    if coarse is None:  # the budget takes both copies of every document
        return timed.select("own.*", "source_size", "target", (F.col("size") * 2).alias("taken"))
    inside = every.where(F.floor(F.col("fine") / shift) == coarse)
    fine, spent = cut(inside, F.col("fine"), spent)
    order = W.orderBy("finish", "rank", "copy", "_key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    last = inside.where(F.col("fine") == fine).withColumn("e", F.sum("size").over(order) + F.lit(spent)).where(F.col("e") <= F.lit(budget))
    edge = last.orderBy(*[F.col(c).desc() for c in ("finish", "rank", "copy", "_key", "doc_id", "size", "tie")]).select("finish", "rank", "copy", "_key").first()

    def taken(copy: int) -> Column:
        f = step(f"_f{copy}", _FINE)
        if edge is None:
            return (f < fine).cast("long")
        at = F.struct(F.col(f"_f{copy}"), F.col("rank"), F.lit(copy), F.col("_key"))
        end = F.struct(F.lit(edge["finish"]), F.lit(edge["rank"]).cast("int"), F.lit(edge["copy"]), F.lit(edge["_key"]))
        return ((f < fine) | ((f == fine) & (at <= end))).cast("long")

    return timed.select("own.*", "source_size", "target", (F.col("size") * (taken(0) + taken(1))).alias("taken"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (words; null and empty texts have none) and text_hash of every row."""
    return docs.select("doc_id", "source", common.word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"))


def apply(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies there, 0 to 2; in no order. Among rows equal
    in doc_id, source and text the copies are dealt out one by one. Null and empty texts are not taken; an empty
    table stays empty; the names of other columns don't matter."""
    key = (F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.xxhash64("doc_id", "source", text).alias("_hash"))
    items = docs.select("doc_id", "source", common.word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"), *key).where("size > 0")
    taken = plan(items, **options).groupBy("_id", "_hash").agg(F.count("*").alias("_rows"), F.sum((F.col("taken") / F.col("size")).cast("int")).alias("_copies"))
    taken = common.written(taken.where("_copies > 0"), "mix_copies")
    bounded = taken.count() <= 1_000_000  # some 60 MB at most; beyond it both sides are shuffled
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *key).join(F.broadcast(taken) if bounded else taken, ["_id", "_hash"])
    once = joined.where("_rows = 1").select("own", F.col("_copies").cast("int").alias("n"))
    if taken.where("_rows > 1").isEmpty():
        return _repeated(once)
    # equal rows are dealt out to salts first, so that no task numbers more than a share of them; as a written
    # table they keep their salts
    salted = common.written(joined.where("_rows > 1").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SALTS))), "mix_salted")
    own = W.partitionBy("_id", "_hash", "salt")
    numbered = salted.withColumn("place", F.row_number().over(own.orderBy("_hash")))
    sizes = common.written(salted.groupBy("_id", "_hash", "salt").agg(F.count("*").alias("k")), "mix_equal")
    before = sizes.withColumn("before", F.sum("k").over(W.partitionBy("_id", "_hash").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")).drop("k")
    numbered = numbered.join(before, ["_id", "_hash", "salt"])
    place = F.col("before") + F.col("place")
    # the r-th of n equal rows gets the r-th share of their copies
    share = F.floor(place * F.col("_copies") / F.col("_rows")) - F.floor((place - 1) * F.col("_copies") / F.col("_rows"))
    return _repeated(once.unionByName(numbered.select("own", share.cast("int").alias("n"))))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row `own` n times."""
    return rows.where("n > 0").select("own", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("own.*")
