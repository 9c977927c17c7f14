"""Palettes of pictures: k-means over the colors of many pictures at once, for several k together.

Pixels are counted by color first, so that a round reads different colors, not pixels, and colors are packed, some
thousands of a picture to a row. A round is one join of these rows with the picture's centers, sums of each row in numpy, and one
aggregate of them by picture, k and center.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources import scratch

#: The numbers of fabrics tried, most rounds, and the move below which centers rest.
TRIED, ROUNDS, REST = tuple(range(2, 9)), 50, 0.5
#: Rounds that one job makes before it is seen whether the centers rest.
LOOKED = 5
#: Colors of a block, about.
BLOCK = 4096


def counted(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(image_id, v, n): the different colors of each picture and their numbers; pixels with a null channel are left
    out. v has three numbers, zeros for channels that there aren't."""
    full = pixels.dropna(subset=list(channels))
    three = [F.col(c).cast("double") for c in channels] + [F.lit(0.0)] * (3 - len(channels))
    return full.groupBy("image_id", *channels).agg(F.count("*").alias("n")).select("image_id", F.array(*three).alias("v"), "n")


def packed(colors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, v0, v1, v2, n): the colors of pictures as arrays, dealt by their hash to rows of about `block` at most."""
    tasks = int(colors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = colors.groupBy("image_id").agg(F.ceil(F.count("*") / block).alias("_rows"))
    dealt = colors.join(rows, "image_id", "left").withColumn("_row", F.pmod(F.xxhash64("v"), F.col("_rows"))).repartition(tasks, "image_id", "_row")
    found = dealt.groupBy("image_id", "_row").agg(F.collect_list(F.struct(*[F.get("v", F.lit(j)).alias(f"v{j}") for j in range(3)], "n")).alias("_c"))
    return found.select("image_id", *[F.col(f"_c.{c}").alias(c) for c in ("v0", "v1", "v2", "n")])


def _squared(a: Column, b: Column) -> Column:
    parts = [F.get(a, F.lit(j)) - F.get(b, F.lit(j)) for j in range(3)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _apart(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, a row a center."""
    with np.errstate(invalid="ignore", over="ignore"):
        parts = [v[j][None] - centers[:, j][:, None] for j in range(3)]
        return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _told(blocks: DataFrame, palettes_: DataFrame, fn: Callable[..., dict[str, Sequence]], columns: str) -> DataFrame:
    """image_id and what fn tells of each block, as columns of a few rows: from v, n, and each k and centers of the picture's
    palettes (image_id, k, centers). Blocks are dealt evenly to as many tasks as shuffles have, the rows brought together by picture."""
    by_image = palettes_.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "centers"))).alias("_p"))
    by_image = by_image.select("image_id", F.col("_p.k").alias("_k"), F.transform("_p.centers", lambda c: F.size(c)).alias("_size"), F.flatten(F.flatten("_p.centers")).alias("_flat"))
    # a left join keeps blocks, which are the pictures themselves, from being broadcast; they are small, so Spark would give all to a task or two
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.join(by_image, "image_id", "left").where("_k is not null").repartition(tasks)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {}
            for image_id, v0, v1, v2, n, ks, size, flat in pdf.itertuples(index=False, name=None):
                v, n = np.stack([np.asarray(x, float) for x in (v0, v1, v2)]), np.asarray(n)
                for k, centers in zip(ks, np.split(np.asarray(flat, float).reshape(-1, 3), np.cumsum(size)[:-1]), strict=True):
                    told = fn(v, n, int(k), centers)
                    for name, values in {"image_id": [image_id] * len(next(iter(told.values()))), **told}.items():
                        out.setdefault(name, []).extend(values)
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(each, f"image_id {dict(blocks.dtypes)['image_id']}, {columns}").repartition("image_id")


def _farthest(v: np.ndarray, n: np.ndarray, k: int, centers: np.ndarray) -> dict[str, Sequence]:
    score = np.fmin.reduce(_apart(v, centers), axis=0) * n
    score[np.isnan(score)] = -np.inf
    best = np.flatnonzero(score == score.max())
    at = best[np.lexsort((v[2][best], v[1][best], v[0][best]))[0]]
    return {"s": [-score[at]], "v": [v[:, at].tolist()], "centers": [centers.tolist()]}


def _seeded(colors: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    first = colors.groupBy("image_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "v"))["v"].alias("v"))
    found = first.select("image_id", F.array("v").alias("centers"))
    for _ in range(most - 1):
        told = _told(blocks, found.withColumn("k", F.lit(0)), _farthest, "s double, v array<double>, centers array<array<double>>")
        best = told.groupBy("image_id").agg(F.min(F.struct("s", "v", "centers")).alias("b"))
        more = F.when(F.col("b.s") < 0, F.concat("b.centers", F.array("b.v"))).otherwise(F.col("b.centers"))
        found = best.select("image_id", more.alias("centers"))
    return found


def seeds(colors: DataFrame, most: int = TRIED[-1]) -> DataFrame:
    """(image_id, centers): up to `most` first centers. The first is the most frequent color; each next one has the
    largest product of its number and its squared distance to those before it, ties to the smaller color. A picture
    of fewer colors has fewer."""
    return _seeded(colors, packed(colors), most)


def started(first: DataFrame, tried: Sequence[int] = TRIED) -> DataFrame:
    """(image_id, k, centers) of the k that a picture has enough colors for; one color alone is a palette of one."""
    ks = F.filter(F.array(*[F.lit(k) for k in tried]), lambda k: k <= F.size("centers"))
    each = first.select("image_id", "centers", F.explode(F.when(F.size(ks) > 0, ks).otherwise(F.array(F.size("centers")))).alias("k"))
    return each.select("image_id", "k", F.slice("centers", 1, F.col("k")).alias("centers"))


def _sums(v: np.ndarray, n: np.ndarray, k: int, centers: np.ndarray) -> dict[str, Sequence]:
    """A row a center: the number and the sums of the colors nearest to it (the first of equal ones)."""
    d, most = _apart(v, centers), len(centers)
    own = np.where(np.isnan(d), np.inf, d).argmin(axis=0)
    count = np.bincount(own, n, most).astype(np.int64)
    sums = {f"w{j}": np.bincount(own, v[j] * n, most) for j in range(3)}
    return {"k": [k] * most, "i": range(most), "n": count, **sums, **{f"c{j}": centers[:, j] for j in range(3)}}


def _moved(blocks: DataFrame, centers: DataFrame) -> DataFrame:
    numbers = [f"{c}{j}" for c in "wc" for j in range(3)]
    told = _told(blocks, centers, _sums, "k int, i int, n long, " + ", ".join(f"{c} double" for c in numbers))
    sums = told.groupBy("image_id", "k", "i").agg(F.sum("n").alias("n"), *[F.sum(f"w{j}").alias(f"w{j}") for j in range(3)], *[F.max(f"c{j}").alias(f"c{j}") for j in range(3)])
    old = F.array(*[F.col(f"c{j}") for j in range(3)])
    new = F.array(*[F.when(F.col("n") > 0, F.round(F.try_divide(f"w{j}", "n"), 9)).otherwise(F.col(f"c{j}")) for j in range(3)])
    ways = sums.select("image_id", "k", "i", new.alias("v"), F.sqrt(_squared(old, new)).alias("way"))
    found = ways.groupBy("image_id", "k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_c"), F.max("way").alias("shift"))
    return found.select("image_id", "k", F.col("_c.v").alias("centers"), "shift")


def moved(colors: DataFrame, centers: DataFrame) -> DataFrame:
    """One round: (image_id, k, centers, shift). Each color goes to its nearest center (the first of equal ones), each
    center to the mean of its pixels, in nine digits; one without any stays. shift: the longest way of a center."""
    return _moved(packed(colors), centers)


def _silhouettes(v: np.ndarray, n: np.ndarray, k: int, centers: np.ndarray) -> dict[str, Sequence]:
    d = np.sort(np.sqrt(_apart(v, centers)), axis=0)
    a, b = d[0], d[min(1, len(d) - 1)]
    return {"k": [k], "s": [(((b - a) / np.where(b == 0, 1.0, b)) * n).sum()], "n": [n.sum()]}


def _scored(blocks: DataFrame, centers: DataFrame) -> DataFrame:
    told = _told(blocks, centers, _silhouettes, "k int, s double, n long").groupBy("image_id", "k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    return told.join(centers, ["image_id", "k"], "left").select("image_id", "k", "centers", "silhouette")


def scored(colors: DataFrame, centers: DataFrame) -> DataFrame:
    """(image_id, k, centers, silhouette): the mean over pixels of (b - a) / max(a, b), a the distance to the nearest
    center and b to the next one; 0 for a single center."""
    return _scored(packed(colors), centers)


def palettes(pixels: DataFrame, channels: Sequence[str], tried: Sequence[int] = TRIED, rounds: int = ROUNDS, rest: float = REST) -> DataFrame:
    """(image_id, k, silhouette, ord, v): the palette of each picture, from the darkest first channel on.

    Of all k in `tried` that with the highest silhouette in nine digits is taken, the smaller of equal ones; a
    forced number of fabrics is a `tried` of one. Rounds end when no center of any picture has moved by `rest` or
    more in the last of five, or after `rounds`. Three channels at most. A picture without a whole pixel has no row."""
    spark = pixels.sparkSession
    if not 1 <= len(channels) <= 3:
        raise ValueError(f"{len(channels)} channels")
    path = scratch.folder(spark)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    colors = written(counted(pixels, channels), "colors")
    blocks = written(packed(colors), "blocks")
    at = written(started(_seeded(colors, blocks, max(tried)), tried).withColumn("shift", F.lit(None).cast("double")), "centers_0")
    for done in range(0, rounds, LOOKED):
        for _ in range(min(LOOKED, rounds - done)):
            at = _moved(blocks, at.drop("shift"))
        at = written(at, f"centers_{done + LOOKED}")
        if at.where(F.col("shift") >= rest).isEmpty():
            break
    found = _scored(blocks, at.drop("shift"))
    best = found.groupBy("image_id").agg(F.min(F.struct((-F.round("silhouette", 9)).alias("s"), "k", "silhouette", "centers")).alias("b"))
    found = best.select("image_id", "b.k", "b.silhouette", F.posexplode(F.array_sort("b.centers")).alias("ord", "v"))
    return found.withColumn("v", F.slice("v", 1, len(channels)))
