"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of each batch as stars: every node linked to the least that the batch connects it with."""
    for pdf in batches:
        above: dict[str, str] = {}

        def top(x: str, above: dict[str, str] = above) -> str:
            root = x
            while above.get(root, root) != root:
                root = above[root]
            while x != root:
                above[x], x = root, above.get(x, root)
            return root

        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            x, y = top(a), top(b)
            if x != y:
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pd.DataFrame({"a": [top(x) for x in nodes], "b": nodes}, dtype=object)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return others.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _is_settled(links: DataFrame) -> bool:
    """Whether all are stars: no node is both the smaller and the larger of links, none the larger of two."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("k")).unionByName(links.select(F.col("a").alias("node"), F.lit(0).alias("k")).distinct())
    ends = ends.groupBy("node").agg(F.sum("k").alias("larger"), F.min("k").alias("least"))
    return ends.where("larger > 1 or (larger = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the component's smallest node.

    Each round is written to the shared folder, so a lost executor costs a round at most. Nodes without
    an edge don't appear; self-loops and repeated edges do no harm; an empty table stays empty."""
    links = edges.where("a <> b").select("a", "b").mapInPandas(_forest, "a string, b string").distinct()
    links = common.written(links, "links")
    for _ in range(most_rounds):
        if _is_settled(links):
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        links = common.written(_small_star(_large_star(links)), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
