"""Product quantisation in integers: vectors are cut into parts, and each part is coded by its nearest entry.

The distinct parts of a position, in lexicographic order, are the leaves of a trie over their components. It is
walked depth-first, some thousand leaves at a time: the squared distances of a prefix to all entries are added up
once and shared by all parts that begin with it. At the leaves the smallest distance decides, and parts are
summed by entry with their numbers of occurrences. Spark counts and sorts the distinct parts once; a round sends
no more than a codebook a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import quantised, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Leaves that are walked at once, and distinct parts in a row of the table of parts.
LEAVES, PACKED = 4096, 8192


def cuts(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """(start, end) of each part; if the parts can't be equal, the first ones are one longer."""
    sizes = [length // parts + (i < length % parts) for i in range(parts)]
    return [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(parts)]


def checked(x: np.ndarray) -> np.ndarray:
    """x, if squared distances of its rows surely fit 64 bits."""
    if x.size and max(abs(int(x.min())), abs(int(x.max()))) ** 2 * 4 * max(1, x.shape[1]) >= 2**62:
        raise ValueError("components too large for 64-bit distances")
    return x


def leaf_distances(leaves: np.ndarray, entries: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of distinct rows in lexicographic order to all entries, a run of rows at a time."""
    for low in range(0, len(leaves), LEAVES):
        own = leaves[low : low + LEAVES]
        # the depth at which a row leaves the path of the one before
        turn = np.zeros(len(own), np.int64)
        if own.shape[1]:
            turn[1:] = (own[1:] != own[:-1]).argmax(1)
        sums, node = np.zeros((1, len(entries)), np.int64), np.zeros(len(own), np.int64)
        for depth in range(own.shape[1]):
            starts = np.flatnonzero(turn <= depth)
            apart = own[starts, depth, None] - entries[None, :, depth]
            sums = sums[node[starts]] + apart * apart
            node = np.cumsum(turn <= depth) - 1
        yield slice(low, low + len(own)), sums[node]


def nearest(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its distance."""
    best, error = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    for own, d in leaf_distances(leaves, entries):
        best[own], error[own] = d.argmin(1), d.min(1)
    return best, error


@dataclass(frozen=True)
class Codebooks:
    """A codebook a part: rows of integer components. `length` is that of the vectors they are for."""

    length: int
    entries: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of all components in decimal digits by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.reshape(-1).tolist()).encode()).hexdigest()


def _kept(vectors: DataFrame) -> DataFrame:
    return vectors.where(usable(F.col("embedding"))).withColumn("_v", quantised(F.col("embedding"), SCALE))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (part, x, n) rows as rows of many parts each: x and n as bytes."""
    held: list[pd.DataFrame] = []

    def rows() -> pd.DataFrame:
        pdf = pd.concat(held)
        out = []
        for part, own in pdf.groupby("part", sort=True):
            x = checked(np.array(own["x"].tolist(), np.int64).reshape(len(own), -1))
            out.append((part, len(own), x.tobytes(), own["n"].to_numpy(np.int64).tobytes()))
        held.clear()
        return pd.DataFrame(out, columns=["part", "rows", "x", "n"])

    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= PACKED:
            yield rows()
    if held:
        yield rows()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the vectors in `embedding`, None if there is no usable one.

    Rows take no part whose vector is null, holds a null or non-finite component, or has another length than that of
    the smallest vec_id. Codebooks start as the vectors of the smallest vec_ids (null ids last, equal ids by
    vector); with fewer vectors they have fewer entries. An entry that is nearest to none stays."""
    kept = _kept(vectors)
    first = kept.select("vec_id", "_v").orderBy(F.col("vec_id").asc_nulls_last(), "_v")
    one = first.limit(1).collect()
    if not one:
        return None
    length = len(one[0]["_v"])
    start = first.where(F.size("_v") == length).limit(entries).collect()
    matrix = checked(np.array([r["_v"] for r in start], np.int64).reshape(len(start), length))
    spans = cuts(length, parts)
    books = [matrix[:, a:b].copy() for a, b in spans]
    pieces = F.array(*[F.struct(F.lit(i).alias("part"), F.slice("_v", a + 1, b - a).alias("x")) for i, (a, b) in enumerate(spans)])
    counted = kept.where(F.size("_v") == length).select(F.inline(pieces)).groupBy("part", "x").agg(F.count("*").alias("n"))
    ordered = counted.repartitionByRange(common.partitions(vectors.sparkSession), "part", "x").sortWithinPartitions("part", "x")
    table = common.written(ordered.mapInPandas(_packed, "part int, rows int, x binary, n binary"), "parts")

    def sums(own: list[np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [np.zeros(b.shape, np.int64) for b in own]
            count = [np.zeros(len(b), np.int64) for b in own]
            for pdf in batches:
                for part, rows, x, n in pdf.itertuples(index=False):
                    leaves = np.frombuffer(x, np.int64).reshape(rows, -1)
                    weights = np.frombuffer(n, np.int64)
                    best, _ = nearest(leaves, own[part])
                    np.add.at(total[part], best, leaves * weights[:, None])
                    np.add.at(count[part], best, weights)
            out = [(p, e, d, int(total[p][e, d]), int(count[p][e])) for p in range(len(own)) for e in np.flatnonzero(count[p]).tolist() for d in range(own[p].shape[1])]
            yield pd.DataFrame(out, columns=["part", "entry", "place", "total", "n"])

        return run

    for _ in range(rounds):
        # one number for each component of a codebook comes back
        found = table.mapInPandas(sums(books), "part int, entry int, place int, total long, n long")
        changed = [b.copy() for b in books]
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            changed[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = changed
    return Codebooks(length, tuple(books))


def _coded(books: Codebooks) -> Column:
    spans = cuts(books.length, len(books.entries))

    @F.pandas_udf("code string, error long")
    def run(vectors: pd.Series) -> pd.DataFrame:
        x = checked(np.array(vectors.tolist(), np.int64).reshape(len(vectors), -1))
        code, error = np.empty((len(x), len(spans)), np.uint8), np.zeros(len(x), np.int64)
        for i, (a, b) in enumerate(spans):
            leaves, place = np.unique(x[:, a:b], axis=0, return_inverse=True) if b > a else (np.empty((1, 0), np.int64), np.zeros(len(x), np.int64))
            best, apart = nearest(leaves, books.entries[i])
            code[:, i] = best[place.reshape(-1)]
            error += apart[place.reshape(-1)]
        return pd.DataFrame({"code": [c.tobytes().hex() for c in code], "error": error})

    return run(F.col("_v"))


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The usable rows of that length, with code (an index a part, two hex digits each) and error, the squared
    distances summed over parts; columns of these names are replaced."""
    rest = vectors.drop("code", "error")
    found = _kept(rest).where(F.size("_v") == books.length)
    return found.select(*rest.columns, _coded(books).alias("_coded")).select(*rest.columns, "_coded.*")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows with that label, nulls together) and
    codebooks_sha256 of all usable rows of `vectors` (vec_id, embedding, label); none for a table without any."""
    books = fit(vectors)
    if books is None:
        empty = vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.limit(0)
    coded = encode(vectors.select("vec_id", "embedding", "label"), books).select("vec_id", "label", "code", "error")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
