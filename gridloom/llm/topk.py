"""Exact top-k search by inner product, with branch and bound over blocks of dimensions.

Vectors are packed into blocks in vertical layout (a row per dimension). For a query, scores are
accumulated eight dimensions at a time; a candidate stays while its score so far and the most that its
remaining mass allows (Cauchy-Schwarz) reach the k-th best score known, and the survivors are compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


STEP = 8


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(embedding: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    return embedding.isNotNull() & F.coalesce(F.forall(embedding, finite), F.lit(False))


def _most(x: np.ndarray) -> int:
    """The largest magnitude, exact for the least 64-bit integer too."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def _packed(pdf: pd.DataFrame) -> dict:
    matrix = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), len(pdf["v"].iloc[0]))
    most = _most(matrix)
    kind = next((k for k in (np.int16, np.int32) if most <= np.iinfo(k).max), np.int64)
    return {"ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "body": np.ascontiguousarray(matrix.T.astype(kind)).tobytes()}


def _matrix(ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the vectors as columns; the bytes a component takes follow from the number of both."""
    names = np.frombuffer(ids, np.int64)
    if not dim:
        return names, np.zeros((0, len(names)), np.int64)
    return names, np.frombuffer(body, f"<i{len(body) // max(1, len(names) * dim)}").astype(np.int64).reshape(dim, len(names))


def _remaining(x: np.ndarray) -> np.ndarray:
    """Norms of what is left from each block of dimensions on, a row per block."""
    squares = x.astype(float) ** 2
    starts = range(0, len(x), STEP)
    return np.sqrt(np.stack([squares[s:].sum(0) for s in starts])) if len(x) else np.zeros((1, x.shape[1]))


def best(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, rest: np.ndarray, k: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best (score, id) of known ones and the block x, ties to smaller ids."""
    q_rest = _remaining(q[:, None])[:, 0]
    floor = known[-1][0] if len(known) >= k else None
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    for b, s in enumerate(range(0, len(q), STEP)):
        score = score + q[s : s + STEP] @ x[s : s + STEP, alive]
        if s + STEP >= len(q) or not len(alive):
            break
        room = q_rest[b + 1] * rest[b + 1][alive]
        least = score - room
        bar = floor
        if len(alive) >= k:  # the k-th largest score that is certain
            sure = np.partition(least, len(least) - k)[len(least) - k]
            bar = sure if bar is None else max(bar, sure)
        if bar is not None:
            keep = score + room >= bar - 1e-6 * (1 + abs(bar))
            alive, score = alive[keep], score[keep]
    merged = known + list(zip(score.tolist(), ids[alive].tolist(), strict=True))
    return sorted(merged, key=lambda t: (-t[0], t[1]))[:k]


def search(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 4096, queries_a_block: int = 1024, blocks_a_salt: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): for each distinct query id its k highest integer inner products.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without a
    vec_id. Rows that repeat a query's id are one query (the least vector) and no candidates of it;
    other repeated rows are candidates each. Only vectors of the query's length are compared; empty ones score 0.
    If a score might not fit 64 bits, a ValueError says so. Every
    query meets every candidate block; candidates are dealt out by salts, about blocks_a_salt blocks each, and
    query blocks are copied to all salts, so that tasks grow in number with the candidates."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("v"), is_query.alias("q"))
    rows = rows.withColumn("dim", F.size("v"))
    queries = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n_blocks = max(1, -(-queries.count() // queries_a_block))
    salts = max(1, -(-rows.count() // (block * blocks_a_salt)))

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"qb": pdf["qb"].iloc[0], "dim": pdf["dim"].iloc[0], **{f"q_{a}": b for a, b in _packed(pdf).items()}}])

    packed_queries = (
        queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).groupBy("qb", "dim")
        .applyInPandas(pack_queries, "qb int, dim int, q_ids binary, q_body binary")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                blocks = [part.iloc[i : i + block] for i in range(0, len(part), block)]
                yield pd.DataFrame([{"dim": dim, **_packed(b)} for b in blocks])

    candidates = rows.select("vec_id", "v", "dim").mapInPandas(pack, "dim int, ids binary, body binary")
    salt = F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")
    candidates = candidates.withColumn("salt", salt).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    packed_queries = packed_queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list[tuple[int, int]]] = {}
        for pdf in batches:
            for dim, q_ids, q_body, ids, body in zip(*(pdf[c] for c in ("dim", "q_ids", "q_body", "ids", "body")), strict=True):
                names, q = _matrix(q_ids, q_body, dim)
                own, x = _matrix(ids, body, dim)
                if _most(q) * _most(x) * max(1, len(q)) >= 2**62:
                    raise ValueError("components too large for 64-bit scores")
                rest = _remaining(x)
                for i, name in enumerate(names.tolist()):
                    found[name] = best(np.ascontiguousarray(q[:, i]), name, own, x, rest, k, found.get(name, []))
        out = [(name, v, s) for name, top in found.items() for s, v in top]
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = candidates.join(packed_queries, ["qb", "dim", "salt"]).select("dim", "q_ids", "q_body", "ids", "body")
    some = pairs.mapInPandas(score, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return some.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


