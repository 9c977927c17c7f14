"""Helpers that several corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/gridloom/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again; this cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get texts by 1,000 rows, not 10,000, unless the session has a size of its own. So a worker
    holds some megabytes of text at a time, and Spark's buffers for it are as small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def map_exactly(rows: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], added: str) -> DataFrame:
    """mapInPandas of a function that keeps all columns and adds others. Long columns travel as decimal strings:
    beside a null, pandas would hold them as doubles, which change numbers beyond 2**53."""
    longs = [n for n, t in rows.dtypes if t == "bigint"]
    sent = rows.select(*[F.col(f"`{n}`").cast("string").alias(n) if n in longs else F.col(f"`{n}`") for n in rows.columns])
    out = sent.mapInPandas(function, ", ".join([*(f"`{n}` {t}" for n, t in sent.dtypes), added]))
    return out.select(*[F.col(f"`{n}`").cast("long").alias(n) if n in longs else F.col(f"`{n}`") for n in out.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pd.DataFrame, column: str, max_chars: int) -> Iterator[pd.DataFrame]:
    """Cuts a batch into consecutive row ranges of about max_chars of text each (one row at least)."""
    n = batch[column].str.len().fillna(0).to_numpy(dtype="int64")
    ends = np.cumsum(n)
    group = (ends - n) // max(1, max_chars)
    for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(group)) + 1):
        if len(at):
            yield batch.iloc[at[0] : at[-1] + 1]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for at most `limit` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd bases, so that they have an inverse modulo 2**64.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def window_hashes(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all windows of `width` hashed words."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(down), out=prefix[1:], dtype=np.uint64)
        up = np.full(n - width + 1, base, np.uint64)
        up[0] = pow(base, width, 1 << 64)
        return (prefix[width:] - prefix[: n - width + 1]) * np.multiply.accumulate(up)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalises 64-bit hashes so that every bit depends on all bits."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64(salt)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs; the first byte tells how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return out.view("<u8").reshape(-1).astype(np.uint64)


def packed_sorted(values: np.ndarray) -> bytes:
    """Like packed, for values that never fall: the first, and the differences."""
    return values[:1].astype("<u8").tobytes() + packed(np.diff(values))


def unpacked_sorted(data: bytes) -> np.ndarray:
    if len(data) < 8:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8"), unpacked(data[8:])]), dtype=np.uint64)


def by_bucket(h: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, slice) of sorted hashes, dealt out by range."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    marks = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]])
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True) if b > a]


def ranged(rows: DataFrame, n: int, column: str = "doc_id", to: str = "home") -> tuple[DataFrame, int]:
    """rows with the place of their id among n ranges of about as many rows each (nulls in one of their own,
    the last), and the number of ranges. Only the ids are read for it."""
    cuts = rows.agg(F.percentile_approx(column, [(i + 1) / n for i in range(n - 1)] or [0.5], 10_000).alias("q")).first()["q"] or []
    edges = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    edges = edges if len(edges) > 2 else [-math.inf, 0.0, math.inf]
    cut = Bucketizer(splits=edges, inputCol="_as_double", outputCol="_range", handleInvalid="keep")
    placed = cut.transform(rows.withColumn("_as_double", F.col(column).cast("double")))
    home = F.when(F.col(column).isNull(), F.lit(len(edges) - 1)).otherwise(F.col("_range")).cast("int")
    return placed.withColumn(to, home).drop("_as_double", "_range"), len(edges)

