"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A paragraph is a line. It hashes to a wide vector: 32 lanes from the whole line, and 128 lanes summed
from its sentences. A text's fingerprint is the sum of its paragraphs' vectors, each lane of whole lines
modulo 2**16, each lane of sentences modulo 2**32. So it does not depend on their order, and a paragraph is added or taken away without the rest.
Sentence lanes are centred on zero, so that the inner product of two fingerprints estimates how much
the texts share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WHOLE, PARTS = 32, 128
LANES = WHOLE + PARTS


def _sentences(line: str) -> list[str]:
    """A line's sentences; long ones count as pieces of eight words each."""
    found = []
    for s in line.split(". "):
        if len(s) <= 80:
            found.append(s)
        else:
            words = s.split(" ")
            found += [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    return [s for s in found if s]


def _lanes(digests: list[bytes], counts: list[int], wide: bool) -> np.ndarray:
    """Sums of digests' lanes, `counts` of them for each text."""
    out = np.zeros((len(counts), PARTS if wide else WHOLE), np.int32)
    if not digests:
        return out
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1)
    if wide:  # two lanes a byte, odd values from -15 to 15
        values = np.concatenate([raw & 15, raw >> 4], axis=1).astype(np.int8) * np.int8(2) - np.int8(15)
    else:
        values = raw.view(np.int8)
    n = np.array(counts)
    some = n > 0
    out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
    return out


def _cut(v: np.ndarray) -> np.ndarray:
    """Lanes modulo 2**32, those of whole lines modulo 2**16."""
    v = v.astype(np.uint32)
    v[..., :WHOLE] &= 0xFFFF
    return v


def vectors(texts: list[str]) -> np.ndarray:
    """A row of LANES unsigned lanes for each text: WHOLE below 2**16, and PARTS below 2**32."""
    whole, parts, n_whole, n_parts = [], [], [], []
    blake = hashlib.blake2b
    for t in texts:
        lines = [x for x in t.split("\n") if x]
        own = [s for x in lines for s in _sentences(x)]
        whole += [blake(x.encode("utf-8", "surrogatepass"), digest_size=WHOLE).digest() for x in lines]
        parts += [blake(s.encode("utf-8", "surrogatepass"), digest_size=PARTS // 2).digest() for s in own]
        n_whole.append(len(lines))
        n_parts.append(len(own))
    return _cut(np.concatenate([_lanes(whole, n_whole, False), _lanes(parts, n_parts, True)], axis=1))


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of both texts' paragraphs together."""
    return _cut(a + b)


def removed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _cut(a - b)


def shown(v: np.ndarray) -> str:
    return base64.b64encode(v[:WHOLE].astype("<u2").tobytes() + v[WHOLE:].astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1 for rows of fingerprints: twice the estimated common mass over both masses; 1 for equal rows."""
    x, y = (v[:, WHOLE:].view(np.int32).astype(float) for v in (np.ascontiguousarray(a), np.ascontiguousarray(b)))
    mass = (x * x).sum(1) + (y * y).sum(1)
    near = np.clip(2 * (x * y).sum(1) / np.where(mass > 0, mass, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, near)


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _runs(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[tuple[list, list[str]]]:
    """Cuts rows in order (bucket, kind, doc_id, text) into runs of one bucket: ids, and one text more than ids."""
    ids, texts, bucket, size = [], [], None, 0
    for pdf in batches:
        for b, i, t in zip(pdf["bucket"], pdf["doc_id"], pdf["text"], strict=True):
            if bucket is not None and b != bucket:  # the last row of a bucket is only the next text
                yield ids[:-1], texts
                ids, texts, size = [], [], 0
            elif size > chars:
                yield ids[:-1], texts
                ids, texts, size = ids[-1:], texts[-1:], 0
            bucket = b
            ids.append(i)
            texts.append(t if isinstance(t, str) else "")
            size += len(texts[-1])
    if ids:
        yield ids[:-1], texts


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, kind, doc_id, text) sorted so that within a bucket each row's successor in the order of
    doc_id descending (nulls last, then text descending) follows it; the last row of a bucket has kind 1
    and repeats the first of the next. One shuffle moves the texts; ids alone choose the buckets."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or common.partitions(spark)
    placed, homes = common.ranged(rows, n, to="range")
    # the largest ids come first, and rows without an id last
    last = F.when(F.col("doc_id").isNull(), F.lit(homes)).otherwise(F.lit(homes) - 1 - F.col("range"))
    placed = placed.select(last.cast("int").alias("bucket"), "doc_id", "text")
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    order = [r["bucket"] for r in heads]
    follows = [(a, b) for a, b in zip([order[-1], *order[:-1]], order, strict=True)] if order else []
    first = spark.createDataFrame([(r["bucket"], r["doc_id"], a) for r, (a, _) in zip(heads, follows, strict=True)], "bucket int, doc_id long, before int")
    # one row a bucket, so at most as many as there are buckets
    ends = (
        placed.alias("p").join(F.broadcast(first).alias("h"), (F.col("p.bucket") == F.col("h.bucket")) & F.col("p.doc_id").eqNullSafe(F.col("h.doc_id")))
        .groupBy(F.col("h.before").alias("bucket"), F.col("p.doc_id").alias("doc_id")).agg(F.max("p.text").alias("text"))
        .select("bucket", F.lit(1).alias("kind"), "doc_id", "text")
    )
    both = placed.select("bucket", F.lit(0).alias("kind"), "doc_id", "text").unionByName(ends)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def compare_next(docs: DataFrame, chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.
    Null texts count as empty; an empty text has the zero fingerprint; rows with one doc_id are ordered by
    text; a single row is its own successor; further columns of docs are left out."""
    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _runs(batches, chars):
            if not ids:
                continue
            changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            own, new = vectors(texts), vectors(changed)
            yield pd.DataFrame({
                "doc_id": ids,
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                "fingerprint": [shown(v) for v in own[:-1]],
                "edited_fingerprint": [shown(v) for v in new],
                "near_edited": likeness(own[:-1], new),
                "near_next": likeness(own[:-1], own[1:]),
            })

    common.small_batches(docs.sparkSession)
    # beside a null, pandas would hold ids as doubles
    found = with_next(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(rows, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
