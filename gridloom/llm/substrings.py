"""Substring deduplication: word windows that occur earlier in the corpus are removed.

Every window of a fixed number of words gets a Rabin-Karp hash. Documents are dealt out by id, and within an id
by a hash of their text, into blocks of bounded size, ranges that follow each other. A block sorts its hashes and keeps the first window of each; its later ones
are repeats. The hashes that are left, a few bytes each and a frequent one once per block, are dealt out by
value; there each hash stays with its first block, and every other block is told, a bit a hash, that its
own is a repeat. The block makes its hashes again and merges all repeats into maximal intervals. To 64 bits
of hash come so many of a second one, by another base, that any two different windows of the corpus share all
of them with a chance below one in a million, whatever the corpus' size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 20
#: Most bytes of text in a block of several documents.
BLOCK_BYTES = 16_000_000


class Block:
    """The documents of a range of ids in order, and their windows sorted by hash and place."""

    def __init__(self, pdf: pd.DataFrame, width: int, extra: int = 0):
        self.width = width
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
        key = np.zeros(len(pdf), [("none", "?"), ("id", "<i8"), ("text", "<i8")])
        key["none"], key["id"], key["text"] = pdf["none"], pdf["doc_id"], pdf["text_hash"]
        # a row that repeats another's id and text is the same document
        self.docs, first, self.place = np.unique(key, return_index=True, return_inverse=True)
        self.words = [raw[i].split() for i in first]
        n = np.array([len(w) for w in self.words])
        flat = common.WordHashes().of([w for x in self.words for w in x])
        h = common.window_hashes(flat, width)
        # the second hash takes other hashes of the words by another base
        more = common.window_hashes(common.mixed(flat, 0x5D), width, common.OTHER_BASE) >> np.uint64(64 - 8 * extra) if extra else np.zeros(len(h), np.uint64)
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)[: len(h)]
        at = np.arange(len(h))
        inside = at + width <= ends[owner] if len(h) else np.zeros(0, bool)
        h, more, owner, start = h[inside], more[inside], owner[inside], (at - (ends - n)[owner])[inside] if len(h) else at
        order = np.lexsort((more, h)) if extra else np.argsort(h, kind="stable")
        self.h, self.more, self.owner, self.start = h[order], more[order], owner[order], start[order]
        self.is_first = np.ones(len(h), bool)
        self.is_first[1:] = (self.h[1:] != self.h[:-1]) | (self.more[1:] != self.more[:-1])

    def firsts(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """The block's different hashes by bucket, and what comes to each."""
        h, more = self.h[self.is_first], self.more[self.is_first]
        for bucket, part in common.by_bucket(h, buckets):
            yield bucket, common.packed_sorted(h[part]), common.packed(more[part])

    def repeats(self, buckets: int, told: dict[int, bytes]) -> Iterator[np.ndarray]:
        """The starts of each document's repeated windows; told has by bucket which hashes occur in an earlier block."""
        gone = ~self.is_first
        places = np.flatnonzero(self.is_first)
        for bucket, part in common.by_bucket(self.h[places], buckets):
            if bucket in told:
                own = places[part]
                gone[own] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=len(own)).astype(bool)
        owner, start = self.owner[gone], self.start[gone]
        order = np.argsort(owner, kind="stable")
        yield from np.split(start[order], np.cumsum(np.bincount(owner, minlength=len(self.docs)))[:-1])


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of a bucket, which of their hashes an earlier block has; blocks without any are left out."""
    pdf = pdf.sort_values("home")
    parts = [common.unpacked_sorted(x) for x in pdf["hashes"]]
    h, more = np.concatenate(parts), np.concatenate([common.unpacked(x) for x in pdf["more"]])
    order = np.lexsort((more, h))
    later = np.zeros(len(h), bool)
    later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    flags = np.split(later, np.cumsum([len(x) for x in parts])[:-1])
    out = [(int(home), int(b), np.packbits(f).tobytes()) for home, b, f in zip(pdf["home"], pdf["bucket"], flags, strict=True) if f.any()]
    return pd.DataFrame(out, columns=["home", "bucket", "flags"])


def merged(starts: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Maximal intervals (start, end) that the windows at `starts` cover, a row each."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(covered))
    return turn.reshape(-1, 2)


def _finish(block: Block, told: dict[int, bytes], buckets: int, texts: bool) -> pd.DataFrame:
    done = []
    for key, words, starts in zip(block.docs, block.words, block.repeats(buckets, told), strict=True):
        gone = merged(starts, block.width, len(words)) if len(starts) else np.empty((0, 2), np.int64)
        kept, at = [], 0
        for a, b in gone.tolist():
            kept += words[at:a]
            at = b
        kept += words[at:]
        joined = b" ".join(kept)
        row = [None if key["none"] else int(key["id"]), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), gone.reshape(-1).tolist()]
        done.append([*row, joined.decode("utf-8", "surrogatepass")] if texts else row)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", *(["kept"] if texts else [])]
    return pd.DataFrame([done[i] for i in block.place.reshape(-1)], columns=names).astype({"doc_id": "Int64"})


def _order(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
    """Keys as byte strings in the order of documents."""
    sign = np.uint64(1 << 63)
    out = np.empty((len(none), 17), np.uint8)
    out[:, 0] = none.to_numpy(bool)
    for at, column in ((1, ids), (9, hashes)):
        out[:, at : at + 8] = (column.to_numpy(np.int64).view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").reshape(-1)


def _last_keys(keys: DataFrame, n: int, most: int) -> DataFrame:
    """The last key of each block, for keys (none, doc_id, text_hash, size): ranges of `n` about equal numbers of
    rows, each cut where its size would go beyond `most`. Rows with equal keys stay together."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, 0
        for pdf in batches:
            found = []
            for *key, size in zip(*(pdf[c].tolist() for c in ("none", "doc_id", "text_hash", "size")), strict=True):
                if last is not None and key != last and total + size > most:
                    found.append(last)
                    total = 0
                last, total = key, total + size
            yield pd.DataFrame(found, columns=["none", "doc_id", "text_hash"])
        if last is not None:
            yield pd.DataFrame([last], columns=["none", "doc_id", "text_hash"])

    order = ["none", "doc_id", "text_hash"]
    return keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(cut, "none boolean, doc_id long, text_hash long")


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = False, blocks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (starts and ends of the intervals, flattened) for
    every row of docs; with texts=True also the kept text.

    A window is removed if its words also start earlier, in a smaller doc_id or further ahead in the same
    document. Null and empty texts have no words. Rows without doc_id come after all others; documents of
    one id are ordered by a hash of their text; rows equal in both are one document, each with its result.
    A block holds BLOCK_BYTES of text at most, or a single document; there are `blocks` or more."""
    spark = docs.sparkSession
    common.small_batches(spark)
    n = blocks or 2 * common.partitions(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", F.xxhash64(text).alias("text_hash"))
    ends = _last_keys(rows.select("none", "doc_id", "text_hash", F.octet_length(text).alias("size")), n, BLOCK_BYTES).toPandas()
    # a word and its space take two bytes; n windows make n**2 / 2 pairs
    most = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    extra = int(min(8, max(1, np.ceil((2 * np.log2(most / 2 + 2) - 1 + 20 - 64) / 8))))
    edges = np.sort(_order(ends["none"], ends["doc_id"], ends["text_hash"]))
    buckets = max(n, len(edges))

    @F.pandas_udf("int")
    def home(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _order(none, ids, hashes)).astype(np.int32))

    rows = rows.withColumn("home", home("none", "doc_id", "text_hash"))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(Block(pdf, width, extra).firsts(buckets))
        return pd.DataFrame({"bucket": [b for b, *_ in out], "home": int(pdf["home"].iloc[0]), "hashes": [x for _, x, _ in out], "more": [x for *_, x in out]})

    def finish(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _finish(Block(own, width, extra), dict(zip(told["bucket"].tolist(), told["flags"], strict=True)), buckets, texts)

    # both uses read one shuffle of the texts
    sent = rows.groupBy("home").applyInPandas(send, "bucket int, home int, hashes binary, more binary")
    told = sent.groupBy("bucket").applyInPandas(_resolve, "home int, bucket int, flags binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<long>" + (", kept string" if texts else "")
    return rows.groupBy("home").cogroup(told.groupBy("home")).applyInPandas(finish, schema)
