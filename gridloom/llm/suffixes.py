"""Suffix-array deduplication: bytes covered by a long string that starts earlier in the corpus are removed.

Texts are sorted by their suffixes in two stages. Suffixes smaller than their successors are sorted directly,
to a bounded depth; all others follow from them in one scan over the buckets of first symbols, since a
suffix that is larger than its successor comes in its bucket in the order of the successors. Adjacent common
prefixes then tell which strings of `width` bytes are equal.

So that equal strings meet in one task without sending every suffix, each window of `width` bytes names one of its
anchors: of its runs of ANCHOR bytes the one with the smallest hash. Windows that follow each other share
anchors, so a segment (some 135 bytes, one every 35) holds all windows of an anchor, and equal windows have equal
anchors at equal places. Segments that are equal as a whole are told by 128-bit names, once per block of
documents; segments alone with their anchor can't repeat; the rest, those that share an anchor but differ, are
sent as text and sorted. Runs that are frequent in the corpus are chosen last, so that a line that many documents
share doesn't gather its differing surroundings under one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .substrings import _last_keys, _order

WIDTH, ANCHOR = 100, 32
#: Most bytes of text in a block of several documents, and of segments that are sorted at once.
BLOCK_BYTES, SORTED_BYTES = 16_000_000, 3_000_000
#: Least and most bytes of text whose segments share a bucket.
BUCKET_BYTES = 4_000_000, 128_000_000
#: Anchors are counted in so many bins; those with so many times the mean are frequent.
BINS, FREQUENT = 1 << 20, 8
#: Tasks whose counts are added up as arrays, each in so many shares.
MERGED, _SHARES = 64, 16
_CHUNK = 1 << 17
_BITS, _PER_KEY = 9, 7


# --- suffix arrays --------------------------------------------------------------------------------------


def symbol_keys(t: np.ndarray, beyond: int) -> np.ndarray:
    """The seven symbols (below 512) from each place on as one number, zeros after the end; that many places longer."""
    one = np.zeros(len(t) + beyond + 8, np.uint64)
    one[: len(t)] = t
    two = one[:-1] << np.uint64(_BITS) | one[1:]
    four = two[:-2] << np.uint64(2 * _BITS) | two[2:]
    return (four[:-4] << np.uint64(3 * _BITS) | four[4:] >> np.uint64(_BITS))[: len(t) + beyond]


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; at the end, where no symbol differs any more, true."""
    n = len(t)
    up = np.ones(n, bool)
    step = np.diff(t.astype(np.int32))
    turn = np.where(step != 0, np.arange(n - 1), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # the next place at which the symbol changes
    known = turn < n
    up[: n - 1][known] = step[turn[known]] > 0
    return up


def _sorted_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` symbols or more: by seven, then ties by four more at a time."""
    k = keys[places]
    order = np.argsort(k)
    out, k = places[order], k[order]
    head = np.ones(len(out) + 1, bool)
    head[1:-1] = k[1:] != k[:-1]
    for done in range(_PER_KEY, depth, 4):
        tied = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(tied):
            break
        own = out[tied]
        group = np.cumsum(head[tied]).astype(np.uint64) << np.uint64(4 * _BITS)
        k = group | keys[own + done] >> np.uint64(3 * _BITS)
        order = np.argsort(k)
        out[tied], k = own[order], k[order]
        head[tied[1:]] |= k[1:] != k[:-1]
    return out


def suffix_order(t: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t in the order of their first `depth` symbols; t ends in 0, which separates texts."""
    n = len(t)
    up = smaller_than_next(t)
    total = np.bincount(t, minlength=1 << _BITS)
    larger = np.bincount(t[~up], minlength=1 << _BITS)
    start = np.cumsum(total) - total
    out = np.empty(n, np.int64)
    direct = np.concatenate([np.flatnonzero(t == 0), _sorted_directly(np.flatnonzero(up & (t > 0)), keys, depth)])
    # in a bucket the smaller suffixes come after the larger ones
    own = t[direct].astype(np.int64)
    small = total - larger
    out[(start + larger)[own] + np.arange(len(direct)) - (np.cumsum(small) - small)[own]] = direct
    free = start.copy()
    for c in np.flatnonzero(total).tolist():
        low, high = start[c], free[c]
        while low < high:  # runs of one symbol, a symbol longer each time
            before = out[low:high] - 1
            before = before[before >= 0]
            before = before[t[before] == c]
            low, high = high, high + len(before)
            out[low:high] = before
        before = out[start[c] : start[c] + total[c]] - 1
        before = before[before >= 0]
        first = t[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        n_of = np.bincount(first, minlength=1 << _BITS)
        out[free[first] + np.arange(len(first)) - (np.cumsum(n_of) - n_of)[first]] = before
        free += n_of
    return out


def common_prefixes(places: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each two adjacent suffixes, `most` at the most."""
    out = np.full(max(0, len(places) - 1), most, np.int64)
    left = np.arange(len(out))
    shifts = np.uint64(_BITS) * np.arange(_PER_KEY - 1, -1, -1, dtype=np.uint64)
    for at in range(0, most, _PER_KEY):
        apart = keys[places[left] + at] ^ keys[places[left + 1] + at]
        ends = apart != 0
        out[left[ends]] = np.minimum(most, at + (apart[ends, None] >> shifts == 0).sum(1))
        left = left[~ends]
        if not len(left):
            break
    return out


def repeated_windows(t: np.ndarray, is_start: np.ndarray, width: int) -> np.ndarray:
    """For t, texts with a 0 after each: whether the window at each marked place also starts further ahead in t."""
    keys = symbol_keys(t, width + 2 * _PER_KEY)
    order = suffix_order(t, keys, width)
    order = order[is_start[order]]
    out = np.zeros(len(t), bool)
    if len(order):
        new = np.concatenate([[True], common_prefixes(order, keys, width) < width])
        first = np.minimum.reduceat(order, np.flatnonzero(new))
        out[order] = order != first[np.cumsum(new) - 1]
    return out


# --- anchors --------------------------------------------------------------------------------------------


def _run_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ANCHOR bytes."""
    n = len(raw) - ANCHOR + 1
    words = np.empty(len(raw) - 7, np.uint64)
    for j in range(8):
        part = raw[j : j + (len(raw) - j) // 8 * 8].view("<u8")
        words[j::8] = part[: len(words[j::8])]
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(common.BASE)
        for j, salt in ((8, common.OTHER_BASE), (16, 0xFF51AFD7ED558CCD), (24, 0xC4CEB9FE1A85EC53)):
            h += words[j : j + n] * np.uint64(salt)
        h ^= h >> np.uint64(32)
        h *= np.uint64(common.BASE)
    return h


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int32)


def anchored(raw: np.ndarray, ends: np.ndarray, width: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that lie one after the other in `raw`, each up to its end: first window, number of windows
    and the hash of the anchor. Every window of `width` bytes that lies within a text belongs to one segment."""
    span = width - ANCHOR + 1  # runs in a window
    found = []
    for low in range(0, len(raw) - width + 1, _CHUNK):
        part = raw[low : low + _CHUNK + width - 1]
        h = _run_hashes(part)
        rank = h >> np.uint64(1)
        if frequent is not None:
            rank |= frequent[_bin(h)].astype(np.uint64) << np.uint64(63)
        mask = np.uint64((1 << 18) - 1)
        least = rank & ~mask | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        anchor = (least & mask).astype(np.int64)
        start = np.arange(len(anchor))
        owner = int(np.searchsorted(ends, low, side="right"))
        end_of = np.empty(len(start), np.int64)
        at = 0
        while at < len(start):  # texts that meet this chunk
            stop = min(len(start), int(ends[owner]) - low)
            end_of[at:stop] = ends[owner] - low
            at, owner = max(at, stop), owner + 1
        inside = start + width <= end_of
        start, anchor = start[inside], anchor[inside]
        if len(start):
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
            marks = np.flatnonzero(new)
            # the hash of an anchor is the least of many, so it is mixed before ranges of it are dealt out
            found.append((start[marks] + low, np.diff(np.append(marks, len(start))), common.mixed(h[anchor[marks]]), anchor[marks] + low))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    first, n, h, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    # a segment that goes on in the next chunk is one
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + n[:-1])
    marks = np.flatnonzero(new)
    return first[marks], np.add.reduceat(n, marks), h[marks]


def frequent_bins(docs: DataFrame) -> np.ndarray | None:
    """Which of BINS bins of run hashes hold FREQUENT times the mean or more: at most a share of 1 / FREQUENT of
    them, whatever the corpus. Tasks add up their counts as arrays, MERGED tasks at a time, before these become a
    row a bin. The bins only put anchors into an order; so those that are left out on the way, with less than half
    of that share or 16 runs in MERGED tasks, change no result, nor do runs that cross from one text to the next."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BINS, np.int64)
        for pdf in batches:
            for own in common.slices(pdf, "text", 8 * _CHUNK):
                raw = np.frombuffer(b"".join([t.encode("utf-8", "surrogatepass") for t in own["text"] if isinstance(t, str)]), np.uint8)
                for low in range(0, len(raw) - ANCHOR + 1, 8 * _CHUNK):
                    seen += np.bincount(_bin(_run_hashes(raw[low : low + 8 * _CHUNK + ANCHOR - 1])), minlength=BINS)
        keep = np.flatnonzero(seen > 1)
        shares = [keep[keep % _SHARES == i] for i in range(_SHARES)]
        task = TaskContext.get().partitionId() // MERGED
        out = [(task, i, int(seen.sum()), x.astype(np.int32).tobytes(), seen[x].tobytes()) for i, x in enumerate(shares)]
        yield pd.DataFrame(out, columns=["tasks", "share", "total", "bins", "n"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, total = np.zeros(BINS, np.int64), int(pdf["total"].sum())
        for bins, n in zip(pdf["bins"], pdf["n"], strict=True):
            seen[np.frombuffer(bins, np.int32)] += np.frombuffer(n, np.int64)
        keep = np.flatnonzero(seen >= max(16, total * FREQUENT / BINS / 2))
        mark = [-1] if pdf["share"].iloc[0] == 0 else []
        return pd.DataFrame({"bin": np.append(keep, mark).astype(np.int32), "n": np.append(seen[keep], [total] * len(mark)).astype(np.int64)})

    tasks = docs.select("text").mapInPandas(count, "tasks int, share int, total long, bins binary, n binary")
    counted = tasks.groupBy("tasks", "share").applyInPandas(merge, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    total = F.broadcast(counted.where("bin < 0").select(F.greatest(F.lit(16), F.col("n") * FREQUENT / BINS).alias("least")))
    found = counted.where("bin >= 0").join(total, F.col("n") >= F.col("least")).select("bin").toPandas()["bin"]
    if not len(found):
        return None
    out = np.zeros(BINS, np.uint8)
    out[found.to_numpy()] = 1
    return out


# --- blocks of documents --------------------------------------------------------------------------------

KEPT, SEEN, SHARED = 0, 1, 2


class Block:
    """The documents of a range of ids in order, as one run of bytes."""

    def __init__(self, pdf: pd.DataFrame, width: int, frequent: np.ndarray | None):
        self.width = width
        key = np.zeros(len(pdf), [("none", "?"), ("id", "<i8"), ("text", "<i8")])
        key["none"], key["id"], key["text"] = pdf["none"], pdf["doc_id"], pdf["text_hash"]
        # a row that repeats another's id and text is the same document
        self.docs, first, self.place = np.unique(key, return_index=True, return_inverse=True)
        texts = pdf["text"].to_numpy()
        parts = [t.encode("utf-8", "surrogatepass") if isinstance(t := texts[i], str) else b"" for i in first]
        self.bytes = b"".join(parts)
        self.raw = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum([len(p) for p in parts])
        self.first, self.n, self.anchor = anchored(self.raw, self.ends, width, frequent)
        data = memoryview(self.bytes)
        spans = zip(self.first.tolist(), (self.first + self.n + width - 1).tolist(), strict=True)
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in spans]), "<u8").reshape(-1, 2)
        self.order = np.lexsort((names[:, 1], names[:, 0], self.anchor))
        self.names = names[self.order]
        h = self.anchor[self.order]
        self.is_first = np.ones(len(h), bool)
        self.is_first[1:] = (h[1:] != h[:-1]) | (self.names[1:] != self.names[:-1]).any(1)

    def firsts(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, segments), each of the block's different segments once, at its first place, by anchor and name."""
        places = self.order[self.is_first]
        for bucket, part in common.by_bucket(self.anchor[places], buckets):
            yield bucket, places[part]

    def sent(self, buckets: int) -> pd.DataFrame:
        rows, names = [], self.names[self.is_first]
        at = 0
        for bucket, own in self.firsts(buckets):
            rows.append((bucket, common.packed_sorted(self.anchor[own]), names[at : at + len(own)].tobytes()))
            at += len(own)
        return pd.DataFrame(rows, columns=["bucket", "anchors", "names"])

    def shared(self, buckets: int, told: dict[int, np.ndarray]) -> pd.DataFrame:
        """Text of the segments that share their anchor with others, in the block's order."""
        rows = []
        for bucket, own in self.firsts(buckets):
            if bucket in told and len(own := np.sort(own[told[bucket] == SHARED])):
                a, n = self.first[own], self.n[own]
                text = b"".join([self.bytes[x : x + k] for x, k in zip(a.tolist(), (n + self.width - 1).tolist(), strict=True)])
                rows.append((bucket, self.anchor[own].tobytes(), n.astype(np.uint16).tobytes(), text))
        return pd.DataFrame(rows, columns=["bucket", "anchors", "n", "texts"])

    def covered(self, buckets: int, told: dict[int, np.ndarray], judged: dict[int, bytes]) -> np.ndarray:
        """Whether each byte lies in a window that starts earlier."""
        whole = np.zeros(len(self.first), bool)
        whole[self.order[~self.is_first]] = True
        edge = np.zeros(len(self.raw) + 1, np.int32)
        for bucket, own in self.firsts(buckets):
            if bucket not in told:
                continue
            whole[own[told[bucket] == SEEN]] = True
            if bucket in judged:
                own = np.sort(own[told[bucket] == SHARED])
                n = self.n[own]
                hit = np.unpackbits(np.frombuffer(judged[bucket], np.uint8), count=int(n.sum())).astype(bool)
                at = (np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(len(hit)))[hit]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + self.width, -1)
        np.add.at(edge, self.first[whole], 1)
        np.add.at(edge, self.first[whole] + self.n[whole] + self.width - 1, -1)
        return np.cumsum(edge)[:-1] > 0

    def result(self, gone: np.ndarray, texts: bool) -> pd.DataFrame:
        done = []
        low = 0
        for high in self.ends.tolist():
            own = gone[low:high]
            kept = self.raw[low:high][~own].tobytes()
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            row = (high - low, high - low - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist())
            done.append((*row, kept) if texts else row)
            low = high
        own = self.docs[self.place.reshape(-1)]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", *(["kept"] if texts else [])]
        out = pd.DataFrame([done[i] for i in self.place.reshape(-1)], columns=names)
        out.insert(0, "doc_id", pd.arrays.IntegerArray(own["id"].astype(np.int64), own["none"].copy()))
        return out


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of a bucket, what their segments are: SEEN in an earlier block; SHARED if others have the
    anchor; else KEPT. Blocks that keep all are left out."""
    pdf = pdf.sort_values("home")
    anchors = [common.unpacked_sorted(x) for x in pdf["anchors"]]
    h = np.concatenate(anchors)
    names = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in pdf["names"]])
    order = np.lexsort((names[:, 1], names[:, 0], h))  # stable: equal ones stay in the order of blocks
    h, names = h[order], names[order]
    new_anchor = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_anchor.copy()
    new[1:] |= (names[1:] != names[:-1]).any(1)
    several = np.add.reduceat(new, np.flatnonzero(new_anchor)) > 1
    state = np.empty(len(h), np.uint8)
    state[order] = np.where(~new, SEEN, np.where(several[np.cumsum(new_anchor) - 1], SHARED, KEPT))
    parts = np.split(state, np.cumsum([len(x) for x in anchors])[:-1])
    out = [(int(home), int(b), x.tobytes()) for home, b, x in zip(pdf["home"], pdf["bucket"], parts, strict=True) if x.any()]
    return pd.DataFrame(out, columns=["home", "bucket", "told"])


def _judge(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Sorts the shared segments of a bucket, some megabytes of whole anchors at a time, and tells each block which
    of its windows start earlier, a bit a window."""
    pdf = pdf.sort_values("home")
    anchors = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["anchors"]])
    counts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in pdf["n"]]
    n = np.concatenate(counts)
    raw = np.frombuffer(b"".join(pdf["texts"]), np.uint8)
    size = n + width - 1
    at, bit = np.cumsum(size) - size, np.cumsum(n) - n
    hits = np.zeros(int(n.sum()), bool)
    order = np.argsort(anchors, kind="stable")
    ends = np.cumsum(size[order])
    new = np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]])
    # an anchor belongs to the part in which its first segment begins
    part = ((ends - size[order]) // SORTED_BYTES)[np.flatnonzero(new)][np.cumsum(new) - 1]
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        own = np.sort(own)
        long = size[own] + 1
        t = np.zeros(int(long.sum()), np.uint16)
        low = np.cumsum(long) - long
        inside = np.ones(len(t), bool)
        inside[low + size[own]] = False
        source = (np.repeat(at[own] - low, long) + np.arange(len(t)))[inside]
        t[inside] = raw[source].astype(np.uint16) + 1
        windows = np.repeat(low - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
        is_start = np.zeros(len(t), bool)
        is_start[windows] = True
        target = np.repeat(bit[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(len(windows))
        hits[target] = repeated_windows(t, is_start, width)[windows]
    parts = np.split(hits, np.cumsum([int(c.sum()) for c in counts])[:-1])
    out = [(int(home), int(b), np.packbits(x).tobytes()) for home, b, x in zip(pdf["home"], pdf["bucket"], parts, strict=True) if x.any()]
    return pd.DataFrame(out, columns=["home", "bucket", "told"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = False, blocks: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (starts and ends of the removed runs,
    flattened) for every row of docs; with texts=True also the kept bytes.

    A byte is removed if a string of `width` bytes (40 to 60,000) that covers it also starts earlier, in a smaller
    doc_id or further ahead in the same document. Null and empty texts have no bytes. Rows without doc_id
    come after all others; documents of one id are ordered by a hash of their text; rows equal in both are one
    document, each with its result. Other columns are not looked at. An empty table gives an empty result. A block
    holds BLOCK_BYTES of text at most, or a single document; there are `blocks` or more."""
    if not ANCHOR + 8 <= width <= 60_000:
        raise ValueError(f"strings of {width} bytes")
    spark = docs.sparkSession
    common.small_batches(spark)
    n = blocks or 2 * common.partitions(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", F.xxhash64(text).alias("text_hash"))
    ends = _last_keys(rows.select("none", "doc_id", "text_hash", F.octet_length(text).alias("size")), n, BLOCK_BYTES).toPandas()
    edges = spark.sparkContext.broadcast(np.sort(_order(ends["none"], ends["doc_id"], ends["text_hash"])))
    frequent = spark.sparkContext.broadcast(frequent_bins(docs))
    # each block sends a row to each bucket, so there are no more buckets than their size or the tasks ask for
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES[1]), min(common.partitions(spark), -(-size // BUCKET_BYTES[0])), blocks or 0)

    @F.pandas_udf("int")
    def home(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, _order(none, ids, hashes)).astype(np.int32))

    rows = rows.withColumn("home", home("none", "doc_id", "text_hash"))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        return Block(pdf, width, frequent.value).sent(buckets).assign(home=int(pdf["home"].iloc[0]))

    def replies(told: pd.DataFrame) -> dict[int, np.ndarray]:
        own = told[~told["judged"].astype(bool)]
        return {b: np.frombuffer(x, np.uint8) for b, x in zip(own["bucket"].tolist(), own["told"], strict=True)}

    def share(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        states = replies(told)
        if not len(own) or not any((x == SHARED).any() for x in states.values()):
            return pd.DataFrame(columns=["bucket", "anchors", "n", "texts", "home"])
        return Block(own, width, frequent.value).shared(buckets, states).assign(home=int(own["home"].iloc[0]))

    def finish(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(own, width, frequent.value)
        judged = told[told["judged"].astype(bool)]
        gone = block.covered(buckets, replies(told), dict(zip(judged["bucket"].tolist(), judged["told"], strict=True)))
        return block.result(gone, texts)

    # all three uses read one shuffle of the texts
    sent = rows.groupBy("home").applyInPandas(send, "bucket int, anchors binary, names binary, home int")
    reply = "home int, bucket int, told binary"
    told = sent.groupBy("bucket").applyInPandas(_resolve, reply).withColumn("judged", F.lit(False))
    shared = rows.groupBy("home").cogroup(told.groupBy("home")).applyInPandas(share, "bucket int, anchors binary, n binary, texts binary, home int")
    judged = shared.groupBy("bucket").applyInPandas(lambda pdf: _judge(pdf, width), reply).withColumn("judged", F.lit(True))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>" + (", kept binary" if texts else "")
    return rows.groupBy("home").cogroup(told.unionByName(judged).groupBy("home")).applyInPandas(finish, schema)
