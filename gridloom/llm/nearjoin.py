"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Shingles are counted over the whole corpus (truncated hashes, packed and dealt out by range); the
   frequent ones, at most HOT_LIMIT, come last in the order of all shingles, the rest go by hash.
2. A set's prefix is so long that two sets over the threshold share an element of their prefixes.
   Documents of one prefix and size are one group, and a prefix element lists groups, not documents,
   with the element's place in the prefix. Documents of equal sets are one class.
3. Within a list, two groups make a pair if their sizes and the two places leave room for the overlap that
   the threshold asks for; a group without any possible partner leaves the list. Pairs of the lists that
   are short then are expanded to classes and verified.
4. Long lists that overlap make a cluster. Its classes are dealt out to parts of bounded size, and an
   index of a part's elements finds all links inside. Then the classes that are still outside the
   cluster's largest component, and only they, ask for links with all others. So every pair that could
   join two components is compared, and a cluster of n copies costs about n, not n squared. They ask
   pair by pair within their lists, or block by block over the whole cluster, whichever is less; both
   ways find all links, and neither holds more than two blocks of about PART classes at a time.
5. Links make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components

SHINGLE, PERCENT = 5, 80
#: Frequent shingles that travel with the tasks: 8 MB at most.
HOT_LIMIT = 1_000_000
#: Up to so many classes a list is compared pair by pair; a cluster of longer lists in parts of about PART.
SHORT_LIST, PART = 8, 400
#: What a pair costs, in rows of a block.
PAIR_COST = 2
_SHORT = np.uint64(0xA24BAED4963EE407)
#: About so many bytes of text are behind a bucket of shingles.
BUCKET_BYTES = 4_000_000


def shingles(texts: list[str | None], hashes: common.WordHashes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted by text and hash, and their owners."""
    words = [hashes.of(t.encode("utf-8", "surrogatepass").lower().split()) if isinstance(t, str) else np.empty(0, np.uint64) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    h = common.window_hashes(flat, width)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(words)), n)[: len(h)]
    inside = np.arange(len(h)) + width <= ends[owner] if len(h) else np.zeros(0, bool)
    h, owner = h[inside], owner[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    with np.errstate(over="ignore"):
        whole = []
        for i in short:
            x = _SHORT * np.uint64(n[i])
            for w in words[i]:
                x = x * np.uint64(common.BASE) + w
            whole.append(x)
    h, owner = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    h = common.mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def _blocks(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield from common.slices(batch, "text", chars)


def frequent(docs: DataFrame, bits: int, buckets: int, chars: int, limit: int = HOT_LIMIT) -> np.ndarray:
    """Truncated hashes, sorted, of the shingles that most documents hold: all of a document frequency of at
    least t, the least t from 3 on by which they are `limit` at most. They only order the shingles, so
    neither truncation nor the limit changes a result."""
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = common.WordHashes()
        for pdf in _blocks(batches, chars):
            h, n = np.unique(shingles(list(pdf["text"]), hashes)[0], return_counts=True)
            rows = [{"bucket": b, "h": common.packed_sorted(h[p] >> shift), "n": common.packed(n[p].astype(np.uint64))} for b, p in common.by_bucket(h, buckets)]
            yield pd.DataFrame(rows, columns=["bucket", "h", "n"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([common.unpacked_sorted(x) for x in pdf["h"]])
        n = np.concatenate([common.unpacked(x) for x in pdf["n"]]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[first], np.add.reduceat(n, first)
        some = n >= 3
        return pd.DataFrame({"h": [common.packed_sorted(h[some])], "n": [common.packed(n[some].astype(np.uint64))]})

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            df, n = np.unique(np.concatenate([common.unpacked(x) for x in pdf["n"]]), return_counts=True)
            yield pd.DataFrame({"df": df.astype(np.int64), "n": n})

    counted = docs.select("text").mapInPandas(count, "bucket int, h binary, n binary").groupBy("bucket").applyInPandas(total, "h binary, n binary")
    counted = common.written(counted, "shingle_counts")
    # most frequencies are low, so their distinct values are few; those beyond the limit can't be asked for
    most = counted.mapInPandas(levels, "df long, n long").groupBy("df").agg(F.sum("n").alias("n")).orderBy(F.col("df").desc()).limit(100_000).collect()
    least, room = None, limit
    for row in most:
        room -= row["n"]
        if room < 0:
            break
        least = row["df"]
    if least is None:
        return np.empty(0, np.uint64)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, n in zip(pdf["h"], pdf["n"], strict=True):
                yield pd.DataFrame({"h": [common.packed_sorted(common.unpacked_sorted(h)[common.unpacked(n) >= least])]})

    found = counted.mapInPandas(chosen, "h binary").collect()
    return np.sort(np.concatenate([common.unpacked_sorted(bytes(r["h"])) for r in found]))


_PASS = "kind int, none boolean, doc_id long, text_hash long, n long, class string, grp long, bucket int, h binary, owners binary, places binary, groups binary, sizes binary"


def _frame(size: int, **columns) -> pd.DataFrame:
    """A frame of all columns of _PASS, those not given null."""
    names = [c.split()[0] for c in _PASS.split(", ")]
    return pd.DataFrame({c: pd.Series(list(columns[c]) if c in columns else [None] * size, dtype=object) for c in names})


def _signed(*parts: np.ndarray) -> list[str]:
    return [b"".join(p).hex() for p in zip(*[[x.tobytes() for x in a.astype(">u8")] for a in parts], strict=True)]


def _sums(h: np.ndarray, n: np.ndarray) -> list[str]:
    """The name of each set of n hashes (concatenated in h): two sums of its elements' hashes, and its size."""
    one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        starts = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            one[some] = np.add.reduceat(common.mixed(h, 0x51), starts)
            two[some] = np.add.reduceat(common.mixed(h, 0x7F4A), starts)
    return _signed(one, two, n)


def _described(pdf: pd.DataFrame, hashes: common.WordHashes, hot: np.ndarray, shift: np.uint64, buckets: int) -> Iterator[pd.DataFrame]:
    """For a block: a row per document with its class and group (kind 0), and the groups that each prefix
    element lists, packed by bucket (kind 1)."""
    h, owner = shingles(list(pdf["text"]), hashes)
    n = np.bincount(owner, minlength=len(pdf))
    some = np.flatnonzero(n)
    group = np.zeros(len(pdf), np.uint64)
    with np.errstate(over="ignore"):
        cut = h >> shift
        spot = np.minimum(np.searchsorted(hot, cut), max(0, len(hot) - 1))
        is_hot = hot[spot] == cut if len(hot) else np.zeros(len(h), bool)
        order = np.lexsort((h, is_hot, owner))
        need = n - -(-PERCENT * n // 100) + 1
        rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        in_prefix = rank < np.repeat(need, n)
        ph, po, place = h[order][in_prefix], owner[order][in_prefix], rank[in_prefix]
        if len(ph):
            first = np.flatnonzero(np.concatenate([[True], po[1:] != po[:-1]]))
            group[some] = common.mixed(np.add.reduceat(common.mixed(ph, 0x2D), first) + n[some].astype(np.uint64) * _SHORT)
    names = _sums(h, n)
    kinds, classes = [0] * len(pdf), [c if k else None for c, k in zip(names, n, strict=True)]
    yield _frame(len(pdf), kind=kinds, none=pdf["none"], doc_id=pdf["doc_id"], text_hash=pdf["text_hash"], n=n.tolist(), grp=group.view(np.int64).tolist(), **{"class": classes})
    if not len(ph):
        return
    # one entry for each group of the block, whichever of its documents comes first
    leader_of = np.zeros(len(pdf), bool)
    leader_of[some[np.unique(np.stack([group[some], n[some].astype(np.uint64)]), axis=1, return_index=True)[1]]] = True
    keep = leader_of[po]
    ph, po, place = ph[keep], po[keep], place[keep]
    order = np.argsort(ph, kind="stable")
    ph, po, place = ph[order], po[order], place[order]
    rows = []
    for b, p in common.by_bucket(ph, buckets):
        own, which = np.unique(po[p], return_inverse=True)
        rows.append({
            "bucket": b, "h": common.packed_sorted(ph[p]), "owners": common.packed(which.astype(np.uint64)),
            "places": common.packed(place[p].astype(np.uint64)), "groups": group[own].tobytes(), "sizes": common.packed(n[own].astype(np.uint64)),
        })
    yield _frame(len(rows), kind=[1] * len(rows), **{k: [r[k] for r in rows] for k in rows[0]})


def _room(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements can reach the threshold if the first they share has places i and j."""
    overlap = -(-PERCENT * (n + m) // (100 + PERCENT))
    return np.minimum(n - i, m - j) >= overlap


def _partnered(key: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries of lists (key), sorted by size within each, could have a partner in their list. An entry's
    place must leave room for its own size if it is the smaller of a pair, and the larger's for 80 % of its."""
    early = n - place >= -(-2 * PERCENT * n // (100 + PERCENT))
    wide = np.int64(n.max()) * 2 + 2
    at = key * wide + n
    before = np.concatenate([[0], np.cumsum(early)])
    least = -(-PERCENT * n // 100)
    # as the larger: an early one of a size from `least` to its own; equal sizes come before or after it
    lo, hi = np.searchsorted(at, key * wide + least), np.searchsorted(at, at, side="right")
    as_larger = before[hi] - before[lo] - early > 0
    most = 100 * n // PERCENT
    ends = np.searchsorted(at, key * wide + most, side="right")
    starts = np.searchsorted(at, at)
    as_smaller = early & (ends - starts > 1)
    return as_larger | as_smaller


def _lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """From a bucket's postings: the pairs (a, b) of groups that short lists leave, with list null, and the
    different long lists, a row (list, a) for each group."""
    groups = [np.frombuffer(x, np.int64) for x in pdf["groups"]]
    offset = np.cumsum([0, *map(len, groups)])
    groups, sizes = np.concatenate(groups), np.concatenate([common.unpacked(x).astype(np.int64) for x in pdf["sizes"]])
    owner = np.concatenate([o + common.unpacked(x).astype(np.int64) for o, x in zip(offset, pdf["owners"], strict=False)])
    place = np.concatenate([common.unpacked(x).astype(np.int64) for x in pdf["places"]])
    h = np.concatenate([common.unpacked_sorted(x) for x in pdf["h"]])
    grp, n = groups[owner], sizes[owner]

    def cut(keep: np.ndarray) -> None:
        """Only the entries of `keep`, and of these the lists of two or more."""
        nonlocal h, grp, n, place
        h, grp, n, place = h[keep], grp[keep], n[keep], place[keep]
        same = h[1:] == h[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(h) else np.zeros(0, bool)
        h, grp, n, place = h[several], grp[several], n[several], place[several]

    order = np.lexsort((grp, n, h))
    h, grp, n, place = h[order], grp[order], n[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (grp[1:] != grp[:-1])
    cut(new)
    if len(h):
        cut(_partnered(np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])), n, place))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    length = np.diff(first, append=len(h))
    pairs = [np.empty((0, 2), np.int64)]
    for k in range(2, SHORT_LIST + 1):
        own = first[length == k]
        for x in range(k):
            for y in range(x + 1, k):
                i, j = own + x, own + y
                good = (100 * n[i] >= PERCENT * n[j]) & _room(n[i], place[i], n[j], place[j])
                pairs.append(np.sort(np.stack([grp[i[good]], grp[j[good]]], axis=1), axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    parts = [pd.DataFrame({"list": None, "a": pairs[:, 0], "b": pairs[:, 1]})]
    first, length = first[length > SHORT_LIST], length[length > SHORT_LIST]
    if len(first):
        # equal lists have equal sums of their members' hashes
        starts = np.cumsum(length) - length
        at = np.repeat(first - starts, length) + np.arange(length.sum())
        with np.errstate(over="ignore"):
            member = common.mixed(grp[at].view(np.uint64))
            one, two = np.add.reduceat(member, starts), np.add.reduceat(common.mixed(member, 0x33), starts)
        keep = np.unique(np.stack([one, two]), axis=1, return_index=True)[1]
        names = _signed(one[keep], two[keep])
        for name, i in zip(names, keep.tolist(), strict=True):
            parts.append(pd.DataFrame({"list": name, "a": grp[first[i] : first[i] + length[i]], "b": None}))
    return pd.concat([p for p in parts if len(p)] or parts[:1]).astype({"a": "Int64", "b": "Int64"})


def _alike(a: str, b: str) -> Column:
    """Whether sizes allow the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _sets(names: DataFrame, classes: DataFrame, docs: DataFrame, chars: int) -> DataFrame:
    """(class, paired, clustered, set) of the named classes (class, paired, clustered), made from the text of one
    document of each. What they are wanted for goes along, so that no join moves sets that it doesn't need."""
    use = names.groupBy("class").agg(F.max("paired").alias("paired"), F.max("clustered").alias("clustered"))
    wanted = common.written(classes.join(use, "class").select("none", "doc_id", "text_hash", "paired", "clustered"), "candidates")
    if wanted.count() <= 1_000_000:  # five short columns, so some 60 MB at most; beyond it both sides are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, ["none", "doc_id", "text_hash"]).select("text", "paired", "clustered")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = common.WordHashes()
        for pdf in _blocks(batches, chars):
            h, owner = shingles(list(pdf["text"]), hashes)
            n = np.bincount(owner, minlength=len(pdf))
            parts = np.split(h, np.cumsum(n)[:-1])
            yield pd.DataFrame({"class": _sums(h, n), "paired": pdf["paired"].to_numpy(), "clustered": pdf["clustered"].to_numpy(), "set": [common.packed_sorted(x) for x in parts]})

    own = common.written(texts.mapInPandas(sets, "class string, paired boolean, clustered boolean, set binary"), "sets")
    seen = own.agg(F.count("class").alias("rows"), F.countDistinct("class").alias("classes")).first()
    # rows that repeat a document give its class more than once
    return common.written(own.dropDuplicates(["class"]), "sets") if seen["rows"] > seen["classes"] else own


def _of(names: DataFrame, sets: DataFrame, most: int = 200_000) -> DataFrame:
    """The sets of the named classes, where they are few enough to be sent everywhere (some 20 MB); else all sets."""
    names = common.written(names.select("class").distinct(), "needed")
    return sets.join(F.broadcast(names), "class", "left_semi") if names.count() <= most else sets


def _enough(shared, n, m):
    return 100 * shared >= PERCENT * (n + m - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Few pairs (of 96 signs, so some 30 MB at most) are sent to the
    sets, which then move once, by b; else both joins read the same exchange of all sets."""
    others = sets
    if pairs.count() <= 200_000:
        others = _of(pairs.select(F.col("b").alias("class")), sets)
        pairs = F.broadcast(pairs)
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("x")).join(pairs, "a")
    both = left.join(others.select(F.col("class").alias("b"), F.col("set").alias("y")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                u, v = common.unpacked_sorted(x), common.unpacked_sorted(y)
                good.append(_enough(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v)))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    return common.written(both.mapInPandas(check, "a string, b string"), "verified")


def _linked(names: list[str], packed: list[bytes], roots: list[str], asks: np.ndarray, own: np.ndarray) -> list[tuple[str, str]]:
    """Links between the sets that `asks` marks and those that `own` marks, by counting what each shares with them
    in an index of their elements. Sets of one root are linked already; of links that close a ring none is returned."""
    parts = [common.unpacked_sorted(x) for x in packed]
    n = np.array([len(x) for x in parts])
    flat, place = np.unique(np.concatenate(parts), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    indexed = own[owner]
    by_element = owner[indexed][np.argsort(place[indexed], kind="stable")]
    count = np.bincount(place[indexed], minlength=len(flat))
    start = np.cumsum(count) - count
    ends = np.cumsum(n)
    above: dict[str, str] = {}

    def top(r: str) -> str:
        while r in above:
            r = above[r]
        return r

    found = []
    for i in np.flatnonzero(asks).tolist():
        mine = place[ends[i] - n[i] : ends[i]]
        k = count[mine]
        at = np.repeat(start[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        shared = np.bincount(by_element[at], minlength=len(n))
        for j in np.flatnonzero(_enough(shared, n[i], n)).tolist():
            x, y = top(roots[i]), top(roots[j])
            if x != y:
                above[max(x, y)] = min(x, y)
                found.append((names[i], names[j]))
    return found


def _frame_of(links: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame(links, columns=["a", "b"], dtype=object)


def _local(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links inside a part of a cluster, but for those that close a ring."""
    names, every = pdf["class"].tolist(), np.ones(len(pdf), bool)
    return _frame_of(_linked(names, pdf["set"].tolist(), names, every, every))


def _outer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block that asks with another, or among its own classes if it is asked itself."""
    asks = (pdf["block"] == pdf["ask"]).to_numpy(bool)
    own = (pdf["block"] == pdf["part"]).to_numpy(bool)
    return _frame_of(_linked(pdf["class"].tolist(), pdf["set"].tolist(), pdf["root"].tolist(), asks, own))


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes and the root of their component."""
    roots = components.components(links)
    return common.written(classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")


def _joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """rooted with the components that further links join made one."""
    a = links.join(rooted.select(F.col("class").alias("a"), F.col("root").alias("x")), "a")
    between = a.join(rooted.select(F.col("class").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components.components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return common.written(rooted.join(roots, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "joined")


def _clusters(members: DataFrame) -> DataFrame:
    """(class, cluster, parts, part) of the classes in long lists: lists that share a class make a cluster, and
    a cluster is dealt out by hash to parts of about PART classes."""
    # a list is a node of its own; its name has 32 signs, that of a class 48
    roots = components.components(members.select(F.col("list").alias("a"), F.col("class").alias("b")))
    roots = common.written(roots.join(members.select(F.col("class").alias("node")).distinct(), "node", "left_semi"), "cluster_roots")
    size = roots.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = roots.join(size, "root").select(F.col("node").alias("class"), F.col("root").alias("cluster"), "parts")
    return common.written(dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")), "clusters")


def _asked(clusters: DataFrame, rooted: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) of the classes outside the largest component of their cluster with all others of it that
    they could be linked to; None if there are no such classes."""
    wide = clusters.where("parts > 1").select("class", "cluster").join(rooted.select("class", "n", "root"), "class")
    wide = common.written(wide, "wide")
    main = wide.groupBy("cluster", "root").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "root"))["root"].alias("main"))
    told = wide.join(main, "cluster").withColumn("asks", F.col("root") != F.col("main"))
    asking = F.count(F.when(F.col("asks"), 1))
    size = told.groupBy("cluster").agg(asking.alias("k"), F.count("*").alias("size")).where("k > 0")
    blocks = [F.ceil(F.col("k") / PART).cast("int").alias("ask_blocks"), F.ceil((F.col("size") - F.col("k")) / PART).cast("int").alias("main_blocks")]
    told = common.written(told.join(size.select("cluster", "k", "size", *blocks), "cluster"), "told")
    if told.isEmpty():
        return None

    # what either way would take
    listed = members.select("list", "class").join(told.select("class", "cluster", "n", "root", "asks"), "class")
    length = listed.groupBy("cluster", "list").agg(asking.alias("k"), F.count("*").alias("size")).where("k > 0")
    length = common.written(length, "asked_lists")
    pairs = length.groupBy("cluster").agg(F.sum(F.col("k") * (F.col("size") - F.col("k") / 2)).alias("pairs"))
    rows = F.col("k") * (F.col("ask_blocks") + F.col("main_blocks")) + (F.col("size") - F.col("k")) * F.col("ask_blocks")
    way = told.select("cluster", rows.alias("rows")).distinct().join(pairs, "cluster")
    way = common.written(way.select("cluster", (PAIR_COST * F.col("pairs") <= F.col("rows")).alias("paired")), "ways")

    # pair by pair: a list's classes and those of them that ask are dealt out to blocks, and each two blocks meet
    salts = [F.ceil(F.col("k") / PART).cast("int").alias("ask_salts"), F.ceil(F.col("size") / PART).cast("int").alias("salts")]
    salted = listed.join(length.join(way.where("paired"), "cluster").select("list", *salts), "list")
    salted = common.written(salted, "salted")

    def of(salts: str) -> Column:
        return F.pmod(F.xxhash64("class", F.lit(2)), F.col(salts)).cast("int")

    def every(salts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(salts) - 1))

    def named(x: str) -> list[Column]:
        return [F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("root").alias(f"root_{x}"), F.col("asks").alias(f"asks_{x}")]

    a = salted.where("asks").select("list", *named("a"), of("ask_salts").alias("ask_salt"), every("salts").alias("salt"))
    b = salted.select("list", *named("b"), of("salts").alias("salt"), every("ask_salts").alias("ask_salt"))
    met = a.join(b, ["list", "ask_salt", "salt"]).where((F.col("root_a") != F.col("root_b")) & _alike("n_a", "n_b") & (~F.col("asks_b") | (F.col("a") < F.col("b"))))
    paired = common.written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "asked_pairs")

    # block by block: those that ask make the first blocks; each of these meets itself, and each other block once
    block = F.when(F.col("asks"), F.pmod(F.xxhash64("class", F.lit(2)), F.col("ask_blocks"))).otherwise(F.col("ask_blocks") + F.pmod(F.xxhash64("class", F.lit(2)), F.col("main_blocks")))
    dealt = told.join(way.where("not paired").select("cluster"), "cluster").withColumn("block", block.cast("int"))
    others = F.when(F.col("asks"), F.col("ask_blocks") + F.col("main_blocks")).otherwise(F.col("ask_blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("ask"), F.greatest("block", "other").alias("part"), "block", "class", "root")
    outer = dealt.join(_of(dealt, sets).select("class", "set"), "class").groupBy("cluster", "ask", "part").applyInPandas(_outer, "a string, b string")
    return _verified(paired, sets).unionByName(outer)


def _key(names: tuple[str, str, str] = ("none", "doc_id", "text_hash")) -> list[Column]:
    """What tells rows apart: whether doc_id is null, doc_id or 0, and a hash of the text."""
    return [F.col("doc_id").isNull().alias(names[0]), F.coalesce("doc_id", F.lit(0)).cast("long").alias(names[1]), F.xxhash64("text").alias(names[2])]


def _resolved(docs: DataFrame, chars: int) -> tuple[DataFrame, DataFrame]:
    """A node for every row (none, doc_id, text_hash, n, class, grp), and for every class its component's
    smallest doc_id and first node (class, component_id, first)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(*_key(), "text")
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    buckets = max(2 * common.partitions(spark), -(-size["bytes"] // BUCKET_BYTES))
    bits = int(min(64, max(40, np.ceil(np.log2(max(1, size["rows"]))) + 22)))
    shift = np.uint64(64 - bits)
    hot = spark.sparkContext.broadcast(frequent(rows, bits, buckets, chars))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = common.WordHashes()
        for pdf in _blocks(batches, chars):
            yield from _described(pdf, hashes, hot.value, shift, buckets)

    passed = common.written(rows.mapInPandas(describe, _PASS), "described")
    hot.unpersist()
    nodes = passed.where("kind = 0").select("none", "doc_id", "text_hash", "n", "class", "grp")
    postings = passed.where("kind = 1").select("bucket", "h", "owners", "places", "groups", "sizes")
    lists = common.written(postings.groupBy("bucket").applyInPandas(_lists, "list string, a long, b long").distinct(), "lists")
    classes = nodes.where("n > 0").groupBy("class").agg(F.min(F.struct("none", "doc_id", "text_hash")).alias("first"), F.min("grp").alias("grp"), F.min("n").alias("n"))
    classes = common.written(classes.select("class", "first.*", "grp", "n"), "classes")

    # pairs of groups, those of a group of several classes with itself, and groups too large for pairs
    several = common.written(classes.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1"), "several")
    pairs = lists.where("list is null").select("a", "b").unionByName(several.where(F.col("k") <= SHORT_LIST).select(F.col("grp").alias("a"), F.col("grp").alias("b")))
    listed = lists.where("list is not null").select("list", F.col("a").alias("grp"))
    large = several.where(F.col("k") > SHORT_LIST).select("grp")
    if not large.isEmpty():
        met = pairs.join(large.select(F.col("grp").alias("a"), F.lit(True).alias("la")), "a", "left").join(large.select(F.col("grp").alias("b"), F.lit(True).alias("lb")), "b", "left")
        met = common.written(met, "met")
        name = F.md5(F.concat_ws(":", "a", "b"))
        both = met.where("la or lb").select(name.alias("list"), F.explode(F.array("a", "b")).alias("grp"))
        listed = listed.unionByName(both).unionByName(large.select(F.md5(F.col("grp").cast("string")).alias("list"), "grp"))
        pairs = met.where("la is null and lb is null").select("a", "b")
    members = common.written(listed.join(classes.select("grp", "class", "n"), "grp").select("list", "class", "n"), "members")

    # the classes of two groups that could be alike, pair by pair
    sides = [classes.select(F.col("grp").alias(x), F.col("class").alias(f"class_{x}"), F.col("n").alias(f"n_{x}")) for x in ("a", "b")]
    met = pairs.join(sides[0], "a").join(sides[1], "b").where(_alike("n_a", "n_b") & (F.col("class_a") != F.col("class_b")) & ((F.col("a") != F.col("b")) | (F.col("class_a") < F.col("class_b"))))
    pairs = common.written(met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("class"), F.lit(True).alias("paired"), F.lit(False).alias("clustered"))
    dense = not members.isEmpty()
    if dense:
        # clusters, whose parts are searched each for itself; some classes of a part also sit in the next
        clusters = _clusters(members)
        named = named.unionByName(clusters.select("class", F.lit(False).alias("paired"), F.lit(True).alias("clustered")))
    sets = _sets(named, classes, rows, chars)
    links = _verified(pairs, sets.where("paired"))
    sets = sets.where("clustered").select("class", "set")
    if dense:
        placed = clusters.join(sets, "class")
        guests = placed.where((F.col("parts") > 1) & (F.pmod(F.xxhash64("class", F.lit(1)), F.lit(16)) == 0)).withColumn("part", (F.col("part") + 1) % F.col("parts"))
        inside = placed.unionByName(guests).select("cluster", "part", "class", "set").groupBy("cluster", "part").applyInPandas(_local, "a string, b string")
        links = links.unionByName(common.written(inside, "inside"))
    rooted = _rooted(classes, links)
    if dense:
        # a pair across components has a class outside the cluster's largest one; those ask elsewhere
        asked = _asked(clusters, rooted, members, sets)
        if asked is not None:
            rooted = _joined(rooted, common.written(asked, "asked"))

    node = F.struct("none", "doc_id", "text_hash")
    least = rooted.groupBy("root").agg(F.min(F.when(~F.col("none"), F.col("doc_id"))).alias("component_id"), F.min(node).alias("first"))
    return nodes, common.written(rooted.select("class", "root").join(least, "root").select("class", "component_id", "first"), "components")


def link(docs: DataFrame, chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs: its set's size, and the smallest doc_id
    that links reach from it.

    Null and empty texts have empty sets, which link with nothing, so their component is their own doc_id.
    Rows that repeat a doc_id are nodes of their own; a null doc_id is never the smallest, and a
    component without any id has a null one. An empty table gives an empty one."""
    nodes, named = _resolved(docs, chars)
    own = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    size = F.col("n").alias("n_shingles")
    alone = nodes.where("n = 0").select(own, size, own.alias("component_id"))
    # a class with very many documents makes a skewed join, which Spark splits
    others = nodes.where("n > 0").select("class", "none", "doc_id", "n").join(named, "class")
    return others.select(own, size, "component_id").unionByName(alone)


def keep_first(docs: DataFrame, chars: int = 1_000_000) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (of several texts with that id, the
    one of the least hash). Rows with an empty set all stay. Of rows equal in doc_id and text one stays."""
    nodes, named = _resolved(docs, chars)
    judged = nodes.where("n > 0").select("class", "none", "doc_id", "text_hash").join(named.select("class", "first"), "class")
    key = F.struct("none", "doc_id", "text_hash")
    gone = common.written(judged.where(key != F.col("first")).select("none", "doc_id", "text_hash").distinct(), "gone")
    twice = common.written(judged.where(key == F.col("first")).groupBy("none", "doc_id", "text_hash").count().where("count > 1").drop("count"), "twice")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = docs.select(own, *_key(("_none", "_id", "_hash"))).alias("d")

    def match(other: DataFrame):
        return other.alias("o"), (F.col("_none") == F.col("o.none")) & (F.col("_id") == F.col("o.doc_id")) & (F.col("_hash") == F.col("o.text_hash"))

    bounded = gone.count() <= 1_000_000  # some 60 MB at most; beyond it both sides are shuffled
    left = keyed.join(*match(F.broadcast(gone) if bounded else gone), "left_anti")
    if twice.isEmpty():
        return left.select("own.*")
    once = left.join(*match(twice), "left_anti").select("own.*")
    again = left.join(*match(twice), "left_semi").dropDuplicates(["_none", "_id", "_hash"]).select("own.*")
    return once.unionByName(again)
