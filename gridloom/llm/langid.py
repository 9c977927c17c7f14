"""Language identification with a bit-sliced Bloom filter.

Each slot of the filter holds one bit a language. An n-gram's slots are found by hashing; the AND of
their masks has the bits of all languages whose filter holds it. Per document the bits are counted
by language, counts are freed of the share that false positives add, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNDECIDED = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each letter of the texts (it with two neighbours on each side, anything but letters
    counting as one blank), and the number of letters up to the end of each text."""
    parts = [np.frombuffer(f"  {t}  ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    code = _letters()[np.concatenate(parts)].astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    at = np.flatnonzero(code)
    before, after = code[at - 1], code[at + 1]
    # a neighbour beyond a blank belongs to another word
    far = np.where(before > 0, code[at - 2], 0)
    key = ((far << np.uint64(21) | before) << np.uint64(21) | code[at]) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    return key + after * np.uint64(0xA0761D6478BD642F), np.searchsorted(at, ends)


class LanguageFilter:
    """Masks by slot, one plane for 64 languages each; languages[64 * p + i] owns bit i of plane p."""

    def __init__(self, languages: list[str], members: list[np.ndarray], bits: int = 20, hashes: int = 2):
        self.languages, self.bits, self.hashes = languages, bits, hashes
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.iinfo(k).bits), np.uint64)
        self.planes = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), kind)
        for i, keys in enumerate(members):
            for slot in self._slots(keys):
                self.planes[i // 64, slot] |= kind(1 << i % 64)
        filled = np.array([np.count_nonzero(self.planes[i // 64] >> kind(i % 64) & kind(1)) for i in range(len(languages))], float)
        self.false_rate = (filled / (1 << bits)) ** hashes

    def _slots(self, keys: np.ndarray) -> list[np.ndarray]:
        return [((keys * np.uint64(m)) >> np.uint64(64 - self.bits)).astype(np.int64) for m in _MULTIPLIERS[: self.hashes]]

    def holders(self, keys: np.ndarray) -> np.ndarray:
        """A row for each plane: masks of the languages that hold each n-gram."""
        slots = self._slots(keys)
        found = self.planes[:, slots[0]]
        for s in slots[1:]:
            found &= self.planes[:, s]
        return found

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.empty(0)
        keys, ends = grams(texts)
        starts = np.concatenate([[0], ends[:-1]])
        n = (ends - starts).astype(float)
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        masks = self.holders(keys)
        hits = np.empty((len(self.languages), len(texts)))
        kind = self.planes.dtype.type
        for i in range(len(self.languages)):
            run = np.concatenate([[0], np.cumsum(masks[i // 64] >> kind(i % 64) & kind(1), dtype=np.int64)])
            hits[i] = run[ends] - run[starts]
        f = self.false_rate[:, None]
        hits = np.clip((hits - n * f) / (1 - f), 0, None)
        best = hits.argmax(0)
        score = np.clip(hits[best, np.arange(len(texts))] / np.maximum(n, 1), 0, 1)
        return [self.languages[b] if k else UNDECIDED for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = 6_000, max_grams: int = 60_000, least: int = 3, ratio: float = 0.25) -> LanguageFilter:
    """Learns the languages of labelled rows from about train_rows different texts of each (all, if fewer),
    chosen by a hash of the text. An n-gram joins a language's filter when seen `least` times and with
    at least `ratio` of its highest relative frequency in any language; of these the max_grams most
    frequent join. Rows without text or label teach nothing; without any, all texts are undecided; repeated
    rows teach once. The driver gets the languages' names and sizes, and max_grams numbers a language."""
    spark = labelled.sparkSession
    common.small_batches(spark)
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t"), 0.02).alias("n")).collect()}
    if not sizes:
        return LanguageFilter([], [])
    shares = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, int(1e6 * min(1, train_rows / max(1, n))))])
    part = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.element_at(shares, F.col("l"))).dropDuplicates(["l", "t"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby("l")["t"]:
                keys, n = np.unique(grams(list(own))[0], return_counts=True)
                yield pd.DataFrame({"l": name, "g": keys.view(np.int64), "n": n.astype(np.int64)})

    counts = part.mapInPandas(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = common.written(counts, "language_grams")
    totals = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter([], [])
    total = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(totals.items()) for x in (name, float(n))]), F.col("l"))
    shared = counts.withColumn("p", F.col("n") / total)
    most = shared.groupBy("g").agg(F.max("p").alias("most"))
    place = F.row_number().over(W.partitionBy("l").orderBy(F.col("n").desc(), "g"))
    seen = shared.join(most, "g").where(F.col("p") >= F.lit(ratio) * F.col("most")).withColumn("place", place).where(F.col("place") <= max_grams).select("l", "g").toPandas()
    names = sorted(seen["l"].unique())
    return LanguageFilter(names, [np.sort(seen.loc[seen["l"] == x, "g"].to_numpy(np.int64)).view(np.uint64) for x in names])


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", chars: int = 200_000) -> DataFrame:
    """All columns of docs and lang_pred, score (columns of docs with these names are replaced). Null and
    texts without a letter are `und` with score 0; between equal counts the first language in order wins."""
    common.small_batches(docs.sparkSession)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            names, scores, some, size = [], [], [], 0
            for t in [*texts, None]:
                if t is None or size + len(t) > chars and some:
                    a, b = model.decide(some)
                    names += a
                    scores.append(b)
                    some, size = [], 0
                if t is not None:
                    some.append(t)
                    size += len(t)
            yield pdf.assign(lang_pred=names, score=np.concatenate(scores) if scores else [])

    return common.map_exactly(kept, rows, "lang_pred string, score double")
