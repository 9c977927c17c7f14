"""SentencePiece encoding and decoding with a batched Viterbi search.

Words of equal length advance together. At each end position all substrings that end there are hashed
(differences of prefix hashes) and probed in the sorted keys of the pieces; a vectorised maximum over
the pieces found stores a back pointer.

For a unigram model a path's value is the sum of its piece scores. A BPE model's encoding isn't the path
of the highest sum, but it is the only path on which every two neighbours are what BPE makes of their
joined text. So there a path is worth 0 when its neighbours agree and minus infinity otherwise, and the
same search finds it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNITS = re.compile(r" *[^ ]+| +")
_MEMO = 1 << 20
#: Substrings of one size that are looked up at once.
_PROBED = 1 << 17


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _char_values(points: np.ndarray) -> np.ndarray:
    return common.mixed(points + np.uint64(1))


def _bpe(text: str, rank: dict[str, int]) -> list[str]:
    """Merges the best-ranked neighbours, the leftmost first, until none can be."""
    parts, alive = list(text), [True] * len(text)
    before, after = [i - 1 for i in range(len(text))], [*range(1, len(text)), -1]
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            joined = parts[i] + parts[after[i]]
            if joined in rank:
                heapq.heappush(heap, (rank[joined], i, joined))

    for i in range(len(text)):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if not alive[i] or after[i] < 0 or parts[i] + parts[after[i]] != joined:
            continue
        j = after[i]
        parts[i], alive[j], after[i] = joined, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p, a in zip(parts, alive, strict=True) if a]


class Model:
    """The pieces of a SentencePiece model file, as sorted arrays."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(data)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation are supported")
        if any(p.type == USER for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.dummy_prefix, self.is_bpe = m.normalizer_spec.add_dummy_prefix, m.trainer_spec.model_type == 2
        self.size = len(m.pieces)
        self.shown = [p.piece for p in m.pieces]
        kinds = np.array([p.type for p in m.pieces])
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.special = kinds == CONTROL
        self.byte_value = np.full(self.size, -1, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_value[i] = int(self.shown[i][3:5], 16)
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.byte_value >= 0):
            self.byte_ids[self.byte_value[i]] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())

        usual = [i for i in range(self.size) if kinds[i] == NORMAL]
        score = {self.shown[i]: m.pieces[i].score for i in usual}
        levels = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: levels[s] for p, s in score.items()}
        splits: dict[str, tuple[str, str]] = {}
        if self.is_bpe:  # a piece that its own text doesn't merge into never appears
            for p in list(rank):
                if len(p) > 1:
                    parts = self._last_merge(p, rank)
                    if parts:
                        splits[p] = parts
        names = [self.shown[i] for i in usual if len(self.shown[i]) == 1 or not self.is_bpe or self.shown[i] in splits]
        # characters that pieces hold without being pieces get numbers beyond the vocabulary
        self.alphabet = np.array(sorted({ord(c) for p in score for c in p}), np.uint64)
        number = {self.shown[i]: i for i in usual}
        for c in self.alphabet.tolist():
            if chr(c) not in number:
                number[chr(c)] = self.size + c
                names.append(chr(c))
        self.longest = max(map(len, names), default=1)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for p in names:
            by_length.setdefault(len(p), []).append((int(self._hash_of(p)), p))
        self.keys, self.ids, self.scores = {}, {}, {}
        low = min(score.values(), default=0.0)
        for n, found in by_length.items():
            found.sort()
            self.keys[n] = np.array([h for h, _ in found], np.uint64)
            self.ids[n] = np.array([number[p] for _, p in found], np.int64)
            self.scores[n] = np.array([score.get(p, low - 10) for _, p in found])
        pairs = {(ord(a), ord(b)) for p in score for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(a << 21 | b for a, b in pairs), np.uint64)
        if self.is_bpe:
            self._merge_tables(rank, splits, number)

    @staticmethod
    def _hash_of(p: str) -> np.uint64:
        return _prefixes(_char_values(_points([p])).reshape(1, -1))[0, -1]

    @staticmethod
    def _last_merge(p: str, rank: dict[str, int]) -> tuple[str, str] | None:
        """The two parts whose merge makes p when BPE runs over p alone."""
        inner = {p[a:b] for a in range(len(p)) for b in range(a + 2, len(p) + 1)} - {p}
        parts = _bpe(p, {q: rank[q] for q in inner if q in rank})
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _merge_tables(self, rank: dict[str, int], splits: dict[str, tuple[str, str]], number: dict[str, int]) -> None:
        """Local numbers of symbols; which two make a piece, and of which two a piece is made."""
        symbols = sorted(set(splits) | {chr(c) for c in self.alphabet.tolist()})
        own = {p: i for i, p in enumerate(symbols)}
        self.local = np.full(self.size + 0x110000, -1, np.int64)
        for p, i in own.items():
            self.local[number[p]] = i
        self.rank = np.array([rank[p] if len(p) > 1 else -1 for p in symbols], np.int64)
        self.left = np.array([own[splits[p][0]] if p in splits else -1 for p in symbols], np.int64)
        self.right = np.array([own[splits[p][1]] if p in splits else -1 for p in symbols], np.int64)
        made = sorted((own[p[:i]] * len(symbols) + own[p[i:]], rank[p]) for p in rank for i in range(1, len(p)) if p[:i] in own and p[i:] in own)
        self.joined = np.array([k for k, _ in made] or [-1], np.int64)
        self.joined_rank = np.array([r for _, r in made] or [0], np.int64)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the pieces a and b (local numbers) side by side.

        The later of their last merges is undone again and again; at each step the pair at the border must
        not have been the better merge than the one that was made instead."""
        n, good = len(self.rank), np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # rank of the merge that comes next
        on_right = np.zeros(len(a), bool)  # whether that merge takes the right symbol
        while len(at):
            key = x * n + y
            spot = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
            r = self.joined_rank[spot]
            bad = (self.joined[spot] == key) & ((r < limit) | (on_right & (r == limit)))
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            on_right = ry >= rx  # of equal ranks the left one was merged first
            limit = np.where(on_right, ry, rx)
            x, y = np.where(on_right, x, self.right[x]), np.where(on_right, self.left[y], y)
        return good


def _prefixes(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, a row per word, starting with the empty one."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.uint64)
    base = np.uint64(common.BASE)
    with np.errstate(over="ignore"):
        for i in range(values.shape[1]):
            out[:, i + 1] = out[:, i] * base + values[:, i]
    return out


class _Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """Encodes texts, remembering the words that it has met."""

    def __init__(self, model: Model, words: int = 160_000):
        self.m, self.limit = model, words
        self.number = _Numbers()
        self.flat, self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.memo_key, self.memo_value = np.full(_MEMO, -1, np.int64), np.zeros(_MEMO, bool)
        self.powers = np.array([pow(common.BASE, i, 1 << 64) for i in range(model.longest + 1)], np.uint64)

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.m.local[a], self.m.local[b]
        key = x * len(self.m.rank) + y
        slot = (key * 0x9E3779B1 >> 7) & (_MEMO - 1)
        out = self.memo_value[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            out[new] = found = self.m.agree(x[new], y[new])
            self.memo_key[slot[new]], self.memo_value[slot[new]] = key[new], found
        return out

    def _found(self, hashes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
        """All pieces that end at low or later and before high: end, word, size, id and score, sorted by the first three.

        hashes has a row for each position, a column for each word; a size is one probe for all ends."""
        ends, rows, sizes, ids, scores = [], [], [], [], []
        for size, keys in self.m.keys.items():
            first = max(low, size)
            if first >= high:
                continue
            with np.errstate(over="ignore"):
                h = (hashes[first:high] - hashes[first - size : high - size] * self.powers[size]).ravel()
            spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.flatnonzero(keys[spot] == h)
            end, row = np.divmod(at, hashes.shape[1])
            ends.append(end + first)
            rows.append(row)
            sizes.append(np.full(len(at), size))
            ids.append(self.m.ids[size][spot[at]])
            scores.append(self.m.scores[size][spot[at]])
        if not ends:
            return (np.empty(0, np.int64),) * 5
        found = [np.concatenate(x) for x in (ends, rows, sizes, ids, scores)]
        order = np.lexsort(found[2::-1])
        return tuple(x[order] for x in found)

    def _words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length (a row of code points each): flat, and their number by word.

        Of paths of equal value the one whose last piece is the shortest is kept. Pieces are looked up for a
        block of ends at once, so a word that is alone in its length costs a few calls a character."""
        n, length = points.shape
        hashes = np.ascontiguousarray(_prefixes(_char_values(points)).T)
        value = np.full((length + 1, n), -np.inf)
        value[0] = 0
        last = np.full((length + 1, n), -1, np.int64)
        back = np.zeros((length + 1, n), np.int32)
        values, lasts, backs = value.ravel(), last.ravel(), back.ravel()  # views: place * n + word
        block = max(1, _PROBED // n)
        for low in range(1, length + 1, block):
            high = min(low + block, length + 1)
            end, row, size, piece, score = self._found(hashes, low, high)
            origin, target = (end - size) * n + row, end * n + row
            new = np.ones(len(end), bool)
            new[1:] = target[1:] != target[:-1]
            heads = np.flatnonzero(new)
            marks = np.searchsorted(end, np.arange(low, high + 1))
            firsts = np.searchsorted(heads, marks)
            for i in range(high - low):
                a, b = marks[i], marks[i + 1]
                if a == b:
                    continue
                worth = values[origin[a:b]]
                if self.m.is_bpe:
                    before = lasts[origin[a:b]]
                    inner = np.flatnonzero((before >= 0) & (worth > -np.inf))
                    if len(inner):
                        worth[inner[~self._agree(before[inner], piece[a:b][inner])]] = -np.inf
                else:
                    worth = worth + score[a:b]
                starts = heads[firsts[i] : firsts[i + 1]] - a
                best = np.maximum.reduceat(worth, starts)
                hit = np.flatnonzero((worth == np.repeat(best, np.diff(starts, append=b - a))) & (worth > -np.inf))
                spot = target[a:b][hit]
                one = np.ones(len(hit), bool)
                one[1:] = spot[1:] != spot[:-1]
                hit, spot = hit[one], spot[one]
                values[spot], lasts[spot], backs[spot] = worth[hit], piece[a:b][hit], size[a:b][hit]
        place, rows = np.full(n, length), np.arange(n)
        used = np.zeros((n, length + 1), bool)
        while len(rows):
            used[rows, place] = True
            if (last[place, rows] < 0).any():
                raise ValueError("a word has no encoding")
            place = place - back[place, rows]
            rows, place = rows[place > 0], place[place > 0]
        return last.T[used], used.sum(1)

    def _bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary (numbers beyond it) as byte pieces, or as the unknown piece."""
        odd = np.flatnonzero(ids >= self.m.size)
        if not len(odd):
            return ids, counts
        if not self.m.has_bytes:
            return np.where(ids >= self.m.size, self.m.unknown, ids), counts
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[odd] - self.m.size).tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(b) for b in raw]
        out = np.repeat(ids, times)
        out[np.repeat(ids >= self.m.size, times)] = self.m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, weights=times, minlength=len(counts)).astype(np.int64)

    def _learn(self, units: list[str]) -> None:
        """Encodes units, first cut where no piece holds the two characters at the border."""
        points = _points(units)
        lengths = np.array([len(u) for u in units])
        ends = np.cumsum(lengths)
        points = np.where(points == ord(" "), np.uint64(ord(SPACE)), points)
        pair = points[:-1] << np.uint64(21) | points[1:]
        spot = np.minimum(np.searchsorted(self.m.pairs, pair), max(0, len(self.m.pairs) - 1))
        cut = np.ones(len(points), bool)  # whether a segment starts here
        cut[1:] = self.m.pairs[spot] != pair if len(self.m.pairs) else True
        cut[(ends - lengths)] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(points))
        counts, parts, where = np.zeros(len(starts), np.int64), [], []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for some in np.array_split(rows, max(1, len(rows) * int(size) // 2_000_000)):
                at = points[starts[some][:, None] + np.arange(size)]
                if size == 1:
                    code = at[:, 0]
                    spot = np.minimum(np.searchsorted(self.m.alphabet, code), len(self.m.alphabet) - 1)
                    plain = np.flatnonzero(self.m.alphabet[spot] == code)
                    ids, n = (code + np.uint64(self.m.size)).astype(np.int64), np.ones(len(some), np.int64)
                    if len(plain):
                        ids[plain] = self._words(at[plain])[0]
                else:
                    ids, n = self._words(at)
                counts[some] = n
                parts.append(ids)
                where.append(np.repeat(some, n))
        owner = np.concatenate(where)
        flat = np.concatenate(parts)[np.argsort(owner, kind="stable")]
        unit = np.searchsorted(ends, starts, side="right")
        flat, n = self._bytes(flat, np.bincount(unit, weights=counts, minlength=len(units)).astype(np.int64))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
        self.counts, self.flat = np.concatenate([self.counts, n]), np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.number) > self.limit:
            self.number.clear()
            self.flat, self.starts, self.counts = self.flat[:0], self.starts[:0], self.counts[:0]
        prefix = " " if self.m.dummy_prefix else ""
        lists = [_UNITS.findall(prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        number, known = self.number, len(self.number)
        units = [u for x in lists for u in x]
        place = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
        if len(number) > known:
            new = list(number)[known:]
            self._learn(new)
        n = self.counts[place]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[place] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        flat = self.flat[at]
        total = np.cumsum([0, *[len(x) for x in lists]])
        marks = np.concatenate([[0], ends])[total]
        return [flat[a:b] for a, b in zip(marks, marks[1:], strict=False)]


class Decoder:
    """Joins pieces to text; runs of byte pieces are read as UTF-8."""

    def __init__(self, model: Model):
        self.m = model
        self.raw = [b"" if model.special[i] else bytes([v]) if (v := int(model.byte_value[i])) >= 0 else model.shown[i].replace(SPACE, " ").encode("utf-8") for i in range(model.size)]
        self.raw[model.unknown] = " ⁇ ".encode()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.m.dummy_prefix and text.startswith(" ") else text


def load(path: str) -> Model:
    """The model of a file that the driver reads; an empty or broken file raises ValueError or an index error."""
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, text: str = "text", chars: int = 1_000_000) -> DataFrame:
    """All columns of docs and piece_ids (an array of int; a column of that name is replaced).

    Null and empty texts have no pieces; words are encoded wherever they stand alike, so repeated rows get
    equal ids. The model is a file of fixed size and travels with the tasks."""
    common.small_batches(docs.sparkSession)
    kept = docs.drop("piece_ids")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model)
        for batch in batches:
            for pdf in common.slices(batch, text, chars):
                ids = encoder.encode([t if isinstance(t, str) else "" for t in pdf[text]])
                yield pdf.assign(piece_ids=[x.astype(np.int32) for x in ids])

    return common.map_exactly(kept, rows, "piece_ids array<int>")


def decode(encoded: DataFrame, model: Model, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """All columns and the text of the pieces; null ids give null."""
    kept = encoded.drop(to)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(model)
        for pdf in batches:
            yield pdf.assign(**{to: [None if x is None else decoder.decode(np.asarray(x)) for x in pdf[ids]]})

    return common.map_exactly(kept, rows, f"`{to}` string")


def round_trip(docs: DataFrame, model: Model, text: str = "text", chars: int = 1_000_000) -> DataFrame:
    """All columns of docs and n_pieces, pieces_sha256 (of the ids joined by blanks), decoded_sha256 (of the
    text that the ids decode to) and exact (whether it is the text, null counting as empty); columns of
    docs with these names are replaced."""
    names = ("n_pieces", "pieces_sha256", "decoded_sha256", "exact")
    common.small_batches(docs.sparkSession)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(model), Decoder(model)
        shown = [str(i).encode() for i in range(model.size)]
        for batch in batches:
            for pdf in common.slices(batch, text, chars):
                texts = [t if isinstance(t, str) else "" for t in pdf[text]]
                ids = encoder.encode(texts)
                again = [decoder.decode(x) for x in ids]
                yield pdf.assign(
                    n_pieces=[len(x) for x in ids],
                    pieces_sha256=[hashlib.sha256(b" ".join(map(shown.__getitem__, x.tolist()))).hexdigest() for x in ids],
                    decoded_sha256=[hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in again],
                    exact=[a == b for a, b in zip(again, texts, strict=True)],
                )

    return common.map_exactly(kept, rows, "n_pieces long, pieces_sha256 string, decoded_sha256 string, exact boolean")
