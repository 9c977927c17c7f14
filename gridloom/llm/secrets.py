"""Secret scanning: three fixed patterns, and automata inferred from the credentials that they find.

A labelled credential is a value that one of the fixed patterns matches; its kind is the label. For
each kind a prefix tree of symbol strings is built and its statistically compatible states are merged
(a Hoeffding bound on every outgoing and ending frequency, recursively), which leaves a probabilistic
automaton. Each run of credential characters outside the fixed matches is then a candidate, and its
likelihood under each automaton is set against a background of ordinary runs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex")
# (?a) keeps the case-insensitive keywords to ASCII letters
_ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")

#: Symbols of the automata and how many characters each stands for.
_CLASSES = {"0": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/_.=-"}
_SYMBOL = {ord(c): k for k, cs in _CLASSES.items() for c in cs}
_SPREAD = {k: -math.log(len(cs)) for k, cs in _CLASSES.items()}
END = "$"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns' matches, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    # a run of 24 hexadecimal digits lies inside a run of credential characters, which is cheaper to look for
    for run in _RUN.finditer(text):
        found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text, run.start(), run.end())]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def symbols(value: str) -> str:
    return value.translate(_SYMBOL)


class Automaton:
    """A probabilistic automaton over symbols, learned by merging the states of a prefix tree."""

    def __init__(self, values: Counter, alpha: float = 0.05, depth: int = 128):
        self.counts: list[Counter] = [Counter()]
        self.next: list[dict[str, int]] = [{}]
        for value, n in values.items():
            at = 0
            for s in value[:depth]:
                self.counts[at][s] += n
                if s not in self.next[at]:
                    self.next[at][s] = len(self.counts)
                    self.counts.append(Counter())
                    self.next.append({})
                at = self.next[at][s]
            self.counts[at][END] += n
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.counts[a].total(), self.counts[b].total()
            if not n or not m:
                continue
            slack = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.counts[a][s] / n - self.counts[b][s] / m) > slack for s in {*self.counts[a], *self.counts[b]}):
                return False
            todo += [(self.next[a][s], t) for s, t in self.next[b].items() if s in self.next[a] and self.next[a][s] != t]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the subtree at `tree`, which has no cycles, to the automaton at `into`."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.counts[a].update(self.counts[b])
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def _merge_states(self) -> None:
        kept, edge = [0], [(0, s) for s in sorted(self.next[0])]
        while edge:
            at, s = edge.pop(0)
            state = self.next[at][s]
            if state in kept:
                continue
            twin = next((k for k in kept if self._alike(k, state)), None)
            if twin is None:
                kept.append(state)
                edge += [(state, x) for x in sorted(self.next[state])]
                continue
            self.next[at][s] = twin
            self._fold(twin, state)
            edge += [(k, x) for k in kept for x in sorted(self.next[k]) if self.next[k][x] not in kept and (k, x) not in edge]
        self.states = len(kept)
        self.total = {k: self.counts[k].total() for k in kept}

    def log_likelihood(self, value: str, floor: float = 1e-3) -> float:
        """Mean log probability of a symbol; after a symbol that was never seen it stays in its state."""
        at, total = 0, 0.0
        for s in value:
            n = self.total.get(at, 0)
            total += math.log(max(self.counts[at][s] / n if n else 0, floor)) + _SPREAD[s]
            at = self.next[at].get(s, at)
        return total / max(1, len(value))


class Background:
    """Symbol pairs of ordinary runs."""

    def __init__(self, values: Counter):
        self.pairs: dict[str, Counter] = defaultdict(Counter)
        for value, n in values.items():
            for a, b in zip(END + value, value, strict=False):
                self.pairs[a][b] += n

    def log_likelihood(self, value: str) -> float:
        total = 0.0
        for a, b in zip(END + value, value, strict=False):
            row = self.pairs.get(a, Counter())
            total += math.log((row[b] + 0.5) / (row.total() + 0.5 * len(_CLASSES))) + _SPREAD[b]
        return total / max(1, len(value))


class Grammar:
    """Automata by kind and the background; score() is the best log likelihood ratio a symbol."""

    def __init__(self, labelled: dict[str, Counter], ordinary: Counter, threshold: float = 0.75):
        self.automata = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        self.background, self.threshold = Background(ordinary), threshold

    def score(self, run: str) -> float:
        value = symbols(run)
        usual = self.background.log_likelihood(value)
        return max((a.log_likelihood(value) - usual for a in self.automata.values()), default=-math.inf)

    def spans(self, text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
        """Runs outside the fixed matches whose format is likelier a credential's."""
        found = []
        for run in _RUN.finditer(text):
            a, b = run.span()
            if not any(x < b and a < y for x, y, *_ in taken) and self.score(run[0]) > self.threshold:
                found.append((a, b, "grammar", run[0]))
        return found


def fit(docs: DataFrame, text: str = "text", sample_rows: int = 40_000, values: int = 1_000) -> Grammar:
    """Learns from about `sample_rows` documents (all, if fewer), chosen by a hash of the text, and of
    their distinct values from at most `values` a kind, the first by hash. Both bounds hold at any size."""
    n = docs.count()
    part = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    if n > sample_rows:
        part = part.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample_rows / n)))

    def values_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for t in pdf["t"]:
                base = base_spans(t)
                seen.update((k, symbols(v)) for _, _, k, v in base)
                seen.update(("", symbols(m[0])) for m in _RUN.finditer(t) if not any(x < m.end() and m.start() < y for x, y, *_ in base))
            yield pd.DataFrame([(k, v, c) for (k, v), c in seen.items()], columns=["kind", "value", "n"])

    found = part.mapInPandas(values_of, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = common.written(found, "secret_values")
    labelled: dict[str, Counter] = {}
    for kind in ("", *KINDS):
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(values).collect()
        labelled[kind] = Counter({r["value"]: r["n"] for r in rows})
    ordinary = labelled.pop("")
    return Grammar(labelled, ordinary)


def _joined(spans: list[tuple[int, int, str, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def scan(docs: DataFrame, grammar: Grammar | None, text: str = "text") -> DataFrame:
    """All columns of docs and n_assign, n_access, n_hex, base_spans, spans (a column of docs with such a
    name is replaced). Null is scanned as the empty text, which has no spans; repeated rows are each
    scanned. Offsets are code points, the end exclusive. The grammar is a small fitted model."""
    names = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    common.small_batches(docs.sparkSession)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    order = {k: i for i, k in enumerate((*KINDS, "grammar"))}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf[text]:
                t = t if isinstance(t, str) else ""
                base = base_spans(t)
                n = Counter(k for _, _, k, _ in base)
                more = grammar.spans(t, base) if grammar else []
                out.append((*(n[k] for k in KINDS), _joined(base), _joined(sorted(base + more, key=lambda x: (x[0], order[x[2]])))))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return common.map_exactly(kept, rows, "n_assign long, n_access long, n_hex long, base_spans string, spans string")


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns of scanned rows, a row each; a text without spans has the hash of the empty string."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


__all__ = ["Automaton", "Grammar", "base_spans", "digest", "fit", "scan"]
