"""Suffix-array deduplication, fill-in-the-middle and vector codes against plain versions, on odd rows and tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import codebooks, infill, queries, suffixes

LONG = "long words follow here " * 4000
FAR = (1 << 53) + 1
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (5, LONG), (None, "no id"), (6, "naïve 日本語   text\x1c with\x0bspaces"), (FAR, "far"), (7, "<P> in it"), (None, None)]


# --- 11 suffix arrays -----------------------------------------------------------------------------------


def plain_repeats(rows, width=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; ids that repeat have the same text."""
    texts = sorted({(i is None, i or 0, (t or "").encode()) for i, t in rows})
    seen, gone = set(), {}
    for none, i, raw in texts:
        cut = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - width + 1):
            window = raw[at : at + width]
            if window in seen:
                cut[at : at + width] = True
            seen.add(window)
        gone[none, i, raw] = cut[: len(raw)]
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        cut = gone[i is None, i or 0, raw]
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        spans = sum(bool(c) and (k == 0 or not cut[k - 1]) for k, c in enumerate(cut))
        out.append((i, len(raw), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_repeats(docs, **options):
    found = suffixes.remove_repeats(docs, **options)
    return sorted((tuple(r)[:5] for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_order_and_prefixes_of_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        parts = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)) for _ in range(rng.integers(1, 9))]
        parts += [parts[0], parts[-1][:20], np.full(40, 256)]
        t = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        keys = suffixes.symbol_keys(t, 30)
        order = suffixes.suffix_order(t, keys, 16)
        assert sorted(order.tolist()) == list(range(len(t)))

        def text(i):
            own = t[i : i + 16].tolist()
            return own[: own.index(0) + 1] if 0 in own else own

        names = [text(i) for i in order]
        assert names == sorted(names)
        whole = [i for i in order.tolist() if 0 not in t[i : i + 16] and i + 16 <= len(t)]
        expected = [next((k for k in range(16) if t[a + k] != t[b + k]), 16) for a, b in zip(whole, whole[1:])]
        assert suffixes.common_prefixes(np.array(whole, np.int64), keys, 16).tolist() == expected


def test_every_window_has_one_segment():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice((0, 50, 99, 100, 101, 300, 5000)))).encode() for _ in range(40)] + [b"x" * 300_000]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    bins = np.zeros(suffixes.BINS, np.uint8)
    bins[::3] = 1
    for frequent in (None, bins):
        first, n, _ = suffixes.anchored(raw, ends, 100, frequent)
        windows = np.concatenate([np.arange(a, a + k) for a, k in zip(first.tolist(), n.tolist())])
        expected = [np.arange(e - len(t), e - 99) for e, t in zip(ends.tolist(), texts) if len(t) >= 100]
        assert windows.tolist() == np.concatenate(expected).tolist()


@pytest.mark.parametrize("blocks", [1, 7])
def test_repeated_bytes_are_removed(documents, blocks):
    rng = random.Random(blocks)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60)] + ["é", "日本", "\x00", "<", "\n"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(60), "Licensed to whoever may come across this line, without any warranty at all, as it is written here."
    rows = [(i, text(rng.randrange(120))) for i in range(0, 60, 2)]
    rows += [(i, text(20) + passage[rng.randrange(50) :] + text(10)) for i in range(1, 40, 4)]
    rows += [(i, text(3) + line[rng.randrange(8) :] + text(3)) for i in range(200, 260)]
    rows += [(300 + i, rows[3][1]) for i in range(12)] + [(320, "ab" * 400), (321, "b" * 500), (322, "b" * 99), (323, "b" * 100), (324, passage + passage)]
    rows += ODD + [(FAR + 1, passage), (None, passage[::-1]), (326, LONG)]
    assert found_repeats(documents(rows), blocks=blocks) == plain_repeats(rows)


def test_kept_bytes_and_places(documents):
    rows = [(2, "x" + "0123456789" * 10 + "yy"), (1, "ab" + "0123456789" * 10)]
    docs = documents(rows).withColumn("n_bytes", F.lit("clash")).withColumn("home", F.lit(1))
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, texts=True).collect()}
    assert bytes(found[2]["kept"]) == b"xyy" and found[2]["removed"] == [1, 101] and found[1]["n_removed"] == 0
    with pytest.raises(ValueError, match="bytes"):
        suffixes.remove_repeats(docs, width=10)
    assert suffixes.remove_repeats(documents([])).count() == 0


def test_frequent_runs_change_no_result(documents, monkeypatch):
    line = "a line of more than a hundred bytes that a great many documents of this table share with one another, word by word"
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("mnopq") for _ in range(40)) + line + "".join(rng.choice("mnopq") for _ in range(40))) for i in range(150)]
    expected = plain_repeats(rows)
    assert suffixes.frequent_bins(documents(rows)) is not None
    assert found_repeats(documents(rows), blocks=3) == expected
    monkeypatch.setattr(suffixes, "frequent_bins", lambda docs: None)
    assert found_repeats(documents(rows), blocks=3) == expected


# --- 12 fill in the middle ------------------------------------------------------------------------------


def test_tokens_forms_and_way_back(documents):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["word", "x", " ", "9", "é", "<", "P", ">", "\n", "日", "<S"]) for _ in range(rng.randrange(30)))) for i in range(400)] + ODD
    found = infill.transform(documents(rows).withColumn("form", F.lit("clash")).withColumn("_back", F.lit(3)))
    digests = {(r["doc_id"], r["output_sha256"]): r for r in infill.digest(found).collect()}
    forms = defaultdict(int)
    for r in found.collect():
        text = r["text"] or ""
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        assert r["n"] == len(tokens)
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            expected = ("plain", None, None, text)
        elif h4 % 100 < 20:
            expected = ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            expected = ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected
        assert infill.restored(r["output"], r["form"]) == text
        d = digests[r["doc_id"], hashlib.sha256(r["output"].encode()).hexdigest()]
        assert d["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        forms[r["form"]] += 1
    assert set(forms) == {"plain", "psm", "spm"} and FAR in {r["doc_id"] for r in found.collect()}
    assert infill.digest(infill.transform(documents([]))).count() == 0


# --- 13 vector codes ------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    length = None
    kept = []
    for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float("-inf") if x is None else x for x in r[1] or []])):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        length = len(v) if length is None else length
        if len(v) == length:
            kept.append((i, [int(np.floor(4096 * x)) for x in v], label))
    cuts = codebooks.cuts(length, parts)
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cuts]

    def assign(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for part, (a, b) in enumerate(cuts):
            own = [(assign(books[part], v[a:b])[1], v[a:b]) for _, v, _ in kept]
            for k in range(len(books[part])):
                members = [x for e, x in own if e == k]
                if members:
                    books[part][k] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        best = [assign(books[p], v[a:b]) for p, (a, b) in enumerate(cuts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = defaultdict(int)
    for _, _, e, label in coded:
        total[label] += e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in coded), key=str)


def vectors(n, length, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=length), 1 if i % 3 else 4)], [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    return rows


@pytest.mark.parametrize(("n", "length"), [(150, 16), (40, 19), (5, 8), (30, 3), (4, 0)])
def test_codes_equal_the_plain_rounds(spark, n, length):
    rows = vectors(n, length) + [(900, None, 1), (901, [None] * length if length else None, 1), (902, [float("nan")] * length if length else None, None)]
    rows += [(903, [0.5] * (length + 1), 1), (None, [0.25] * length, 2), (2, [0.25] * length, 2), (2, [0.25] * length, 2), (FAR, [0.125] * length, None)]
    rows += [(1000 + i, [0.25] * length, 7) for i in range(50)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).withColumn("_label", F.lit(1))
    assert sorted((tuple(r) for r in codebooks.compress(table).collect()), key=str) == plain_codes(rows)


def test_leaves_share_the_paths_above():
    rng = np.random.default_rng(4)
    leaves = np.unique(rng.integers(-3, 3, (9000, 6)), axis=0)
    entries = rng.integers(-5, 5, (16, 6))
    for own, d in codebooks.leaf_distances(leaves, entries):
        assert (d == ((leaves[own][:, None] - entries[None]) ** 2).sum(2)).all()


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    found = codebooks.compress(empty)
    assert found.count() == 0 and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codebooks.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        codebooks.compress(spark.createDataFrame([(1, [1e300] * 8, 1)], VECTORS))


def test_the_queries_are_registered():
    for name in ("op11_suffix_dedup", "op12_fill_in_middle", "op13_vector_codes"):
        assert name in queries.QUERIES


# --- ids beyond 2**53 beside nulls, odd vectors -----------------------------------------------------------


def test_ids_stay_exact_beside_nulls(spark, documents):
    from gridloom.llm import fingerprints, langid, pieces, secrets, warc

    rows = [(FAR, "one text of words", "en"), (FAR + 2, "another text of words", "en"), (None, "no id at all", "en")]
    docs = documents(rows).withColumn("other", F.lit(FAR))
    model = pieces.load(queries.PIECE_MODEL)
    frames = [
        pieces.encode(docs, model), pieces.decode(pieces.encode(docs, model), model), pieces.round_trip(docs, model), langid.identify(docs, langid.fit(docs)),
        secrets.scan(docs, None), fingerprints.compare_next(docs), suffixes.remove_repeats(docs), infill.transform(docs),
    ]
    for found in frames:
        assert {r["doc_id"] for r in found.collect()} == {FAR, FAR + 2, None}, found.columns
    pages = spark.createDataFrame([(FAR, "u", "x"), (FAR + 2, "u", "x"), (None, "u", "y")], "page_id long, url string, html string")
    assert {(r["page_id"], r["refers_to"]) for r in warc.round_trip(pages).collect()} == {(FAR, None), (FAR + 2, FAR), (None, None)}


def test_empty_and_huge_vectors(spark):
    from gridloom.llm import topk

    table = spark.createDataFrame([(0, []), (1, []), (2, []), (50, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    huge = spark.createDataFrame([(0, [1.0, 1.0]), (1, [-1e300, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(huge, F.col("vec_id") % 50 == 0).collect()
