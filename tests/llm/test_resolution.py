"""The near-duplicate join against brute force, with every way of comparing lists in use."""

import random

import pytest

from gridloom.llm import nearjoin


def plain(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return {(rows[i][0], len(x), rows[top(i)][0]) for i, x in enumerate(sets)}


def copies(seed, bases=4, each=25, words=60, edits=4):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(words)]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(words)] = "x" + str(rng.randrange(10**6))
            texts.append(" ".join(own))
    texts += ["", None, "one", "one", "One two", "one  two", " ".join(["a"] * 400)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("short", "part", "limit"), [(8, 400, 1_000_000), (2, 5, 1_000_000), (1, 3, 0)])
def test_links_match_brute_force(spark, documents, monkeypatch, short, part, limit):
    monkeypatch.setattr(nearjoin, "SHORT_LIST", short)
    monkeypatch.setattr(nearjoin, "PART", part)
    monkeypatch.setattr(nearjoin.frequent, "__defaults__", (limit,))
    rows = copies(short)
    found = nearjoin.link(documents(rows)).collect()
    assert {tuple(r) for r in found} == plain(rows)


def chained(n=240, pool=24):
    """Different texts that share passages, so that all of them chain; every sixth has a near copy."""
    rng = random.Random(5)
    passages = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(pool)]
    texts = []
    for i in range(n):
        text = " ".join([*(f"u{i}w{j}" for j in range(30)), *rng.sample(passages, 4)])
        texts += [text, text + " and more"] if i % 6 == 0 else [text]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("cost", [0, 2, 10**9])
def test_chained_texts_meet_in_bounded_groups(spark, documents, monkeypatch, tmp_path, cost):
    part, original, log = 20, nearjoin._outer, str(tmp_path / "sizes")

    def watched(pdf):
        with open(log, "a") as f:
            f.write(f"{len(pdf)}\n")
        return original(pdf)

    monkeypatch.setattr(nearjoin, "SHORT_LIST", 2)
    monkeypatch.setattr(nearjoin, "PART", part)
    monkeypatch.setattr(nearjoin, "PAIR_COST", cost, raising=False)
    monkeypatch.setattr(nearjoin.frequent, "__defaults__", (0,))
    monkeypatch.setattr(nearjoin, "_outer", watched)
    rows = chained()
    assert {tuple(r) for r in nearjoin.link(documents(rows)).collect()} == plain(rows)
    sizes = [int(x) for x in open(log)] if (tmp_path / "sizes").exists() else []
    assert max(sizes, default=0) <= 5 * part
    assert cost == 2 or bool(sizes) == (cost > 0)


def test_edge_rows(spark, documents):
    text = "the same words stand here in both of these texts"
    rows = [(1, text), (1, text), (None, text), (2, "other words that have nothing to do with it at all"), (None, None), (3, "")]
    found = sorted(map(tuple, nearjoin.link(documents(rows)).collect()), key=str)
    assert found.count((1, 6, 1)) == 2 and (None, 6, 1) in found and (3, 0, 3) in found and (None, 0, None) in found
    kept = [r["doc_id"] for r in nearjoin.keep_first(documents(rows)).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, None]
    assert nearjoin.link(documents([])).count() == 0
