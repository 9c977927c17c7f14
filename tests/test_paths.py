"""Pointer paths, claims, comparisons, borders and picture files against plain versions, and on odd rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import analytics, paths, seams
from gridloom.sources import grids, pictures


def plain_line(r0, c0, r1, c1):
    """The cells whose inside the line from center to center passes, found from all crossings in order."""
    nx, ny = abs(c1 - c0), abs(r1 - r0)
    crossings = sorted([((2 * i + 1) * ny, 0) for i in range(nx)] + [((2 * i + 1) * nx, 1) for i in range(ny)])
    at, out = [r0, c0], [(r0, c0)]
    for _, kind in crossings:
        at[1 - kind] += (1 if (c1, r1)[kind] > (c0, r0)[kind] else -1)
        out.append(tuple(at))
    return out


def test_lines_equal_plain_ones(spark):
    ends = [(r0, c0, r1, c1) for r0 in (0, 3) for c0 in (0, 5) for r1 in range(-2, 8) for c1 in range(-3, 9)] + [(0, 0, 1000, 7), (5, 5, 5, 5)]
    table = spark.createDataFrame([(i, *e, "kept") for i, e in enumerate(ends)] + [(-1, None, 0, 1, 1, "gone")], "id long, r0 long, c0 long, r1 long, c1 long, note string")
    found = {}
    for r in paths.line_cells(table).orderBy("id", "step").collect():
        found.setdefault(r["id"], []).append((r["r"], r["c"]))
        assert r["note"] == "kept"
    assert found == {i: plain_line(*e) for i, e in enumerate(ends)}
    assert plain_line(0, 0, 2, 2) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]


def test_strokes_and_crossed_edges(spark):
    samples = [("a", 1, 0, 0), ("a", 2, 0, 3), ("a", 3, 2, 3), ("a", 4, 0, 3), ("b", 1, 4, 4), ("c", 1, 1, 1), ("c", 2, 1, 1)]
    table = spark.createDataFrame(samples, "path_id string, place int, r int, c int")
    cells = {}
    for r in paths.strokes(table).orderBy("path_id", "ord").collect():
        cells.setdefault(r["path_id"], []).append((r["r"], r["c"]))
    assert cells == {"a": [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3)], "b": [(4, 4)], "c": [(1, 1)]}
    met = [tuple(r) for r in paths.crossed(table).orderBy("path_id", "ord").collect()]
    assert met == [("a", 0, 0, 0, "v"), ("a", 1, 0, 1, "v"), ("a", 2, 0, 2, "v"), ("a", 3, 0, 3, "h"), ("a", 4, 1, 3, "h")]
    assert paths.strokes(table.limit(0)).count() == 0


def test_walks_with_gaps_equal_plain_ones_and_are_dealt_in_small_tasks(spark, monkeypatch):
    rng = random.Random(8)
    paths_of = {k: [(i * 3, *((None, None) if rng.random() < 0.2 else (rng.randrange(-3, 6), rng.randrange(5)))) for i in range(rng.randrange(1, 40))] for k in range(30)}
    cells, edges = {}, {}
    for k, stops in paths_of.items():
        known = [None, *[s if s[1] is not None else None for s in stops], None]
        # a sample between gaps is its cell
        lines = [(at, to or at) for before, at, to in zip(known, known[1:], known[2:]) if at and (to or not before)]
        walk = [cell for a, b in lines for cell in plain_line(*a[1:], *b[1:])]
        cells[k] = list(dict.fromkeys(walk))
        met = [(min(a[0], b[0]), min(a[1], b[1]), "v" if a[0] == b[0] else "h") for a, b in zip(walk, walk[1:]) if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1]
        edges[k] = list(dict.fromkeys(met))
    table = spark.createDataFrame([(k, *s) for k, stops in paths_of.items() for s in stops], "path_id int, place int, r int, c int")
    monkeypatch.setattr(paths, "TASK_SAMPLES", 50, raising=False)
    for of, expected in ((paths.strokes, cells), (paths.crossed, edges)):
        found = {k: [] for k in paths_of}
        rows = of(table)
        for x in rows.orderBy("path_id", "ord").collect():
            assert x["ord"] == len(found[x["path_id"]])
            found[x["path_id"]].append(tuple(x[2:]))
        assert found == expected
        # tasks follow the samples, and cells met again are not sorted
        assert rows.rdd.getNumPartitions() >= table.count() / 50
        assert "SortAggregate" not in rows._jdf.queryExecution().toString()


def plain_claims(grid):
    rows, cols, taken, out = len(grid), len(grid[0]), set(), []
    for r in range(rows):
        for c in range(cols):
            if (r, c) in taken:
                continue
            end = c
            while end + 1 < cols and (r, end + 1) not in taken and grid[r][end + 1] == grid[r][c]:
                end += 1
            low = r
            while low + 1 < rows and all((low + 1, k) not in taken and grid[low + 1][k] == grid[r][c] for k in range(c, end + 1)):
                low += 1
            taken |= {(i, k) for i in range(r, low + 1) for k in range(c, end + 1)}
            out.append((r, c, low - r + 1, end - c + 1))
    return out


def test_claims_equal_the_plain_greedy(spark):
    rng = random.Random(4)
    models = {f"m{k}": [[rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randrange(1, 9))]] for k in range(30)}
    for name, grid in models.items():
        width = len(grid[0])
        grid += [[rng.choice("ab") for _ in range(width)] for _ in range(rng.randrange(8))]
        if name == "m3":
            grid[:] = [["a"] * width] * 5
    rows = [(m, r, c, f, 1.0) for m, g in models.items() for r, line in enumerate(g) for c, f in enumerate(line)]
    rng.shuffle(rows)
    cells = spark.createDataFrame(rows, "model_id string, r int, c int, fabric_id string, confidence double")
    found = {}
    for x in seams.claims(cells).collect():
        found.setdefault(x["model_id"], []).append((x["r"], x["c"], x["height"], x["width"]))
    assert {m: sorted(v) for m, v in found.items()} == {m: sorted(plain_claims(g)) for m, g in models.items()}
    merged = {tuple(r) for r in seams.merges(cells, "modern").collect()}
    expected = set()
    for m, g in models.items():
        for r, c, h, w in plain_claims(g):
            expected |= {(m, i, k, "v") for i in range(r, r + h) for k in range(c, c + w - 1)} | {(m, i, k, "h") for i in range(r, r + h - 1) for k in range(c, c + w)}
    assert merged == expected
    sizes = {r["model_id"]: r["pieces"] for r in seams.estimate(cells, seams.merges(cells, "modern")).collect()}
    assert sizes == {m: len(plain_claims(g)) for m, g in models.items()}


def test_borders_of_grids_without_any(spark):
    m = grids.authored(spark, ("checker", "uniform"))
    edges = m.quilts.select("model_id", *[F.transform(F.sequence(F.lit(0), F.col(n)), lambda i: i * 10.0).alias(a) for n, a in (("cols", "xs"), ("rows", "ys"))])
    found = {r["model_id"]: r for r in analytics.borders_found(m.cells, edges).collect()}
    none = found["checker"]
    assert (none["left"], none["top_px"], none["fabric_id"], none["confidence"]) == (0, 0.0, None, 1.0)
    whole = found["uniform"]
    assert (whole["left"], whole["bottom"], whole["right_px"], whole["fabric_id"], whole["confidence"]) == (4, 6, 40.0, "c", 1.0)


def test_a_comparison_without_fabrics(spark):
    m = grids.authored(spark, ("tiny", "small"))
    other = grids.Models(m.quilts, m.cells, m.fabrics.where("model_id = 'tiny'"), m.borders)
    found = {r["model_id"]: r for r in analytics.compared_models(m, other).collect()}
    assert (found["tiny"]["accuracy"], found["tiny"]["mapping"], found["tiny"]["stages"]["grid"]) == (1.0, {"r": "r", "w": "w"}, 1.0)
    assert (found["small"]["accuracy"], found["small"]["mapping"]) == (0.0, None)


def test_pictures_in_files(spark, tmp_path):
    m = grids.authored(spark, ("tiny", "small"))
    named = {"tiny": "a+b c é", "small": "plain"}
    drawn = pictures.raster(m, 4).replace(named, subset=["model_id"])
    told = pictures.truths(m, 4).replace(named, subset=["model_id"]).where("model_id = 'plain'")
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # writing again leaves the same files
        assert {r["model_id"] for r in pictures.save(drawn, folder, told).collect()} == set(named.values())
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a+b c é.png", "plain.json", "plain.png"]
    side = json.loads((tmp_path / "out" / "plain.json").read_text())
    assert side == {"scale": 4, "width": 16, "height": 12, "rows": 2, "cols": 3, "first_x": 4.0, "first_y": 4.0}
    (tmp_path / "out" / "broken.png").write_bytes(b"no picture")
    key = lambda r: (r["model_id"], r["y"], r["x"])
    assert sorted(pictures.scan(spark, folder).collect(), key=key) == sorted(drawn.select("model_id", F.col("y"), F.col("x"), *pictures.RGB).collect(), key=key)


def test_a_picture_too_large_for_a_file_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pictures, "MOST_PIXELS", 10)
    with pytest.raises(Exception, match="pixels"):
        pictures.save(pictures.raster(grids.authored(spark, ("tiny",)), 8), f"file://{tmp_path}/out").collect()
