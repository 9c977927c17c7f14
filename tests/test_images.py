"""Pictures, palettes and grids against plain versions, and on odd pictures."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import analytics, clusters, lattice
from gridloom.sources import documents, grids, pictures


def picture(spark, arrays, channel="gray"):
    rows = [(i, y, x, float(v)) for i, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"image_id string, y long, x long, {channel} double")


def checker(widths, heights, light=200, dark=60):
    r, c = np.repeat(np.arange(len(heights)), heights), np.repeat(np.arange(len(widths)), widths)
    return np.where((r[:, None] + c[None]) % 2 == 0, dark, light).astype(float)


def profiles_of(a):
    m = np.pad(a, 1, mode="reflect")
    down, along = m[:-2] + 2 * m[1:-1] + m[2:], m[:, :-2] + 2 * m[:, 1:-1] + m[:, 2:]
    return np.abs(down[:, 2:] - down[:, :-2]).sum(0), np.abs(along[2:] - along[:-2]).sum(1)


# --- palettes ----------------------------------------------------------------------------------------------


def plain_palette(points, tried):
    colors, n = np.unique(points, axis=0, return_counts=True)
    seeds = [colors[min(range(len(n)), key=lambda i: (-n[i], colors[i].tolist()))]]
    while len(seeds) < max(tried):
        d = np.min([((colors - s) ** 2).sum(1) for s in seeds], 0) * n
        if d.max() <= 0:
            break
        seeds.append(colors[min(range(len(n)), key=lambda i: (-d[i], colors[i].tolist()))])
    ks = [k for k in tried if k <= len(seeds)] or [len(seeds)]
    state = {k: np.array(seeds[:k]) for k in ks}
    for _ in range(clusters.ROUNDS):
        far = 0.0
        for k, centers in state.items():
            own = ((colors[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            new = np.array([np.round((colors[own == i] * n[own == i, None]).sum(0) / n[own == i].sum(), 9) if (own == i).any() else centers[i] for i in range(k)])
            far = max(far, float(np.sqrt(((new - centers) ** 2).sum(1)).max()))
            state[k] = new
        yield_rest = far < clusters.REST
        if yield_rest:
            break
    best = None
    for k, centers in sorted(state.items()):
        d = np.sort(np.sqrt(((colors[:, None] - centers[None]) ** 2).sum(2)), 1)
        a, b = d[:, 0], d[:, 1] if k > 1 else d[:, 0]
        s = float(np.average((b - a) / np.where(b == 0, 1, b), weights=n))
        if best is None or round(s, 9) > round(best[1], 9):
            best = (k, s, centers)
    return best[0], best[1], sorted(best[2].tolist())


@pytest.mark.parametrize("tried", [clusters.TRIED, (3,)])
def test_palettes_equal_plain_kmeans(spark, tried):
    rng = np.random.default_rng(6)
    images = {
        "three": np.concatenate([rng.normal(c, 3, (200, 3)).round() for c in ((30, 120, 130), (120, 160, 90), (220, 128, 128))]),
        "two": np.concatenate([np.full((50, 3), 10), np.full((9, 3), 200)]), "one": np.full((20, 3), 7), "noise": rng.integers(0, 256, (150, 3)),
    }
    rows = [(name, *map(float, p)) for name, points in images.items() for p in points] + [("two", None, 1.0, 1.0), ("none", None, None, None)]
    pixels = spark.createDataFrame(rows, "image_id string, l double, a double, b double")
    found = clusters.palettes(pixels, ("l", "a", "b"), tried).collect()
    # one shift of all pictures ends the rounds, so the plain version runs on its own pictures only where they rest
    assert {r["image_id"] for r in found} == set(images)
    for name, points in images.items():
        own = sorted((r for r in found if r["image_id"] == name), key=lambda r: r["ord"])
        k, s, centers = plain_palette(points.astype(float), tried)
        assert own[0]["k"] == k and len(own) == k
        assert own[0]["silhouette"] == pytest.approx(s, abs=0.02)
        assert np.allclose([r["v"] for r in own], centers, atol=1.5)
    assert clusters.palettes(pixels.limit(0), ("l", "a", "b")).count() == 0


def test_rounds_read_blocks_of_colors_and_sort_none(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", [float(v) for v in rng.integers(0, 40, 3)], int(rng.integers(1, 9))) for i in range(3) for _ in range((400, 7, 1)[i])]
    colors = spark.createDataFrame(rows, "image_id string, v array<double>, n long").groupBy("image_id", "v").agg(F.sum("n").alias("n"))
    start = clusters.started(clusters.seeds(colors))
    found = clusters.moved(colors, start)
    blocks = clusters.packed(colors, 16).collect()
    assert sorted((b["image_id"], list(v), n) for b in blocks for *v, n in zip(b["v0"], b["v1"], b["v2"], b["n"])) == sorted((r["image_id"], r["v"], r["n"]) for r in colors.collect())
    assert max(len(b["n"]) for b in blocks) <= 64 and len(blocks) > 10
    own = {}
    for r in colors.collect():
        own.setdefault(r["image_id"], []).append((np.array(r["v"]), r["n"]))
    centers = {(r["image_id"], r["k"]): r["centers"] for r in start.collect()}
    split = {(r["image_id"], r["k"]): r for r in clusters._moved(clusters.packed(colors, 16), start).collect()}
    assert {(r["image_id"], r["k"]): r["centers"] for r in found.collect()} == {k: r["centers"] for k, r in split.items()} and set(split) == set(centers)
    for (image, k), old in centers.items():
        near = [int(np.argmin([((v - c) ** 2).sum() for c in np.array(old)])) for v, _ in own[image]]
        for i, c in enumerate(old):
            mine = [(v, n) for (v, n), j in zip(own[image], near) if j == i]
            mean = sum(v * n for v, n in mine) / sum(n for _, n in mine) if mine else c
            assert split[image, k]["centers"][i] == pytest.approx(mean, abs=1e-8)


# --- profiles and grids --------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [7, 64])
def test_tiles_make_the_profiles_of_whole_pictures(spark, tile):
    rng = np.random.default_rng(1)
    arrays = {"a": rng.integers(0, 256, (33, 50)), "b": rng.integers(0, 256, (7, 7)), "c": rng.integers(0, 256, (2, 90)), "d": rng.integers(0, 256, (64, 15))}
    found = lattice.edge_profiles(picture(spark, arrays), tile).collect()
    for name, a in arrays.items():
        for axis, expected in zip("xy", profiles_of(a.astype(float)), strict=True):
            own = sorted((r["pos"], r["value"], r["extent"], r["across"]) for r in found if r["image_id"] == name and r["axis"] == axis)
            assert [v for _, v, *_ in own] == expected.tolist()
            assert {(e, x) for *_, e, x in own} == {a.shape[::-1] if axis == "x" else a.shape}


def test_guards_of_grids(spark):
    cycle = np.array([60, 200, 175, 35])
    harmonic = cycle[np.repeat(np.arange(20), 20) % 4][None] + np.where(np.repeat(np.arange(20), 20) % 2 == 0, 30, -30)[:, None] * 1.0
    arrays = {
        "even": checker([20] * 15, [20] * 12), "turns": checker([14, 16] * 12, [15] * 20), "flat": np.full((120, 150), 200), "tiny": checker([7, 8], [7, 8]),
        "harmonic": np.clip(harmonic, 0, 255), "skewed": checker([10] * 30, [17] * 20),
    }
    found = {r["image_id"]: r for r in lattice.grids(lattice.edge_profiles(picture(spark, arrays))).collect()}
    even = found["even"]
    assert even["diagnosis"] is None and even["confidence"] > 0.85  # eleven of twelve lines meet at a lag
    # the two columns beside an edge respond alike, and the first of them is taken
    assert [round(b / 20) for b in even["boundaries_x"]] == list(range(16)) and [round(b / 20) for b in even["boundaries_y"]] == list(range(13))
    assert all(abs(b - 20 * i) <= 1 for i, b in enumerate(even["boundaries_x"]))
    assert abs(found["turns"]["pitch_x"] / 15 - 1) <= 0.02 and abs(found["turns"]["pitch_y"] / 15 - 1) <= 0.02
    assert (found["flat"]["diagnosis"], found["flat"]["confidence"], found["flat"]["pitch_x"], found["flat"]["boundaries_x"]) == ("no_periodicity", 0.0, None, None)
    assert found["tiny"]["diagnosis"] == "profile_too_short"
    assert found["harmonic"]["pitch_x"] == pytest.approx(20, rel=0.02) and found["harmonic"]["pitch_y"] == pytest.approx(20, rel=0.02)
    assert found["skewed"]["diagnosis"] == "anisotropic_pitch" and found["skewed"]["confidence"] <= 0.5


def test_a_warp_loosens_and_a_period_helps(spark):
    arrays = {"slant": checker([20] * 15, [23] * 12)}
    profiles = lattice.edge_profiles(picture(spark, arrays))
    told = "image_id string, warp double, period_x double, period_y double, lattice_x double, lattice_y double, lattice_snr double"
    hints = spark.createDataFrame([("slant", 0.05, None, None, None, None, None)], told)
    assert lattice.grids(profiles).first()["diagnosis"] == "anisotropic_pitch"
    assert lattice.grids(profiles, hints).first()["diagnosis"] is None
    v = np.zeros(400)
    v[::25] = 10.0
    assert lattice.told_by_period(v, (12.5, 0.3), 100.0, 400)[0] == 25.0
    assert lattice.told_by_period(v, (12.5, 0.3), 0.0, 400) == (12.5, 0.3)
    assert lattice.told_by_period(v, (25.0, 0.9), 100.0, 400) == (25.0, 0.9)


def test_pitch_equals_that_of_long_tables(spark):
    from gridloom.operators import profiles

    rng = np.random.default_rng(2)
    series = {f"s{k}": np.where(np.arange(300) % (7 + k) == 2, 10.0, 0.0) + rng.random(300) for k in range(6)}
    rows = [(name, i, float(x)) for name, v in series.items() for i, x in enumerate(v)]
    found = {r["series_id"]: r for r in profiles.pitch(spark.createDataFrame(rows, "series_id string, pos long, value double"), 75).collect()}
    for name, v in series.items():
        pitch, prominence = lattice.pitch_of(v, 75)
        assert (pitch, prominence) == (pytest.approx(found[name]["pitch"]), pytest.approx(found[name]["prominence"]))


def test_boundaries_stay_in_order():
    rng = np.random.default_rng(9)
    for _ in range(50):
        v = rng.random(rng.integers(30, 300)) ** 4
        pitch = float(rng.uniform(5, 12))
        b = lattice.boundaries_of(v, pitch, float(rng.uniform(0, pitch)))
        assert b[0] == 0.0 and b[-1] == len(v) and all(x < y for x, y in itertools.pairwise(b))


# --- whole pictures --------------------------------------------------------------------------------------------


def test_blur_and_correlations_equal_plain_ones():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(21, 34))
    for sigma in (0.8, 2.0, 6.0):
        reach = (round(8 * sigma + 1) | 1) // 2
        w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
        w /= w.sum()
        wide = np.pad(a, reach, mode="reflect")
        plain = sum(w[i] * w[j] * wide[i : i + 21, j : j + 34] for i in range(len(w)) for j in range(len(w)))
        assert np.allclose(lattice.blurred(a, sigma), plain)
    whole = np.fft.ifft2(np.abs(np.fft.fft2(a)) ** 2).real
    x, y = lattice.line_correlations(a)
    assert np.allclose(x, whole[0] / whole[0, 0]) and np.allclose(y, whole[:, 0] / whole[0, 0])
    padded = np.fft.ifft2(np.abs(np.fft.fft2(a, (32, 64))) ** 2).real
    x, y = lattice.line_correlations(a, padded=True)
    assert np.allclose(x, padded[0, :34] / padded[0, 0]) and np.allclose(y, padded[:21, 0] / padded[0, 0])


def test_periods_lattices_and_coherence(spark):
    rng = np.random.default_rng(5)
    block = rng.integers(40, 220, (24, 32)).astype(float)
    arrays = {"blocks": np.tile(block, (9, 8)), "flat": np.full((100, 100), 90.0), "small": np.tile(block, (1, 1)), "squares": checker([24] * 10, [24] * 10)}
    gray = picture(spark, arrays)
    found = {r["image_id"]: r for r in lattice.periodicities(gray).collect()}
    assert (found["blocks"]["period_x"], found["blocks"]["period_y"]) == (32, 24) and found["blocks"]["score_x"] > 0.6
    assert all(tuple(found[n])[1:] == (0, 0, 0.0, 0.0) for n in ("flat", "small"))
    lab = gray.select("image_id", "y", "x", F.lit(128.0).alias("a"), F.col("gray").alias("l"), F.lit(128.0).alias("b"))
    snr = {r["image_id"]: r for r in lattice.block_lattices(lab).collect()}
    assert (snr["blocks"]["period_x"], snr["blocks"]["period_y"], snr["blocks"]["channel"]) == (32, 24, 0) and snr["blocks"]["snr"] > 3
    assert snr["flat"]["channel"] == -1 and snr["flat"]["snr"] == 0.0
    edges = spark.createDataFrame([("squares", [float(24 * i) for i in range(11)], [float(24 * i) for i in range(11)]), ("blocks", [0.0, 256.0], [0.0, 216.0])], "image_id string, xs array<double>, ys array<double>")
    told = {r["image_id"]: r["coherence"] for r in lattice.coherences(gray, edges).collect()}
    assert told["squares"] == pytest.approx(plain_coherence(arrays["squares"], edges.first()["xs"], edges.first()["ys"])) and told["squares"] < 0.5
    assert told["blocks"] == 0.0 and told["flat"] == 0.0 and len(told) == 4


def plain_coherence(gray, xs, ys):
    def parts(xs, ys):
        pitch = [(b[-1] - b[0]) / (len(b) - 1) for b in (xs, ys)]
        soft = lattice.blurred(gray, max(0.8, min(pitch) / 8))
        m = np.pad(soft, 1, mode="reflect")
        down, along = m[:-2] + 2 * m[1:-1] + m[2:], m[:, :-2] + 2 * m[:, 1:-1] + m[:, 2:]
        energy = np.abs(down[:, 2:] - down[:, :-2]) + np.abs(along[2:] - along[:-2])
        near = np.zeros(gray.shape, bool)
        for x in xs:
            near[:, max(0, int(np.floor(x - 0.12 * pitch[0]))) : int(np.ceil(x + 0.12 * pitch[0])) + 1] = True
        for y in ys:
            near[max(0, int(np.floor(y - 0.12 * pitch[1]))) : int(np.ceil(y + 0.12 * pitch[1])) + 1] = True
        return energy[~near].mean() / energy[near].mean(), energy[near].mean()

    (one, beside), (two, finer) = parts(xs, ys), parts(*[sorted([*b, *((p + q) / 2 for p, q in zip(b, b[1:]))]) for b in (xs, ys)])
    return max(one, two) if finer >= 0.25 * beside else one


def test_pictures_too_large_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_PIXELS", 100)
    with pytest.raises(ValueError, match="pixels"):
        lattice._dense(picture(spark, {"a": np.zeros((11, 11))}).toPandas(), ["gray"])


# --- drawing -----------------------------------------------------------------------------------------------------


def test_raster_paints_cells_over_borders(spark):
    m = grids.authored(spark, ("tiny",))
    found = {(r["y"], r["x"]): (r["red"], r["green"], r["blue"]) for r in pictures.raster(m, 8).collect()}
    red, white = (0xC0, 0x30, 0x30), (255, 255, 255)
    assert len(found) == 48 * 48
    for (y, x), color in found.items():
        inner = 8 <= y < 40 and 8 <= x < 40
        expected = (red if ((y - 8) // 16 + (x - 8) // 16) % 2 == 0 else white) if inner else white
        assert color == expected
    again = [pictures.textured(pictures.raster(m, 8), pictures.cell_places(m, 8), F.lit(5), 42).orderBy("y", "x").collect() for _ in range(2)]
    assert again[0] == again[1] and again[0] != pictures.textured(pictures.raster(m, 8), pictures.cell_places(m, 8), F.lit(6), 42).orderBy("y", "x").collect()
    noise = pictures.textured(pictures.raster(m, 8), None, F.lit(5), 42).where("y < 8").toPandas()["red"].to_numpy()
    assert noise.max() == 255 and 1.0 < (255 - noise[noise < 255]).std() < 4


# --- documents and votes --------------------------------------------------------------------------------------------


def test_documents_of_any_folder_are_read(spark, tmp_path):
    made = documents.to_json(grids.authored(spark, ("tiny", "small"))).collect()
    for r in made:
        (tmp_path / "deep" / r["model_id"]).mkdir(parents=True)
        (tmp_path / "deep" / r["model_id"] / f"{r['model_id']}.json").write_text(r["json"])
    found = documents.parse(documents.load(spark, str(tmp_path)))
    assert {(r["model_id"], r["problem"]) for r in found.collect()} == {("tiny", None), ("small", None)}
    assert documents.cells_of(found).count() == 4 + 6


def test_grids_without_periods_keep_their_cells(spark):
    cells = spark.createDataFrame([("a", 0, 0, "x", 0.1), ("b", 0, 0, "y", 0.2), ("c", 0, 0, "z", 0.3)], "model_id string, r int, c int, fabric_id string, confidence double")
    periods = spark.createDataFrame([("a", 1, 1), ("c", None, None)], "model_id string, period_rows int, period_cols int")
    assert {(r["model_id"], r["voted"]) for r in analytics.voted(cells, periods).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}


# --- quads and warps -------------------------------------------------------------------------------------------------


def colored(spark, arrays):
    rows = [(i, y, x, int(v), int(v), int(v)) for i, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id string, y long, x long, red int, green int, blue int")


@pytest.mark.parametrize("tile", [4, 100])
def test_parts_equal_a_plain_flood(spark, tile):
    rng = np.random.default_rng(7)
    masks = {f"m{k}": rng.random((23, 31)) < d for k, d in enumerate((0.2, 0.35, 0.5, 0.9))}
    masks["snake"] = np.array([[1 if r % 2 == 0 or c == (30 if r % 4 == 1 else 0) else 0 for c in range(31)] for r in range(23)], bool)
    rows = [(i, y, x) for i, m in masks.items() for y, x in zip(*np.nonzero(m))]
    pixels = spark.createDataFrame([(i, int(y), int(x)) for i, y, x in rows] + [("m0", int(rows[0][1]), int(rows[0][2]))], "image_id string, y long, x long")
    from gridloom.operators import quads

    found = {}
    for r in quads.parts(pixels, tile).collect():
        for x in range(r["x0"], r["x1"] + 1):
            assert (r["image_id"], r["y"], x) not in found
            found[r["image_id"], r["y"], x] = r["part"]
    for name, m in masks.items():
        left, groups = set(zip(*(a.tolist() for a in np.nonzero(m)))), []
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                y, x = todo.pop()
                group.add((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            groups.append(frozenset(group))
        own = {}
        for (i, y, x), p in found.items():
            if i == name:
                own.setdefault(p, set()).add((y, x))
        assert {frozenset(g) for g in own.values()} == set(groups)


def test_photos_come_upright(spark):
    from gridloom.operators import quads

    inner = checker([12] * 8, [12] * 6, 220, 120)
    flat = np.full((100, 130), 0x40)
    flat[10 : 10 + 72, 15 : 15 + 96] = inner
    flat[95:97, 2:6] = 255  # a crumb beside the quilt
    photo = colored(spark, {"flat": flat})
    quad = quads.quads(quads.largest(quads.parts(quads.foreground(photo), tile=32)))
    assert [(p["x"], p["y"]) for p in quad.first()["corners"]] == [(15, 10), (110, 10), (110, 81), (15, 81)] and quad.first()["residual"] == 0
    cut, told = quads.upright(photo, quad)
    assert (told.first()["identity"], told.first()["confidence"]) == (True, 1.0)
    assert {(r["y"], r["x"]): r["red"] for r in cut.collect()} == {(y, x): int(v) for (y, x), v in np.ndenumerate(inner)}


def test_a_slanted_photo_gives_its_grid_back(spark):
    from gridloom.operators import quads

    inner = colored(spark, {"q": checker([16] * 9, [16] * 7, 220, 120)})
    corners = [(20.0, 10.0), (150.0, 14.0), (160.0, 120.0), (8.0, 116.0)]
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    whole = F.array(point(0.0, 0.0), point(143.0, 0.0), point(143.0, 111.0), point(0.0, 111.0))
    maps = spark.range(1).select(F.lit("q").alias("image_id"), quads.projection(F.array(*[point(*c) for c in corners]), whole).alias("h"), F.lit(170).alias("wide"), F.lit(130).alias("high"))
    photo = quads.warped(inner, maps)
    assert photo.count() == 170 * 130
    quad = quads.quads(quads.largest(quads.parts(quads.foreground(photo))))
    assert all(abs(p["x"] - x) <= 1.5 and abs(p["y"] - y) <= 1.5 for p, (x, y) in zip(quad.first()["corners"], corners))
    flat, told = quads.upright(photo, quad)
    row = told.first()
    assert not row["identity"] and 0 < row["warp"] < 0.1 and 0.8 < row["confidence"] < 1
    gray = flat.select("image_id", "y", "x", F.col("red").alias("gray"))
    grid = lattice.grids(lattice.edge_profiles(gray), spark.createDataFrame([("q", row["warp"], None, None, None, None, None)], "image_id string, warp double, period_x double, period_y double, lattice_x double, lattice_y double, lattice_snr double")).first()
    assert len(grid["boundaries_x"]) == 10 and len(grid["boundaries_y"]) == 8
    assert quads.warped(inner, maps, fill=None).count() < 170 * 130


def _above_pixels(df) -> str:
    """The part of the plan that reads pixels: what lies above the step that makes them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("explode(sequence(x0")]


def test_cloth_is_drawn_at_once_without_a_shuffle_of_pixels(spark):
    m = grids.authored(spark)
    key = F.length("model_id").cast("long")
    slow = pictures.textured(pictures.raster(m, 4), pictures.cell_places(m, 4), key, 42)
    sized = pictures.cloth(m, 4, key, 42, pictures.sides(m, 4))
    fast = pictures.cloth(m, 4, key, 42)
    assert fast.count() == slow.count() > 0
    assert fast.exceptAll(slow).isEmpty() and sized.drop("w", "h").exceptAll(slow).isEmpty()
    wrong = sized.groupBy("model_id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("w").alias("w"), F.max("h").alias("h")).where("x + 1 <> w or y + 1 <> h")
    assert wrong.isEmpty()
    seen = _above_pixels(fast.groupBy("model_id", "y").agg(F.sum("red")))
    assert "Exchange" not in seen and "Join" not in seen


def test_lit_and_folded_pictures_take_what_pixels_bring(spark):
    m = grids.authored(spark, ("tiny", "mini"))
    key = F.length("model_id").cast("long")
    told = pictures.cloth(m, 4, key, 42, pictures.sides(m, 4).withColumns(pictures.lighting(key, 42)))
    bare = told.select("model_id", "y", "x", *pictures.RGB)
    kept = pictures.lit_from(pictures.folded(told, key, 42), key, 42)
    plain = pictures.lit_from(pictures.folded(bare, key, 42), key, 42)
    assert kept.select(*plain.columns).exceptAll(plain).isEmpty() and kept.count() == plain.count() > 0
    assert "Exchange" not in _above_pixels(kept) and "Join" not in _above_pixels(kept)


def test_pixels_with_sides_have_the_same_profiles_and_one_draft(spark):
    m = grids.authored(spark)
    pixels = pictures.cloth(m, 4, F.length("model_id").cast("long"), 42, pictures.sides(m, 4)).withColumnRenamed("model_id", "image_id").withColumn("gray", F.col("red"))
    mine, counted = (lattice.edge_profiles(p, tile=16) for p in (pixels, pixels.drop("w", "h")))
    assert mine.exceptAll(counted).isEmpty() and mine.count() == counted.count() > 0
    assert mine._jdf.queryExecution().executedPlan().toString().count("explode(sequence(x0") == 1


def test_boxes_of_cells_hold_their_pixels(spark):
    m = grids.authored(spark)
    old = pictures.cell_places(m, 4).groupBy("model_id", "r", "c").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    new = pictures.cell_boxes(m, 4).drop("fabric_id")
    assert new.exceptAll(old.select(*new.columns)).isEmpty() and new.count() == old.count() > 0


@pytest.mark.parametrize("fill", [(64, 64, 64), None])
def test_warps_send_tiles_and_agree_with_a_plain_warp(spark, fill):
    from gridloom.operators import quads

    rng = np.random.default_rng(5)
    old = rng.integers(0, 256, (37, 45))
    old[20:30, 18:22] = -1  # pixels that are missing
    rows = [("p", y, x, int(v), int(255 - v), 7) for (y, x), v in np.ndenumerate(old) if v >= 0]
    pixels = spark.createDataFrame(rows, "image_id string, y long, x long, red int, green int, blue int")
    h = [0.8, 0.15, -4.0, -0.1, 0.9, 3.0, 0.001, 0.002]
    maps = spark.createDataFrame([("p", h, 50, 41), ("none", h, 20, 20)], "image_id string, h array<double>, wide long, high long")
    new = quads.warped(pixels, maps, fill, tile=16)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "inline(" not in plan and "BroadcastExchange" not in plan  # no pixel becomes four rows, and no tile goes through the driver
    want = {}
    for y in range(41):
        for x in range(50):
            below = h[6] * x + h[7] * y + 1
            sx, sy = round((h[0] * x + h[1] * y + h[2]) / below, 6), round((h[3] * x + h[4] * y + h[5]) / below, 6)
            fx, fy = math.floor(sx), math.floor(sy)
            total, share = 0.0, 0.0
            for oy, ox, w in [(fy + j, fx + i, ((sx - fx) if i else 1 - sx + fx) * ((sy - fy) if j else 1 - sy + fy)) for j in (0, 1) for i in (0, 1)]:
                there = 0 <= oy < 37 and 0 <= ox < 45 and old[oy, ox] >= 0
                total, share = total + w * (old[oy, ox] if there else 64 if fill else 0), share + (w if there else 0)
            if fill or share > 0:
                want["p", y, x] = math.floor(round(total / (1 if fill else share), 6) + 0.5)
    if fill:
        want |= {("none", y, x): 64 for y in range(20) for x in range(20)}
    found = {(r["image_id"], r["y"], r["x"]): r["red"] for r in new.collect()}
    assert found == want


def test_runs_are_made_before_they_are_sent(spark):
    import pandas as pd

    from gridloom.operators import quads

    spots = pd.DataFrame({"image_id": ["a"] * 41, "y": [3] * 41, "x": [*range(40), 39]})
    sent = pd.concat(quads._fused([spots], 32))
    assert sent[["tx", "x0", "x1"]].values.tolist() == [[0, 0, 31], [1, 32, 39], [1, 39, 39]]
    runs = quads.parts(spark.createDataFrame(spots), tile=32).collect()
    assert sorted((r["x0"], r["x1"]) for r in runs) == [(0, 31), (32, 39)] and len({r["part"] for r in runs}) == 1


def test_tasks_of_pixels_follow_the_pictures(spark, monkeypatch):
    m = grids.from_suppliers(spark.range(12).selectExpr("id as s_suppkey", "int(id % 5) as s_nationkey"))
    whole = pictures.raster(m, 6)
    n, rows = whole.count(), {tuple(r) for r in whole.groupBy("model_id", "y").agg(F.sum("red"), F.count("*")).collect()}
    monkeypatch.setattr(pictures, "TASK_PIXELS", n // 20)
    more = pictures.raster(m, 6)
    assert more.rdd.getNumPartitions() >= 20
    assert {tuple(r) for r in more.groupBy("model_id", "y").agg(F.sum("red"), F.count("*")).collect()} == rows


def plain_overlap(one, two):
    """Intersection over union of two convex quads in whole fractions."""
    def area(p):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))

    one, two = (q[::-1] if area(q) < 0 else q for q in (one, two))
    if not area(one) or not area(two):
        return 0.0
    cut = [tuple(map(Fraction, p)) for p in one]
    for a, b in zip(two, two[1:] + two[:1]):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in cut]
        new = []
        for p, q, t, s in zip(cut, cut[-1:] + cut[:-1], side, side[-1:] + side[:-1]):
            if (s >= 0) != (t >= 0):
                new.append(tuple(q[k] + Fraction(s) / (s - t) * (p[k] - q[k]) for k in (0, 1)))
            new += [p] * (t >= 0)
        cut = new
    return float(area(cut) / (area(one) + area(two) - area(cut)))


def test_overlaps_of_quads_equal_plain_ones_and_are_cut_many_at_a_time(spark):
    from gridloom.operators import pixels as pixel_ops

    rng = random.Random(5)

    def quad():
        x, y, w, h = (rng.randrange(1, 9) for _ in range(4))
        slant = rng.randrange(-3, 4)
        q = [(x, y), (x + w, y + slant), (x + w + (slant < 0), y + h + slant), (x, y + h)]
        turn = rng.randrange(4)
        q = q[turn:] + q[:turn]
        return q[::-1] if rng.random() < 0.5 else q

    box = [(0, 0), (4, 0), (4, 4), (0, 4)]
    pairs = [(quad(), quad()) for _ in range(300)] + [(box, box), (box, box[::-1]), (box, [(4, 0), (6, 0), (6, 4), (4, 4)]), (box, [(1, 1), (2, 1), (2, 2), (1, 2)]), (box, [(9, 9)] * 4), ([(2, 2)] * 4, box)]
    nan, none = float("nan"), [(0, 0), (4, 0), (None, 4), (0, 4)]
    odd = {(1000, None): (none, box), (1001, None): (None, box), (1002, 0.0): (none, [(1, 1)] * 4), (1003, nan): ([(nan, 0), *box[1:]], box)}
    rows = [(i, *p) for i, p in enumerate(pairs)] + [(i, *p) for (i, _), p in odd.items()]
    real = [(i, *[None if q is None else [tuple(None if v is None else float(v) for v in p) for p in q] for q in (a, b)]) for i, a, b in rows]
    table = spark.createDataFrame(real, "id int, one array<struct<x: double, y: double>>, two array<struct<x: double, y: double>>")
    overlaps = table.select("id", pixel_ops.quad_overlap(F.col("one"), F.col("two")).alias("overlap"))
    found = {r["id"]: r["overlap"] for r in overlaps.collect()}
    assert all(found[i] == pytest.approx(plain_overlap(*p), abs=1e-12) for i, p in enumerate(pairs))
    assert {0.0, 1.0, 1 / 16} <= {found[i] for i in range(300, len(pairs))}
    assert all(math.isnan(found[i]) if v is not None and math.isnan(v) else found[i] == v for i, v in odd)
    # lambdas are interpreted a corner at a time, some 100 microseconds a pair
    assert "lambdafunction" not in overlaps._jdf.queryExecution().executedPlan().toString()
