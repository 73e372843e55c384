import random

import numpy as np
import pytest
from rasters import bmp, mask_df, png, raster
from pyspark.sql import functions as F

from defectspark.functions.geometry import severity_level
from defectspark.operators import masks as M
from defectspark.operators import polygons as P
from defectspark.sources import images as I


def facts(spark, rasters):
    df = mask_df(spark, rasters).withColumn("defect_type", F.lit("a"))
    return {r["image_id"]: r for r in M.ground_masks(df).collect()}


def test_grounding_known_cases(spark):
    got = facts(
        spark,
        {
            "corner": raster(9, 9, (0, 1, 0, 2)),
            "centre": raster(9, 9, (3, 5, 3, 5)),
            "full": raster(10, 12, (1, 8, 1, 10)),
            "empty": raster(9, 9),
            "two": raster(12, 12, (0, 1, 0, 1), (8, 10, 8, 11)),
        },
    )
    assert got["corner"]["bounding_box"] == [0, 0, 3, 2]
    assert got["corner"]["centroid"] == [1.0, 0.5]
    assert got["corner"]["area_pct"] == pytest.approx(600 / 81)
    assert got["corner"]["region"] == "upper-left quadrant"
    assert got["centre"]["centroid"] == [4.0, 4.0] and got["centre"]["region"] == "centre"
    assert got["full"]["bounding_box"] == [1, 1, 10, 8] and got["full"]["centroid"] == [5.5, 4.5]
    assert got["full"]["area_pct"] == pytest.approx(8000 / 120)
    assert got["empty"]["defect_present"] is False and got["empty"]["bounding_box"] is None
    assert got["empty"]["centroid"] is None and got["empty"]["region"] is None
    assert got["empty"]["area_pct"] == 0.0 and got["empty"]["severity_level"] == "none"
    assert got["two"]["bounding_box"] == [0, 0, 12, 11] and got["two"]["centroid"] == [9.5, 9.0]
    assert got["two"]["area_pct"] == pytest.approx(1600 / 144)
    assert got["two"]["region"] == "lower-right quadrant"


def flood(mask):
    """Largest 8-connected part by plain flood fill; first in reading order on ties."""
    h, w = mask.shape
    seen, best = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in seen:
                stack, part = [(y, x)], []
                seen.add((y, x))
                while stack:
                    cy, cx = stack.pop()
                    part.append((cy, cx))
                    for ny in range(max(cy - 1, 0), min(cy + 2, h)):
                        for nx in range(max(cx - 1, 0), min(cx + 2, w)):
                            if mask[ny, nx] and (ny, nx) not in seen:
                                seen.add((ny, nx))
                                stack.append((ny, nx))
                if len(part) > len(best):
                    best = part
    return [float(np.mean([p[1] for p in best])), float(np.mean([p[0] for p in best]))]


def test_largest_component_against_flood_fill(spark):
    rng = np.random.default_rng(3)
    rasters = {
        str(i): (rng.random((rng.integers(1, 24), rng.integers(1, 24))) < rng.choice([0.1, 0.3, 0.5, 0.7])).astype(int)
        for i in range(120)
    }
    got = facts(spark, {k: v.tolist() for k, v in rasters.items()})
    for key, mask in rasters.items():
        if mask.any():
            assert got[key]["centroid"] == pytest.approx(flood(mask)), key
        else:
            assert got[key]["centroid"] is None


def test_severity_cutoffs_and_overrides(spark):
    rows = [(0.999, "a"), (1.0, "a"), (4.999, "a"), (5.0, "a"), (0.5, "b"), (2.0, "b"), (0.0, "a")]
    df = spark.createDataFrame(rows, "area double, kind string")
    level = severity_level(F.col("area"), F.col("kind"), (1.0, 5.0), {"b": (0.25, 2.0)})
    assert [r[0] for r in df.select(level).collect()] == [
        "minor", "moderate", "moderate", "severe", "moderate", "severe", "none",
    ]
    with pytest.raises(ValueError):
        severity_level(F.lit(1.0), F.lit("a"), (5.0, 1.0))


def test_crop_windows_and_reasons(spark):
    df = mask_df(
        spark,
        {
            "standard": raster(20, 20, (4, 6, 4, 6)),
            "resized": raster(20, 20, (2, 13, 3, 8)),
            "dropped": raster(6, 20, (1, 2, 2, 15)),
            "small": raster(6, 6, (1, 2, 1, 2)),
            "empty": raster(20, 20),
        },
    )
    got = {r["image_id"]: r["crop"] for r in M.with_crop(df, 8).collect()}
    assert tuple(got["standard"])[:5] == (1, 1, 8, 8, False)
    # Mean x is 5.5, so the wanted start -0.5 rounds to the even 0 and is inside the bounds.
    assert tuple(got["resized"])[:5] == (0, 2, 12, 12, True)
    assert got["dropped"]["drop_reason"] == "unfittable_square"
    assert got["small"]["drop_reason"] == "frame_too_small"
    assert got["empty"]["drop_reason"] == "empty_mask"
    totals = M.crop_eligibility(M.with_crop(df.withColumn("class", F.lit("c")), 8), "class").first()
    assert totals["usable_pairs"] == 2 and totals["crop_exclusion_count"] == 3


def test_transplant_moves_the_block(spark):
    df = mask_df(spark, {"a": raster(32, 32, (8, 12, 10, 16)), "b": raster(8, 8)})
    got = {r["image_id"]: r for r in M.transplant_masks(df, F.lit(64), F.lit(48), F.lit(20), F.lit(21)).collect()}
    assert [tuple(r) for r in got["a"]["runs"]] == [(y, 20, 26) for y in range(21, 26)]
    assert got["a"]["violation"] is None and got["b"]["violation"] == "empty"
    out = M.transplant_masks(df, F.lit(64), F.lit(48), F.lit(60), F.lit(0)).where("image_id = 'a'").first()
    assert out["violation"] == "out_of_bounds" and out["runs"] == []


def test_rectangles_hold_the_defect(spark):
    df = mask_df(spark, {f"i{n}": raster(64, 64, (20, 29, 10, 29)) for n in range(40)} | {"all": raster(8, 8, (0, 7, 0, 7))})
    for r in M.object_rectangles(df).collect():
        if r["image_id"] == "all":
            assert r["outcome"] == "fallback" and r["rect_w"] is None
            continue
        area = r["rect_w"] * r["rect_h"]
        assert 1.2 * 200 <= area <= 4.0 * 200
        assert r["rect_x"] <= 10 and r["rect_x"] + r["rect_w"] >= 30 and r["rect_x"] + r["rect_w"] <= 64
        assert r["rect_y"] <= 20 and r["rect_y"] + r["rect_h"] >= 30 and r["rect_y"] + r["rect_h"] <= 64


def test_merge_runs_is_a_union(spark):
    random.seed(5)
    rows, pixels = [], set()
    for _ in range(3000):
        y, x0 = random.randrange(12), random.randrange(60)
        x1 = min(59, x0 + random.randrange(6))
        rows.append(("a", y, x0, x1))
        pixels |= {(y, x) for x in range(x0, x1 + 1)}
    merged = M.merge_runs(spark.createDataFrame(rows[:90], "image_id string, y int, x0 int, x1 int")).collect()
    few = {(y, x) for _, y, x0, x1 in rows[:90] for x in range(x0, x1 + 1)}
    assert {(r["y"], x) for r in merged for x in range(r["x0"], r["x1"] + 1)} == few
    assert sum(r["x1"] - r["x0"] + 1 for r in merged) == len(few)
    for r in merged:
        assert (r["y"], r["x0"] - 1) not in few and (r["y"], r["x1"] + 1) not in few


def test_polygon_forms(spark):
    def run(kind, points, h=20, w=30):
        df = spark.createDataFrame(
            [("a", 0, kind, points, h, w)],
            "image_id string, shape_no int, shape_type string, points array<struct<x:double,y:double>>, height int, width int",
        )
        return {(r["y"], x) for r in P.shape_masks(df).collect() for x in range(r["x0"], r["x1"] + 1)}

    assert run("polygon", [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]) == {(y, x) for y in (1, 2, 3) for x in range(1, 5)}
    assert run("rectangle", [(5.9, 4.2), (2.0, 1.0)]) == {(y, x) for y in range(1, 5) for x in range(2, 6)}
    assert run("polygon", [(3.0, 5.0), (8.0, 5.0)]) == {(y, x) for y in (4, 5, 6) for x in range(3, 9)}
    assert run("circle", [(3.0, 5.0), (8.0, 5.0)]) == set()
    assert run("polygon", [(3.0, 5.0)]) == set()
    # Clipped at the frame, concave shape keeps its notch.
    notch = run("polygon", [(0.0, 0.0), (12.0, 0.0), (12.0, 10.0), (6.0, 2.0), (0.0, 10.0)], 8, 10)
    assert (7, 6) not in notch and (1, 6) in notch and max(x for _, x in notch) == 9


def test_images_to_masks(spark, tmp_path):
    png(tmp_path / "edge.png", [[127] + [0] * 5] + [[0] * 6] * 4 + [[0] * 5 + [128]])
    png(tmp_path / "ones.png", [[0, 1, 1], [0, 0, 1]])
    png(tmp_path / "rgb.png", [[(255, 255, 255), (0, 0, 0)]], colour=True)
    bmp(tmp_path / "b.bmp", [[(255, 0, 0), (200, 200, 200)]])
    (tmp_path / "bad.png").write_bytes(b"not an image")
    images = I.read_images(spark, str(tmp_path))
    probed = {r["path"].split("/")[-1]: r for r in I.probe_images(images).collect()}
    assert probed["edge.png"]["mode"] == "L" and probed["edge.png"]["width"] == 6
    assert probed["rgb.png"]["mode"] == "RGB" and probed["b.bmp"]["readable"]
    assert probed["bad.png"]["readable"] is False and probed["bad.png"]["width"] is None
    hard = {r["image_id"].split("/")[-1]: [tuple(x) for x in r["runs"]] for r in I.mask_rows(images).collect()}
    soft = {r["image_id"].split("/")[-1]: [tuple(x) for x in r["runs"]] for r in I.mask_rows(images, "adaptive").collect()}
    assert hard["edge.png"] == [(5, 5, 5)] and hard["ones.png"] == []
    assert soft["ones.png"] == [(0, 1, 2), (1, 2, 2)]
    assert hard["rgb.png"] == [(0, 0, 0)] and hard["b.bmp"] == [(0, 1, 1)]
    assert {r["path"].split("/")[-1] for r in I.colour_masks(images).collect()} == {"rgb.png", "b.bmp"}


def test_composite_keeps_pixels_outside(spark):
    clean, made = [127] * 36, list(range(36))
    df = spark.createDataFrame([("a", made, clean)], "image_id string, made array<int>, clean array<int>")
    runs = spark.createDataFrame([("a", 1, 2, 3), ("a", 4, 0, 0)], "image_id string, y int, x0 int, x1 int")
    lines = M.composite_lines(M.scanlines(df, ["image_id"], 6, 6, made="made", clean="clean"), runs, "made", "clean")
    flat = [v for r in lines.orderBy("y").collect() for v in r["pixels"]]
    assert flat == [i if i in (8, 9, 24) else 127 for i in range(36)]
    assert M.composite_violations(lines, "pixels", "clean").count() == 0
    assert M.composite_violations(lines, "made", "clean").first()["changed_outside"] == 33


def test_composite_lays_overlapping_runs_once(spark):
    lines = spark.createDataFrame([(1, 0, [1, 2, 3, 4, 5], [-1, -2, -3, -4, -5]), (1, 1, [7, 8], [-7, -8]), (2, 0, [], [])],
                                  "image_id int, y int, made array<int>, clean array<int>")
    runs = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 1), (1, 0, 2, 3), (2, 0, 0, 4)], "image_id int, y int, x0 int, x1 int")
    laid = M.composite_lines(lines, runs, "made", "clean")
    assert {(r["image_id"], r["y"]): r["pixels"] for r in laid.collect()} == {(1, 0): [1, 2, 3, 4, -5], (1, 1): [-7, -8], (2, 0): []}
    assert {r["image_id"]: r["changed_outside"] for r in M.composite_violations(laid, "made", "clean").collect()} == {1: 3}


def test_folded_union_equals_the_union_of_shapes(spark):
    """Many shapes of one image, several flushes and bands, null keys; shapes of a key may differ in frame."""
    from defectspark.operators import fill

    draw = random.Random(8)
    rows = []
    for i in range(600):
        points = [(float(draw.randrange(-5, 90)), float(draw.randrange(-5, 700))) for _ in range(draw.choice([1, 2, 3, 5]))]
        rows.append((draw.choice(["hot", "hot", "b", None]), draw.choice(["polygon", "rectangle"]), points, 640, draw.choice([64, 80])))
    df = spark.createDataFrame(rows, "image_id string, shape_type string, points array<struct<x:double,y:double>>, height int, width int")
    single = P.shape_runs(df.withColumn("shape_no", F.monotonically_increasing_id()), ["image_id", "shape_no"])
    want = {}
    for r in single.collect():
        want.setdefault(r.image_id, set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    for held in (fill._HELD_RUNS, 500):
        old, fill._HELD_RUNS = fill._HELD_RUNS, held
        try:
            bands = P.shape_bands(df).collect()
        finally:
            fill._HELD_RUNS = old
        got = {}
        for r in bands:
            flat = [(y, x) for y, x0, x1 in r.runs for x in range(x0, x1 + 1)]
            assert len(flat) == len(set(flat)) and all(y // 256 == r.band for y, _ in flat) and r.runs == sorted(r.runs)
            got.setdefault(r.image_id, set()).update(flat)
        assert got == want and len({(r.image_id, r.band) for r in bands}) == len(bands)


def test_folded_runs_travel_packed(spark):
    """A run of a small frame takes three bytes, whatever its neighbours are; wide frames come back whole too."""
    from defectspark.operators import fill

    rows = [(i // 4, "polygon", [(float(i % 64), 3.0), (60.0, float(7 * i % 64)), (9.0, 61.0)], 64, 64) for i in range(80)]
    df = spark.createDataFrame(rows, "image_id long, shape_type string, points array<struct<x:double,y:double>>, height int, width int")
    parts = fill.folded_runs(P._ringed(df, ["image_id"]), ["image_id"], "__ring").collect()
    assert parts and all(len(r.runs.data) == 3 * r.runs.n for r in parts)
    draw = np.random.default_rng(3)
    for side in (200, 70_000, 2**31 - 5):
        x0 = draw.integers(0, side - 9, 900)
        runs = fill._islands(np.repeat(np.arange(9), 100), draw.integers(0, 3000, 900), x0, x0 + draw.integers(0, 9, 900))
        band = runs[1] // fill._BAND
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(runs[0]) != 0) | (np.diff(band) != 0)]))
        group, *back = fill.unpack_runs(fill.pack_runs(np.diff(np.append(opens, band.size)), *runs[1:]), band[opens])
        assert all(np.array_equal(a, b) for a, b in zip(runs[1:], back)) and np.array_equal(runs[0], runs[0][opens][group])


def test_line_ring_computes_its_normal_once(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (8.0, 6.0)],), ([(3.0, 3.0), (3.0, 3.0)],)], "points array<struct<x:double,y:double>>")
    ring = df.select(P.shape_ring(F.lit("polygon"), F.col("points")).alias("r"))
    assert ring._jdf.queryExecution().analyzed().toString().count("round(") == 2
    got = [[(p.x, p.y) for p in r.r] for r in ring.collect()]
    assert got == [[(-1.0, 1.0), (7.0, 7.0), (9.0, 5.0), (1.0, -1.0)], [(3.0, 3.0)] * 4]
