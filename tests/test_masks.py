"""Masks of many ways: painted by portions of a tile's ways, without a row for each pixel of each way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.functions import classify
from tesselon.operators import raster, spans, spatial

GRID = 40
PRECEDENCE = {c[0]: c[2] for c in classify.CLASSES}


@pytest.fixture(scope="module")
def ways():
    rng = random.Random(5)
    rows = []
    for way in range(300):
        cls = rng.choice([1, 2, 4, 5, 6, 9])
        x, y = rng.random(), rng.random()
        verts = [(x + rng.random() * 0.4 - 0.2, y + rng.random() * 0.4 - 0.2) for _ in range(rng.choice([2, 3, 5, 9]))]
        if way % 50 == 0:
            verts = [verts[0]] * 3
        rows.append((f"t{way % 2}", way, cls, float(rng.choice([0.0, 4000.0, 9000.0])), cls not in (2, 4), verts))
    return rows


def overlay(spark, rows):
    tiles = spark.createDataFrame([(t, 0.0, 1.0, 0.0, 1.0) for t in ("t0", "t1", "t2")], "tile_id string, lon_min double, lon_max double, lat_min double, lat_max double")
    return spark.createDataFrame(rows, "tile_id string, way_id long, class int, width_m float, is_area boolean, verts array<struct<lon:double,lat:double>>"), tiles


def test_mask_is_a_fold_of_its_ways(spark, ways, monkeypatch):
    monkeypatch.setattr(spans, "ROOM", 500)
    found, tiles = overlay(spark, ways)
    px = raster.pixelised(found, tiles, GRID)
    of_way = {}
    for part in (raster.fill_areas(px.filter("is_area"), GRID), raster.buffer_lines(px.filter("not is_area"), GRID)):
        for r in part.collect():
            of_way.setdefault(r.way_id, []).append((r.y, r.x))
    assert all(len(p) == len(set(p)) for p in of_way.values())
    # the even-odd rule, pixel by pixel
    f = np.float32
    for r in px.filter("is_area").collect():
        inside = set()
        for y in range(GRID):
            for x in range(GRID):
                odd = False
                for a, b in zip(r.px, [r.px[-1], *r.px[:-1]], strict=True):
                    if (a.y > y) != (b.y > y) and f(x) < f(f(b.x - a.x) * f(f(y - a.y) / f(b.y - a.y))) + f(a.x):
                        odd = not odd
                inside |= {(y, x)} if odd else set()
        assert set(of_way.get(r.way_id, [])) == (inside if len(r.px) > 2 else set())
    want = {}
    for tile, way, cls, _, area, _ in sorted(ways, key=lambda w: (not w[4], w[1])):
        for y, x in of_way.get(way, []):
            if PRECEDENCE[cls] >= PRECEDENCE[want.get((tile, y, x), 0)]:
                want[tile, y, x] = cls
    assert {(r.tile_id, r.y, r.x): r["class"] for r in raster.build_mask(found, tiles, GRID).collect()} == want


def test_mask_lists_no_pixels_of_ways(spark, ways):
    """A row for each pixel of each way was shuffled: at 512 pixels that did not end at 60 times sf0.1."""
    mask = raster.build_mask(*overlay(spark, ways), GRID)
    assert "Generate explode(sequence" not in mask._jdf.queryExecution().optimizedPlan().toString()
    assert raster.build_mask(overlay(spark, ways)[0].limit(0), overlay(spark, ways)[1], GRID).count() == 0


def test_sums_over_spans_are_those_of_pixels(spark, ways):
    found, tiles = overlay(spark, ways)
    px = raster.pixelised(found, tiles, GRID)
    for spans_, pixels in ((raster.area_spans(px.filter("is_area"), GRID), raster.fill_areas(px.filter("is_area"), GRID)), (raster.line_spans(px.filter("not is_area"), GRID), raster.buffer_lines(px.filter("not is_area"), GRID))):
        want = pixels.groupBy("tile_id", "way_id").agg(F.count("*"), F.sum("x"), F.sum("y")).collect()
        assert sorted(map(tuple, raster.span_sums(spans_).collect())) == sorted(map(tuple, want)) != []


def test_ways_are_placed_as_one_by_one(spark):
    rng = random.Random(6)
    kept = spark.createDataFrame([(n, float(n), float(-n), t) for n in range(60) for t in rng.sample(range(4), rng.choice([1, 1, 2]))], "node_id long, lon double, lat double, tile_id int")
    refs = spark.createDataFrame([(w, s, rng.randrange(80)) for w in range(30) for s in range(rng.randrange(9))], "way_id long, seq long, node_id long")
    got = spatial.placed_ways(refs, kept)
    assert sorted(map(tuple, got.select("way_id", "verts").collect())) == sorted(map(tuple, spatial.resolve_ways(refs, kept).collect()))
    assert sorted(map(tuple, got.select("way_id", F.explode("tiles")).collect())) == sorted(map(tuple, spatial.way_tiles(refs, kept).collect()))


def test_ways_under_a_full_grid_are_not_drawn(spark, ways, monkeypatch):
    """Every way of a tile was drawn, though nearly all lie under others where there are many (F8)."""
    monkeypatch.setattr(spans, "ROOM", 500)
    drawn = []

    def counted(first, *args, own=spans.area_spans):
        drawn.append(len(first) - 1)
        return own(first, *args)

    monkeypatch.setattr(spans, "area_spans", counted)
    found, tiles = overlay(spark, [("t0", k, 1 if k % 2 else 9, 0.0, True, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 1.0)]) for k in range(400)])
    px = raster.pixelised(found, tiles, GRID).select("tile_id", "is_area", raster.paint_rank(F.lit(0)).alias("rank"), "px", "radius").orderBy("tile_id", F.desc("rank"))
    # the last row and column of pixels are no inside of any area
    (batch,) = px.toArrow().combine_chunks().to_batches()
    full = spans.painted(GRID - 1)
    (rows,) = full(iter([batch]))
    assert len(rows) == GRID - 1 and sum(drawn) < 40
    want = {r["class"] for r in raster.build_mask(found, tiles, GRID).collect()}
    assert want == {1}


def test_tiles_without_a_painted_pixel_have_a_row(spark):
    flat = [(0.5, 0.5)] * 3
    found, tiles = overlay(spark, [("t0", 1, 1, 0.0, True, flat), ("t1", 2, 1, 0.0, True, [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9)])])
    rows = raster.painted_rows(found, tiles, GRID)
    assert {r.tile_id for r in rows.select("tile_id").distinct().collect()} == {"t0", "t1"}
    assert {r.tile_id for r in raster.painted_pixels(rows).collect()} == {"t1"}


@pytest.mark.parametrize("name", ["mask_rle_encode", "mask_rle_decode", "mask_dense"])
def test_masks_keep_painted_rows_only(spark, name, monkeypatch):
    """The overlay, a row for each way and tile with all vertices, was written to the checkpoint folder (F10, F11, F12)."""
    from tesselon.plans import catalogue
    from tesselon.sources import files

    kept = []
    own = files.checkpointed
    monkeypatch.setattr(files, "checkpointed", lambda rows: kept.append(rows.columns) or own(rows))
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert kept == [["tile_id", "y", "classes"]]
    assert not [catalogue.QUERIES["paint_mask"](spark, "/root/testdata/sf0.001") for _ in range(1) if len(kept) > 1]


def test_rows_that_are_full_are_passed_over(spark):
    """A corner that stays empty kept every way of its tile from being passed over (F8)."""
    grid, n = 32, 50
    first = np.arange(0, 4 * n + 1, 4)
    x, y = np.tile([0, 31, 31, 0], n), np.tile([1, 1, 31, 31], n)
    floor = np.where(np.arange(grid) == 5, 0, 1000)
    way, row, a, b = spans.area_spans(first, x, y, grid, (np.arange(1, n + 1), floor))
    assert set(row) == {5} and len(row) == n and set(a) == {0} and set(b) == {30}
    way, row, px = spans.line_pixels(first, x, y, np.full(n, 0.5, np.float32), grid, (np.arange(1, n + 1), floor))
    assert set(row) == {5} and set(way) == set(range(n))
