"""Hand-derived cases of scalar rules."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tesselon.functions import classify, fixed, geo, names
from tesselon.operators import raster, render, spatial, tiles


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


@pytest.mark.parametrize(
    ("text", "want"),
    [("3.5", 3.5), ("3.5m", 3.5), (" 3.5 M ", 3.5), ("12 ft", 12 * 0.3048), ("wide", None), ("5 km", None), ("12'", None), ("1.0d", None), ("", None), (None, None), ("5mm", None)],
)
def test_width(spark, text, want):
    (got,) = one(spark, "t string", (text,), classify.width_m(F.col("t")))
    assert got is None if want is None else got == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize(
    ("kind", "lanes", "width", "want"),
    [("motorway", None, None, (2, 12.0)), ("residential", "2", None, (3, 6.4)), ("primary", "1", None, (2, 8.0)), ("footway", None, "0.4", (4, 1.0)), ("trunk", "two", "wide", (2, 10.0)), ("service", "+3", None, (3, 9.6))],
)
def test_highway(spark, kind, lanes, width, want):
    cls, wide = classify.highway(F.col("k"), classify.lanes(F.col("l")), classify.width_m(F.col("w")))
    got = one(spark, "k string, l string, w string", (kind, lanes, width), cls, wide)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-6)


@pytest.mark.parametrize(
    ("tags", "want"),
    [({"building": "no"}, (1, True)), ({"building": "", "highway": "primary"}, (2, False)), ({"landuse": "reservoir"}, (6, True)), ({"highway": ""}, (4, False)), ({"natural": "wood", "leisure": "pitch"}, (6, True)), ({"railway": "rail"}, (8, False)), ({"amenity": "bench"}, None), ({}, None)],
)
def test_way_class(spark, tags, want):
    (got,) = one(spark, "t map<string,string>", (tags,), classify.way_class(lambda k: F.try_element_at("t", F.lit(k))))
    assert (got and (got["class"], got["is_area"])) == want


def test_names(spark):
    got = one(spark, "p string", ("a/b.c/tile.v1.obj",), names.stem(F.col("p")), names.extension(F.col("p")), F.octet_length(names.tile_key(F.lit("x" * 40))), names.key_text(names.tile_key(F.lit("abc"))))
    assert got == ("tile.v1", "obj", 32, "abc")
    assert one(spark, "p string", (".hidden",), names.stem(F.col("p"))) == (".hidden",)


def test_fixed_point(spark):
    high, low = fixed.split_high_low(F.col("v"))
    got = one(spark, "v double", (6378137.123456,), fixed.quantise(F.col("v"), 1000), fixed.quantise(F.lit(-0.0005), 1000), fixed.quantise(F.lit(1e300), 1000), high.cast("double") + low.cast("double"), fixed.q7(F.lit(13.4)))
    assert got[0] == 6378137123 and got[1] == -1 and got[2] > 9e18 and got[3] == pytest.approx(6378137.123456, abs=1e-7) and got[4] == 134000000


def test_utm(spark):
    got = one(spark, "l double", (13.40,), geo.utm_zone(F.col("l")), geo.utm_central_meridian(F.col("l")))
    assert got == (33, 15.0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-89, 89), st.floats(-179.9, 179.9), st.floats(-9000, 9000)), min_size=1, max_size=30))
def test_geodetic_round_trip(spark, points):
    d = spark.createDataFrame(points, "lat double, lon double, h double")
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.col("h"))
    lat, lon, h = geo.geodetic(F.col("x"), F.col("y"), F.col("z"))
    for r in d.withColumns({"x": x, "y": y, "z": z}).withColumns({"a": lat, "b": lon, "c": h}).collect():
        assert abs(r.a - r.lat) < 1e-7 and abs(r.b - r.lon) < 1e-7 and abs(r.c - r.h) < 1e-3


@pytest.mark.parametrize(("rows", "want"), [([(10.0, 50.0, 1.0)] * 9 + [(500.0, 0.0, 0.0)], "geodetic"), ([(6.2e6, 0.0, 0.0)], "ecef"), ([(1000.0, 2000.0, 3.0)], "local_m")])
def test_detect(spark, rows, want):
    d = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "file_id string, vid long, x double, y double, z double")
    assert tiles.detect_system(d).first().cs == want


def test_quantise_keeps_half_a_unit(spark):
    pts = [("t", 4e6 + 0.1234567 * i, 1e6 - 0.7 * i, 3e6 + i / 3) for i in range(200)]
    d = spark.createDataFrame(pts, "k string, ex double, ey double, ez double")
    a = tiles.anchors(d, "k", 1000)
    for r in tiles.offsets(d, a, "k").collect():
        for axis in "xyz":
            assert abs((r[f"a{axis}"] + r[f"d{axis}"]) / r.upm - r[f"e{axis}"]) <= 0.5 / r.upm + 1e-9
    one_point = tiles.anchors(d.limit(1), "k", 4_000_000_000).first()
    assert one_point.upm == 4_000_000_000
    wide = spark.createDataFrame([("t", 0.0, 0.0, 0.0), ("t", 8e6, 0.0, 0.0)], "k string, ex double, ey double, ez double")
    got = tiles.anchors(wide, "k", 1000).first()
    assert got.upm == math.floor(2147483647 / (4e6 * 1.05))


def test_painting_equals_a_fold(spark):
    import random

    rng = random.Random(1)
    marks = [(0, 0, rng.randrange(3), rng.randrange(10), i, rng.random() < 0.5) for i in range(300)]
    schema = "tile_id int, y int, x int, class int, way_id int, line boolean"
    d = spark.createDataFrame(marks, schema)
    got = {r.x: r["class"] for r in raster.paint(d.filter("not line").drop("line"), d.filter("line").drop("line")).collect()}
    prec = {c[0]: c[2] for c in classify.CLASSES}
    want = {}
    for m in sorted(marks, key=lambda m: (m[5], m[4])):
        if prec[m[3]] >= prec[want.get(m[2], 0)]:
            want[m[2]] = m[3]
    assert got == want


def test_runs_round_trip_and_cut(spark):
    cells = [(0, y, x, 1 if y < 3 else x % 2) for y in range(4) for x in range(8)]
    d = spark.createDataFrame(cells, "tile_id int, y int, x int, class int")
    runs = raster.run_lengths(d, 8, most=10)
    assert runs.agg(F.max("len")).first()[0] == 10
    assert {tuple(r) for r in raster.expand_runs(runs, 8).collect()} == set(cells)


def test_camera(spark):
    cam = render.Camera(52.5, 13.4, 5000.0)
    assert cam.zoomed(1).radius == pytest.approx(5000 / 1.1) and cam.zoomed(1000).radius == 10.0
    assert cam.dragged(0, 1e6).elevation == pytest.approx(math.radians(89))
    t = cam.target()
    d = spark.createDataFrame([(*t, 3), (*[2 * p - v for p, v in zip(cam.position(), t, strict=True)], 4)], "ex double, ey double, ez double, label int")
    got = render.fragments(d, cam, 100, 50).collect()
    assert len(got) == 1 and (got[0].x, got[0].y) in {(50, 25), (49, 25), (50, 24), (49, 24)} and 0.5 <= got[0].z <= 1


def test_ground_grid_has_its_range(spark):
    d = spark.createDataFrame([(0.0, 50.0, 1.0, 1.0)], "px double, py double, fx double, fy double")
    assert render.ground_grid(d, 49.0).count() == 0 and render.ground_grid(d, 2e5 + 1).count() == 0
    assert render.ground_grid(d, 100.0).first().opacity > 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "tile_id int, y int, x int, class int")
    assert raster.run_lengths(none, 8).count() == 0 and raster.expand_runs(raster.run_lengths(none, 8), 8).count() == 0
    pts = spark.createDataFrame([], "k string, ex double, ey double, ez double")
    assert tiles.anchors(pts, "k").count() == 0


def test_runs_of_painted_pixels_equal_those_of_the_grid(spark):
    rng = random.Random(3)
    cells = [(t, y, x, rng.choice([0, 1, 1, 2])) for t in range(4) for y in range(8) for x in range(8) if rng.random() < (0.0, 0.3, 0.9, 1.0)[t]]
    mask = spark.createDataFrame(cells, "tile_id int, y int, x int, class int")
    tiles_ = spark.createDataFrame([(t,) for t in range(5)], "tile_id int")
    want = sorted(map(tuple, raster.run_lengths(raster.dense(mask, tiles_, 8), 8, most=10).collect()))
    assert sorted(map(tuple, raster.painted_runs(mask, tiles_, 8, most=10).collect())) == want
    assert raster.painted_runs(mask.limit(0), tiles_.limit(0), 8).count() == 0


def test_boxes_of_any_size_are_met(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(60):
        w, h = 10 ** rng.uniform(-4, 2), 10 ** rng.uniform(-4, 1.5)
        x, y = rng.uniform(-180, 180 - w), rng.uniform(-90, 90 - h)
        boxes.append((i, x, y, x + w, y + h))
    boxes += [(99, 5.0, 5.0, 5.0, 5.0), (98, None, 0.0, 1.0, 1.0)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(400)] + [(900 + i, *b[1:3]) for i, b in enumerate(boxes) if b[1] is not None] + [(999, None, 1.0)]
    b = spark.createDataFrame(boxes, "tile_id int, lon_min double, lat_min double, lon_max double, lat_max double")
    p = spark.createDataFrame(points, "node_id int, lon double, lat double")
    want = sorted((i, t) for i, x, y in points if x is not None for t, a, c, e, g in boxes if a is not None and a <= x <= e and c <= y <= g)
    for join in (spatial.in_boxes, spatial.in_boxes_broadcast, lambda p, b: spatial.in_boxes_broadcast(p, b, 3)):
        assert sorted((r.node_id, r.tile_id) for r in join(p, b).collect()) == want
    assert spatial.in_boxes(p, b.limit(0)).count() == 0
