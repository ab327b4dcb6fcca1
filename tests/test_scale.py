"""What keeps work bounded: ordered lookups, spans, splits, headers, and a sink that commits."""

import json
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import cloud, ordered, raster, render, spatial, tiles as tiling
from tesselon.plans import convert, load
from tesselon.sources import codec, features, obj, pbf, sinks
from tesselon.streaming import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefixes_of_one_lead(spark):
    rng = random.Random(4)
    stems = sorted({f"block_{rng.randrange(10**7)}" for _ in range(100_000)})
    files = spark.createDataFrame([(f"in/{s}.{e}", s, e) for s in stems for e in (("zip", "obj") if s.endswith("7") else ("obj",))], "path string, stem string, ext string")
    wanted = [*rng.sample(stems, 300), *(s[: rng.randrange(6, 12)] for s in rng.sample(stems, 500)), "block_", "b", "", "blocks", "zzz", "block_99999999", "a"]
    got = {r.prefix: (r.path, r.exact) for r in spatial.resolve_prefixes(spark.createDataFrame([(w,) for w in wanted], "prefix string"), files).collect()}
    import bisect

    for w in wanted:
        at = bisect.bisect_left(stems, w)
        s = stems[at] if at < len(stems) and stems[at].startswith(w) else None
        want = None if s is None else f"in/{s}.{'zip' if s.endswith('7') else 'obj'}"
        assert got[w] == (want, s == w)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_next_in_order(spark, partitions):
    keys = list(range(0, 300, 7))
    known = spark.createDataFrame([(f"{k:03d}", k) for k in keys], "k string, v long")
    wanted = spark.createDataFrame([(f"{k:03d}",) for k in [*range(310), 5, 5]] + [(None,)], "k string")
    got = {r.k: (r.next, r.v) for r in ordered.next_in_order(wanted, known, "k", "v", partitions).collect()}
    assert got == {f"{k:03d}": next(((f"{x:03d}", x) for x in keys if x >= k), (None, None)) for k in range(310)}
    assert ordered.next_in_order(wanted, known.limit(0), "k", "v", partitions).filter("next is not null").count() == 0


def lines(spark, rows):
    point = "struct<x:int,y:int>"
    return spark.createDataFrame(rows, f"tile_id long, way_id long, class int, px array<{point}>, radius float")


def test_lines_list_what_they_paint(spark):
    rng = random.Random(2)
    grid = 512
    rows = [(0, k, 2, [(rng.randrange(grid), rng.randrange(grid)) for _ in range(rng.choice([2, 3]))], float(rng.choice([0.5, 1.3, 4.0, 9.7]))) for k in range(40)]
    rows += [(0, 100, 2, [(5, 5), (5, 5)], 3.0), (0, 101, 2, [(0, 9), (511, 9)], 2.5), (0, 102, 2, [(7, 0), (7, 511)], 2.5), (0, 103, 2, [(0, 0), (511, 511)], 0.5)]
    got = {(r.way_id, r.y, r.x) for r in raster.buffer_lines(lines(spark, rows), grid).collect()}
    want, boxes = set(), 0
    xs, ys = np.meshgrid(np.arange(grid), np.arange(grid))
    f = np.float32
    for _, way, _, px, radius in rows:
        for (x0, y0), (x1, y1) in zip(px, px[1:], strict=False):
            x0, y0, x1, y1, r = f(x0), f(y0), f(x1), f(y1), f(radius)
            boxes += int((abs(x1 - x0) + 2 * r + 1) * (abs(y1 - y0) + 2 * r + 1))
            cx, cy = xs.astype(f) + f(0.5), ys.astype(f) + f(0.5)
            dx, dy = x1 - x0, y1 - y0
            t = np.clip((((cx - x0) * dx + (cy - y0) * dy) / (dx * dx + dy * dy + f(1e-12))).astype(f), f(0), f(1))
            ex, ey = cx - (x0 + t * dx), cy - (y0 + t * dy)
            want |= {(way, int(y), int(x)) for y, x in np.argwhere(ex * ex + ey * ey <= r * r)}
    assert got == want
    s = spark.createDataFrame([(float(x0), float(y0), float(x1), float(y1), r) for *_, px, r in rows for (x0, y0), (x1, y1) in zip(px, px[1:], strict=False)], "x0 float, y0 float, x1 float, y1 float, radius float")
    left, right = raster._capsule_row(grid)
    listed = s.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumns({"l": left, "r": right}).filter("l <= r").agg(F.sum(F.col("r") - F.col("l") + 1)).first()[0]
    assert listed < 1.3 * len(want) + 4000 and listed < boxes / 10


def test_labels_from_runs_equal_those_from_pixels(spark):
    rng = np.random.default_rng(3)
    grid = 32
    classes = np.where(rng.random((2, grid, grid)) < 0.5, 0, rng.integers(0, 5, (2, grid, grid)))
    classes[1, 5:9] = 3
    pixels = spark.createDataFrame([(t, y, x, int(classes[t, y, x])) for t in range(2) for y in range(grid) for x in range(grid)], "tile_id int, y int, x int, class int")
    runs = raster.runs_by_row(raster.run_lengths(pixels, grid, most=37), grid)
    points = spark.createDataFrame([(int(rng.integers(3)), 3.8e6 + float(rng.random() * 4000), 9e5 + float(rng.random() * 4000), 5.0e6 + float(rng.random() * 4000), None if rng.random() < 0.8 else 4) for _ in range(800)], "tile_id int, ex double, ey double, ez double, label int")
    box = points.sparkSession.createDataFrame([(t, 132000000, 134000000, 519000000, 521000000) for t in range(2)], "tile_id int, lon_min_q7 int, lon_max_q7 int, lat_min_q7 int, lat_max_q7 int")
    for mode in ("clamp", "zero"):
        a, b = (sorted(map(tuple, cloud.label_points(points, m, box, grid, mode=mode).collect()), key=str) for m in (pixels, runs))
        assert a == b and len(a) == 800


def mesh(n):
    return "".join(f"v {k}.5 {k % 7} 1\n" if k % 5 else f"# {'x' * (k % 90)}\n" for k in range(n))


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_meshes_are_read_by_splits(spark, tmp_path, split):
    n = 60 if split < 64 else 400
    texts = {"a": mesh(n), "b": mesh(n).rstrip("\n"), "c": "", "d": "\n\nv 1 2 3\r\n\n", "e": "v 1 2 3", "f": "# é ü 日本\nv 4 5 6\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.obj").write_bytes(text.encode())
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.obj", mesh(n))
    got = obj.read_vertices(spark, str(tmp_path), split=split).collect()
    for name, text in (texts | {"z": mesh(n)}).items():
        own = sorted((r.vid, r.x, r.y, r.z) for r in got if f"/{name}." in r.path)
        want = [tuple(map(float, x.split()[1:4])) for x in text.split("\n") if x.startswith("v ")]
        assert own == [(k, *v) for k, v in enumerate(want)]
    parts = obj.read_lines(spark, str(tmp_path), split).groupBy("path").agg(F.countDistinct("part").alias("n")).collect()
    assert {r.n for r in parts if "/z." in r.path} == {1}
    if split == 64:
        assert max(r.n for r in parts) > 20


class Counted:
    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.read_bytes += n
        return self.data[self.at : self.at + n]


def tile(n, label=True):
    rng = np.random.default_rng(n)
    mask = codec.Mask(8, 4, 1, codec.RUNS, [(0, 0), (5, 200)], codec.encode_runs(bytes([0] * 11 + [5] * 9 + [0] * 12)))
    return codec.Tile(1000, (1, 2, 3), rng.integers(-9, 9, (n, 3)).astype(np.int32), rng.integers(0, 9, n).astype(np.uint8) if label else None, b"k".ljust(32, b"\0"), (1, 2, -3, 4), mask)


def test_headers_do_not_read_points(spark, tmp_path):
    data = codec.dump(tile(50_000))
    f = Counted(data)
    got, n = codec.parse_parts(codec._FileReader(f, len(data)), points=False, masks=False)
    assert n == 50_000 and got.mask.width == 8 and got.mask.data == b"" and f.read_bytes < 200
    (tmp_path / "a.hypc").write_bytes(data)
    (tmp_path / "b.hypc").write_bytes(codec.dump(tile(3, False)))
    (tmp_path / "c.hypc").write_bytes(data[:-1])
    (tmp_path / "d.hypc").write_bytes(data[:3000])
    (tmp_path / "e.hypc").write_bytes(b"")
    heads = {os.path.basename(r.path): r for r in codec.read_headers(spark, str(tmp_path), masks=True).collect()}
    whole = {os.path.basename(r.path): r for r in codec.read_tiles(spark, str(tmp_path)).collect()}
    assert heads.keys() == whole.keys()
    for name, r in whole.items():
        h = heads[name]
        assert h.error == r.error and h.n == (None if r.points is None else len(r.points))
        assert all(h[c] == r[c] for c in ("units_per_metre", "ax", "ay", "az", "tile_key", "labelled", "extent", "mask"))
    points, tiles = load.load(spark, str(tmp_path))
    assert tiles.agg(F.sum("n")).first()[0] == 50_003 == points.count()
    assert "points" not in plan(load.summary(spark, str(tmp_path))).split("ReadSchema")[-1]
    with pytest.raises(Exception, match="ends within"):
        codec.read_headers(spark, str(tmp_path), strict=True).collect()


def rows_of(spark, tmp_path, names, bad=None):
    source = tmp_path / "source"
    source.mkdir(exist_ok=True)
    for n in names:
        (source / f"{n}.hypc").write_bytes(codec.dump(tile(5)))
    got = codec.read_tiles(spark, str(source)).withColumn("prefix", F.regexp_extract("path", "([^/]+)[.]hypc", 1))
    if bad:
        got = got.withColumn("ax", F.when(F.col("prefix") == bad, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("ax")))
    return got


def test_a_job_that_fails_leaves_no_tile(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        sinks.write_tiles(rows_of(spark, tmp_path, ["a", "b", "c"], bad="b"), str(out), overwrite=True)
    assert not list(out.rglob("*.hypc")) and not list(out.glob("_*"))
    made = sinks.write_tiles(rows_of(spark, tmp_path, ["a", "b", "c"]), str(out), overwrite=True)
    for _ in range(2):
        assert sorted(r.file for r in made.collect()) == ["a.hypc", "b.hypc", "c.hypc"]
    assert sorted(p.name for p in out.iterdir() if p.suffix == ".hypc") == ["a.hypc", "b.hypc", "c.hypc"]
    assert sinks.write_tiles(rows_of(spark, tmp_path, ["a", "b", "c", "d"]), str(out)).count() == 1


def test_prefixes_that_would_share_a_file(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(Exception, match="same file"):
        sinks.write_tiles(rows_of(spark, tmp_path, ["a.x", "a.y"]), str(out), overwrite=True)
    assert not list(out.rglob("*.hypc"))


def test_an_overlay_needs_boxes(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 1 2 3\n")
    work = convert.plan_work(spark, str(tmp_path), None, convert.Options())
    from tesselon.sources import files

    with files.Scratch(spark) as scratch, pytest.raises(Exception, match="needs a box"):
        convert.overlays(spark, work, str(tmp_path), convert.Options(), scratch)


def test_only_the_first_vertices_decide_the_system(spark):
    rows = [("a", k, 1.0 if k < tiling.SAMPLE else 9e6, 2.0, 3.0) for k in range(3 * tiling.SAMPLE)]
    got = tiling.detect_system(spark.createDataFrame(rows, "file_id string, vid long, x double, y double, z double")).collect()
    assert [(r.file_id, r.cs) for r in got] == [("a", "geodetic")]


def test_precisions_are_halved(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 10.0, 4.0, 0.0)], "t int, ex double, ey double, ez double")
    asked = 1 << 34
    got = tiling.anchors(points, "t", asked, fitted=False).first()
    assert got.upm == asked >> 6 and tiling.anchors(points, "t", asked).first().upm > got.upm
    with pytest.raises(Exception, match="beyond 32 bits"):
        tiling.anchors(points.withColumn("ex", F.col("ex") * 1e12), "t", 1000, fitted=False).collect()


def test_views_of_a_table_equal_the_camera(spark):
    cameras = [render.Camera(52.5, 13.4, 900.0), render.Camera(-10.0, 170.0, 5e5, 0.3, 1.2)]
    rows = spark.createDataFrame([(k, c.lat, c.lon, c.radius, c.azimuth, c.elevation) for k, c in enumerate(cameras)], "k int, lat double, lon double, radius double, azimuth double, elevation double")
    for r in render.looking(render.orbiting(rows), 1.5).collect():
        c = cameras[r.k]
        assert np.allclose(list(r.eye), c.position(), rtol=1e-12) and np.allclose([list(x) for x in r.view], c.matrix(1.5), rtol=1e-9, atol=1e-9)


def test_footprints_of_quads(spark):
    px = [(y, x, float(x * x), 3.0 * y + x) for y in range(6) for x in range(7) if (y, x) != (3, 3)]
    got = {(r.y, r.x): (r.fa, r.fb) for r in render.footprints(spark.createDataFrame(px, "y int, x int, a double, b double"), a="fa", b="fb").collect()}
    value = {(y, x): (a, b) for y, x, a, b in px}
    for (y, x), own in value.items():
        sides = [value.get((y, x ^ 1)), value.get((y ^ 1, x))]
        assert got[y, x] == tuple(sum(abs(s[i] - own[i]) for s in sides if s) for i in range(2))


def other_writer(path, count, seed):
    """A map as another program may write it: headers with an index field, raw and packed bodies, texts that look like headers."""
    from tests.test_sources import deltas, field, varint, zz

    rng = random.Random(seed)
    nodes, ways, order = [], [], []
    with open(path, "wb") as f:

        def block(kind, raw):
            body = field(1, raw) if rng.random() < 0.5 else field(2, len(raw)) + field(3, zlib.compress(raw))
            head = field(1, kind) + (field(2, rng.randbytes(9)) if rng.random() < 0.5 else b"") + field(3, len(body))
            f.write(struct.pack(">I", len(head)) + head + body)

        block(b"OSMHeader", field(4, b"OsmSchema-V0.6"))
        for k in range(count):
            strings = [b"", b"name", b"\x0a\x07OSMData\x18\x05", *([b"building", b"yes"] if k % 3 == 0 else [])]
            own = [(100 * k + i, rng.randrange(-1800000000, 1800000000), rng.randrange(-900000000, 900000000)) for i in range(rng.randrange(1, 9))]
            nodes += own
            group = field(2, field(1, deltas([n[0] for n in own])) + field(8, deltas([n[2] for n in own])) + field(9, deltas([n[1] for n in own])))
            raw = field(1, b"".join(field(1, x) for x in strings)) + field(2, group)
            for i in range(rng.randrange(4)):
                tags = [3] if k % 3 == 0 and i % 2 else [1]
                ways.append((1000 * k + i, {strings[t].decode() for t in tags}))
                raw += field(2, field(3, field(1, 1000 * k + i) + field(2, b"".join(map(varint, tags))) + field(3, b"".join(varint(t + 1) for t in tags)) + field(8, deltas([zz(i), k]))))
            block(b"OSMData", raw)
            order.append(k)
        block(b"Future", b"xyz")
    return nodes, ways


@pytest.mark.parametrize("split", [40, 300, 5000, 64 << 20])
def test_maps_are_read_by_ranges(spark, tmp_path, split):
    count = 25
    nodes, ways = other_writer(tmp_path / "b.pbf", count, split)
    more, others = other_writer(tmp_path / "a.pbf", 3, 1)
    (tmp_path / "c.txt").write_text("no map")
    listed = pbf.blocks(spark, str(tmp_path), split).orderBy("block").collect()
    assert [r.block for r in listed] == list(range(count + 3)) and [os.path.basename(r.path)[0] for r in listed] == ["a"] * 3 + ["b"] * count
    assert [r.offset for r in listed[3:]] == sorted(r.offset for r in listed[3:])
    got = pbf.read_nodes(spark, str(tmp_path), split=split).collect()
    assert sorted((r.node_id, round(r.lon * 1e7), round(r.lat * 1e7)) for r in got) == sorted(nodes + more)
    box = (-60.0, -30.0, 120.0, 45.5)
    inside = [n for n in nodes + more if -60e7 <= n[1] <= 120e7 and -30e7 <= n[2] <= 45.5e7]
    assert sorted(r.node_id for r in pbf.read_nodes(spark, str(tmp_path), box, split).collect()) == sorted(n[0] for n in inside)
    everything = pbf.read_ways(spark, str(tmp_path), split=split).orderBy("seq").collect()
    assert [(r.way_id, set(r.tags)) for r in everything] == others + ways
    some = pbf.read_ways(spark, str(tmp_path), ["building", "highway"], split).orderBy("seq").collect()
    assert [(r.way_id, r.seq) for r in some] == [(r.way_id, r.seq) for r in everything if "building" in r.tags]


def test_a_broken_map_fails(spark, tmp_path):
    other_writer(tmp_path / "a.pbf", 5, 1)
    data = (tmp_path / "a.pbf").read_bytes()
    (tmp_path / "a.pbf").write_bytes(data[:-40])
    with pytest.raises(Exception, match="no block at byte"):
        pbf.read_nodes(spark, str(tmp_path)).collect()


def collection(rng, n):
    def feature(k):
        ring = [[round(rng.uniform(-90, 90), 4), round(rng.uniform(-60, 60), 4)] for _ in range(rng.randrange(3, 6))]
        odd = rng.choice(["", 'quote \\" brace {', "back\\\\", "é 日本 ]}", "features"])
        body = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"note": odd, "features": [{"x": [1]}], "url": f"http://x/t_{k}.zip"}}
        return body, ring

    made = [feature(k) for k in range(n)]
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "features", "list": [{"a": {}}]}}, "others": [{"geometry": {"coordinates": []}, "properties": {"url": "no"}}]}
    whole = head | {"features": [f for f, _ in made], "after": [{"features": [{}]}], "last": "x"}
    return json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), [(f"t_{k}", *(g(v[i] for v in ring) for g, i in ((min, 0), (min, 1), (max, 0), (max, 1)))) for k, (_, ring) in enumerate(made)]


@pytest.mark.parametrize("split, n", [(23, 6), (100, 12), (1000, 40), (32 << 20, 40)])
def test_collections_are_read_by_ranges(spark, tmp_path, split, n):
    text, want = collection(random.Random(split), n)
    (tmp_path / "i.json").write_text(text)
    assert sorted(tuple(r) for r in features.read_index(spark, str(tmp_path), split).collect()) == sorted(want)


@pytest.mark.parametrize("text", ['{"features": [1, {"a": 1}]}', '{"features": [{"geometry": {"coordinates": [[[1, 2]]]}, "properties": {}}]}', '{"features": [{"geometry": {"coordinates": [[[1, 2, 3]]]}, "properties": {"url": "a"}}]}', '{"feature": []}', '{"features": [{"properties": {"url": "a"}', '{"features": [[{}]]}', '{"features": {"a": {}}}', "[]"])
def test_malformed_collections_fail(spark, tmp_path, text):
    (tmp_path / "i.json").write_text(text)
    with pytest.raises(Exception, match="malformed|MALFORMED"):
        features.read_index(spark, str(tmp_path)).collect()


def test_statistics_follow_new_files(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    for n in (3, 40, 500):
        (folder / f"t{n}.hypc").write_bytes(codec.dump(tile(n)))
        (folder / f"bad{n}.hypc").write_bytes(b"nothing")
        ingest.keep_headers(spark, str(folder), str(tmp_path / "kept"), str(tmp_path / "progress"), files_per_batch=2).awaitTermination()
        now = ingest.running_stats(spark, str(tmp_path / "kept")).first()
        assert now == load.stats(load.summary(spark, str(folder))).first() and now.points == sum(k for k in (3, 40, 500) if k <= n)
