"""Codecs and file formats: golden cases, round trips, and a whole conversion."""

import itertools
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, strategies as st

from tesselon.operators import progress
from tesselon.plans import convert, load
from tesselon.sources import codec, features, obj, pbf, sinks
from tesselon.streaming import ingest


@pytest.mark.parametrize(("data", "want"), [(b"", b""), (bytes([7, 7, 7, 0]), bytes.fromhex("030007010000")), (b"\1" * 65536, bytes.fromhex("ffff01010001"))])
def test_runs(data, want):
    assert codec.encode_runs(data) == want and codec.decode_runs(want) == data


@given(st.binary(max_size=400), st.integers(1, 400))
def test_runs_round_trip(data, times):
    assert codec.decode_runs(codec.encode_runs(data * times)) == data * times


def test_runs_errors():
    with pytest.raises(codec.TileError, match="within a run"):
        codec.decode_runs(bytes.fromhex("03000701"))
    assert codec.decode_runs(bytes.fromhex("000009")) == b""


def tiles():
    rng = np.random.default_rng(0)
    for key, labels, extent, mask in itertools.product((False, True), repeat=4):
        yield codec.Tile(
            1000, (1 << 40, -5, 7), rng.integers(-(1 << 31), 1 << 31, (9, 3)).astype(np.int32), rng.integers(0, 256, 9).astype(np.uint8) if labels else None, b"tile_7".ljust(32, b"\0") if key else None,
            (1, 2, -3, 4) if extent else None, codec.Mask(4, 2, 1, codec.RUNS, [(0, 0), (5, 200)], codec.encode_runs(b"\0\0\5\5\5\0\0\0")) if mask else None,
        )


def test_every_flag_round_trips(spark):
    for t in tiles():
        data = codec.dump(t)
        back = codec.parse(data + b"trailing")
        assert codec.dump(back) == data
        assert codec.dump(codec.from_batch(codec.to_batch("x", back), 0)) == data


@pytest.mark.parametrize(("at", "value", "what"), [(0, b"HPC1", "magic"), (4, struct.pack("<I", 1), "version"), (16, struct.pack("<I", 0), "units"), (12, struct.pack("<I", 10**6), "ends within")])
def test_parse_errors(at, value, what):
    data = bytearray(codec.dump(next(tiles())))
    data[at : at + len(value)] = value
    with pytest.raises(codec.TileError, match=what):
        codec.parse(bytes(data))
    with pytest.raises(codec.TileError, match="labels"):
        codec.dump(codec.Tile(1, (0, 0, 0), np.zeros((2, 3)), np.zeros(1, np.uint8)))


def test_old_layout():
    data = codec.OLD_MAGIC + struct.pack("<3IB", 1, 0, 5, 16) + b"\0" * 11 + struct.pack("<6f", 0, 0, 0, 65535, 1, 2) + struct.pack("<6H", 1, 0, 65535, 2, 65535, 0)
    got = codec.parse_old(data)
    assert got.tolist() == [[1.0, 0.0, 2.0], [2.0, 1.0, 0.0]]


def test_tile_files(spark, tmp_path):
    folder = tmp_path / "tiles" / "deep"
    folder.mkdir(parents=True)
    all_tiles = list(tiles())
    for i, t in enumerate(all_tiles):
        (folder / f"t{i}.hypc").write_bytes(codec.dump(t))
    (folder / "bad.hypc").write_bytes(b"nothing")
    (folder / "other.HYPC").write_bytes(b"nothing")
    got = codec.read_tiles(spark, str(tmp_path / "tiles"))
    assert got.count() == len(all_tiles) + 1 and got.filter("error is not null").count() == 1
    assert codec.points_of(got.filter("error is null")).count() == 9 * len(all_tiles)
    out = tmp_path / "out"
    named = got.filter("error is null").selectExpr("*", "regexp_extract(path, '(t[0-9]+)[.]', 1) as prefix")
    assert sinks.write_tiles(named, str(out)).count() == len(all_tiles)
    for i, t in enumerate(all_tiles):
        assert (out / f"t{i}.hypc").read_bytes() == codec.dump(t)
    assert sinks.write_tiles(named, str(out)).count() == 0
    assert not [p for p in out.iterdir() if p.name.startswith(".t") and not p.name.endswith(".crc")]
    q = ingest.ingest_points(spark, str(tmp_path / "tiles"), str(tmp_path / "table"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 9 * len(all_tiles)
    (folder / "late.hypc").write_bytes(codec.dump(all_tiles[0]))
    ingest.ingest_points(spark, str(tmp_path / "tiles"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 9 * len(all_tiles) + 9


def test_obj_lines(spark):
    lines = ["  v 1 2 3 0.5 0.5 0.5", "vn 0 0 1", "v\t1 2 3", "v inf 0 0", "v 1e3 -.5 +2.", "# v 1 2 3", "", None]
    d = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [tuple(r)[1:] for r in obj.vertices(d).collect()] == [(1.0, 2.0, 3.0), (1000.0, -0.5, 2.0)]
    for bad in ("v 1 2", "v a 2 3", "v 1.0d 2 3"):
        broken = spark.createDataFrame([(bad,)], "line string")
        with pytest.raises(Exception, match="not a vertex"):
            obj.vertices(broken).collect()
        assert obj.vertices(broken, strict=False).count() == 0


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, v):
    return varint(n << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(n << 3) + varint(v)


def zz(v):
    return v << 1 if v >= 0 else (-v << 1) - 1


def deltas(values):
    return b"".join(varint(zz(b - a)) for a, b in zip([0, *values], values, strict=False))


def write_pbf(path, nodes, ways):
    strings = [b""]

    def sid(s):
        if s.encode() not in strings:
            strings.append(s.encode())
        return strings.index(s.encode())

    half = len(nodes) // 2
    plain = b"".join(field(1, field(1, zz(i)) + field(8, zz(round(lat * 1e7))) + field(9, zz(round(lon * 1e7)))) for i, lon, lat in nodes[:half])
    rest = nodes[half:]
    dense = field(2, field(1, deltas([n[0] for n in rest])) + field(8, deltas([round(n[2] * 1e7) for n in rest])) + field(9, deltas([round(n[1] * 1e7) for n in rest])))
    made = b"".join(field(3, field(1, i) + field(2, b"".join(varint(sid(k)) for k in tags)) + field(3, b"".join(varint(sid(v)) for v in tags.values())) + field(8, deltas(refs))) for i, tags, refs in ways)
    table = field(1, b"".join(field(1, s) for s in strings))
    with open(path, "wb") as f:
        for kind, raw in ((b"OSMHeader", b""), (b"OSMData", table + field(2, plain) + field(2, dense)), (b"OSMData", table + field(2, made))):
            blob = field(2, len(raw)) + field(3, zlib.compress(raw))
            head = field(1, kind) + field(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)


def test_conversion_and_loading(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(13.40 + 0.0001 * i, 52.50 + 0.0001 * (i % 12), 30.0 + i % 3) for i in range(100)]
    text = "\n".join(["# mesh", *(f"v {a:.7f} {b:.7f} {c}" for a, b, c in rows), "f 1 2 3"])
    with zipfile.ZipFile(folder / "east.zip", "w") as z:
        z.writestr("readme.txt", "no mesh")
        z.writestr("mesh.OBJ", text)
    (folder / "west_lod2.obj").write_text("\n".join(f"v {10 * i} {5 * i} {i}" for i in range(30, 60)))
    (folder / "other.txt").write_text("v 1 2 3")

    def square(a, b):
        return {"coordinates": [[[a, b], [a + 0.01, b], [a + 0.01, b + 0.002], [a, b + 0.002], [a, b]]]}

    index = tmp_path / "index.json"
    index.write_text(json.dumps({"features": [{"geometry": square(13.40, 52.50), "properties": {"url": "http://x/east.zip"}}, {"geometry": square(13.42, 52.50), "properties": {"url": "west.obj"}}, {"geometry": square(1, 1), "properties": {"url": "gone.zip"}}]}))
    osm = tmp_path / "map.pbf"
    nodes = [(1, 13.401, 52.5005), (2, 13.404, 52.5005), (3, 13.404, 52.5015), (4, 13.401, 52.5015), (5, 13.4, 52.501), (6, 13.41, 52.501), (7, 99.0, 9.0)]
    write_pbf(osm, nodes, [(10, {"building": "yes"}, [1, 2, 3, 4, 1]), (11, {"highway": "primary"}, [5, 7, 6]), (12, {"name": "x"}, [1, 2])])
    assert sorted(tuple(r) for r in pbf.read_nodes(spark, str(osm)).selectExpr("node_id", "round(lon, 7)", "round(lat, 7)").collect()) == nodes
    assert [r.refs for r in pbf.read_ways(spark, str(osm)).orderBy("seq").collect()] == [[1, 2, 3, 4, 1], [5, 7, 6], [1, 2]]
    assert features.read_index(spark, str(index)).count() == 3

    out = tmp_path / "out"
    options = convert.Options(grid=32)
    made = convert.convert(spark, str(folder), str(out), str(index), str(osm), options)
    assert sorted(r.file for r in made.collect()) == ["east.hypc", "west.hypc"]
    assert convert.convert(spark, str(folder), str(out), str(index), str(osm), options).count() == 0
    east, west = (codec.parse((out / f"{n}.hypc").read_bytes()) for n in ("east", "west"))
    assert len(east.points) == 100 and len(west.points) == 30 and east.key.rstrip(b"\0") == b"east"
    assert east.extent == (134000000, 134100000, 525000000, 525020000)
    grid = np.frombuffer(east.mask.grid(), np.uint8).reshape(32, 32)
    assert grid.shape == (32, 32) and set(np.unique(grid)) == {0, 1, 2} and west.mask is None
    points, summary = load.load(spark, str(out))
    assert points.count() == 130 and load.stats(summary).first().points == 130
    labels = {r.label: r["count"] for r in points.groupBy("label").count().collect()}
    assert labels.get(1, 0) > 0 and labels.get(2, 0) > 0


@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=40))
def test_packed_fields(values):
    data = b"".join(varint(v) for v in values)
    assert pbf.packed(data).tolist() == values
    if values and values[-1] > 127:
        with pytest.raises(ValueError, match="ends within"):
            pbf.packed(data[:-1])


@given(st.lists(st.integers(-(1 << 40), 1 << 40), max_size=40))
def test_running_fields(values):
    assert pbf.running(deltas(values)).tolist() == values


def test_progress_of_empty_and_repeated_rows(spark):
    for values, want in (([], ("step", 0, None, None)), ([2.0, -1.0, 2.0, None], ("step", 4, -1.0, 2.0))):
        step = progress.Progress("step")
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        step.watch(rows, "x").write.format("noop").mode("overwrite").save()
        assert tuple(step.metrics(spark).first()) == want
        assert step.report()["items"] == len(values)
