"""A conversion holds no tile's points together, and deals no points out before they are written."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tesselon.plans import convert, load, samples
from tesselon.sources import codec, files, obj, pbf, sinks


def test_points_of_a_tile_are_written_in_pieces_in_order(spark, tmp_path, monkeypatch):
    """A tile's points met in one row of a group, which no executor could hold."""
    n = 3000
    places = [(k, 2 * k % 977, k % 13) for k in range(n)]
    text = "".join(f"v {6371000 + x} {y} {z}\n" for x, y, z in places)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.obj").write_text(text)
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("m.obj", text)
    longest, write, split = [], sinks._write, obj.read_lines

    def seen(coded, *rest):
        longest.append(coded.agg(F.max(F.length("content"))).first()[0])
        return write(coded, *rest)

    monkeypatch.setattr(sinks, "_write", seen)
    monkeypatch.setattr(obj, "read_lines", lambda s, paths, _: split(s, paths, 5000))  # several parts of a text
    assert convert.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), options=convert.Options(system="ecef")).count() == 2
    assert longest[0] <= codec.PIECE * 12
    for name in "ab":
        t = codec.parse((tmp_path / "out" / f"{name}.hypc").read_bytes())
        first = t.points[0].tolist()
        assert ((t.points - first) // 1000).tolist() == [[x, y, z] for x, y, z in places]


@pytest.mark.parametrize("partitions", [1, 5])
def test_pieces_follow_the_order_whatever_rows_come_first(spark, tmp_path, partitions):
    n = 2000
    order = random.Random(7).sample(range(n), n)
    rows = spark.createDataFrame([("t", False, k, -k, 3, None, k) for k in order], "prefix string, labelled boolean, dx int, dy int, dz int, label int, vid long").repartition(partitions)
    tiles = spark.createDataFrame([("t", n, 1000, 1, 2, 3, None, False)], "prefix string, n long, units_per_metre long, ax long, ay long, az long, tile_key binary, labelled boolean")
    kinds = {f.name: f.dataType for f in codec.read_headers(spark, str(tmp_path)).schema}
    tiles = tiles.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("extent", "mask")})
    sinks.write_points(tiles, rows, str(tmp_path / "out"), overwrite=True, order="vid")
    assert codec.parse((tmp_path / "out" / "t.hypc").read_bytes()).points.tolist() == [[k, -k, 3] for k in range(n)]


def test_vertices_are_numbered_without_a_sort(spark, tmp_path):
    """All vertices of an archive were sorted in one window to number them."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.obj").write_text("".join(f"v {k} 0 0\n# {k}\n" for k in range(500)))
    with files.Scratch(spark) as scratch:
        got = obj.read_vertices(spark, str(tmp_path / "in"), keep=lambda rows: scratch.stored(rows, "kept"), split=300)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
        assert sorted((r.vid, r.x) for r in got.collect()) == [(k, float(k)) for k in range(500)]


def test_meshes_of_many_batches(spark, tmp_path):
    """Texts and archives of more rows than a batch has, some files in one task."""
    n = 25_000
    rows = spark.range(2 * n).select(F.concat(F.lit("m"), F.col("id") % 2, F.when(F.col("id") % 2 == 0, ".zip").otherwise(".obj")).alias("file"), (-F.col("id")).alias("line_no"), F.when(F.col("id") != 8, F.concat(F.lit("v é "), "id")).alias("line"))
    samples.write_meshes(rows.coalesce(1), str(tmp_path))
    with zipfile.ZipFile(tmp_path / "m0.zip") as z:
        assert z.namelist() == ["readme.txt", "mesh.OBJ"] and z.testzip() is None
        even = z.read("mesh.OBJ").decode()
    texts = (even, (tmp_path / "m1.obj").read_text())
    for first, text in enumerate(texts):
        assert text == "".join("\n" if k == 8 else f"v é {k}\n" for k in range(2 * n - 2 + first, -1, -2))
    assert {p.name for p in tmp_path.iterdir()} == {"m0.zip", "m1.obj"}


def test_loaded_points_are_not_dealt_out(spark, tmp_path):
    """Points were shuffled to meet a row for each file, and again to meet the masks' runs."""
    tile = codec.Tile(1000, (3_780_000_000, 902_000_000, 5_040_000_000), [[0, 0, 0], [5000, 7000, 0]], None, None, (130000000, 140000000, 520000000, 530000000), codec.Mask(4, 2, 1, codec.RUNS, [(5, 200)], codec.encode_runs(bytes([5] * 8))))
    (tmp_path / "t.hypc").write_bytes(codec.dump(tile))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points, _ = load.load(spark, str(tmp_path))
        plan = points._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert [r.label for r in points.collect()] == [5, 5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_for_the_blocks_of_a_map():
    """A task of its own for each of thousands of small blocks took longer to start than to read."""
    assert [pbf._tasks(n) for n in (0, 1, 25, 256, 1250, 7500, 10**6)] == [1, 1, 25, 256, 256, 468, 4096]
