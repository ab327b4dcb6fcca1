"""Tile files written from points that stream by, and read by ranges of their points."""

import pytest
from pyspark.sql import functions as F

from tesselon.sources import codec, sinks

NONE = "struct<width:int,height:int,coord_space:smallint,encoding:smallint,palette:array<struct<class:smallint,precedence:smallint>>,data:binary>"
EXTENT = "struct<lon_min:int,lon_max:int,lat_min:int,lat_max:int>"


def made(spark, n=5000):
    """Three tiles, the second labelled and with an extent and a mask, the third without points."""
    rows = spark.range(n).select(F.concat(F.lit("t"), F.col("id") % 2).alias("prefix"), (F.col("id") % 2 == 1).alias("labelled"), F.col("id").cast("int").alias("dx"), (-F.col("id")).cast("int").alias("dy"), F.lit(7).alias("dz"), F.when(F.col("id") % 2 == 1, F.col("id") % 10).cast("int").alias("label"))
    tiles = spark.createDataFrame([(f"t{k}", (n + 1 - k) // 2 if k < 2 else 0, 1000 + k, k, -k, 5, b"key" if k else None, k == 1) for k in range(3)], "prefix string, n long, units_per_metre long, ax long, ay long, az long, tile_key binary, labelled boolean")
    mask = F.expr(f"cast(named_struct('width', 2, 'height', 1, 'coord_space', 1, 'encoding', 0, 'palette', array(named_struct('class', 3, 'precedence', 9)), 'data', X'0302') as {NONE})")
    second = F.col("prefix") == "t1"
    return tiles.withColumns({"extent": F.when(second, F.expr(f"cast(named_struct('lon_min', 1, 'lon_max', 2, 'lat_min', 3, 'lat_max', 4) as {EXTENT})")), "mask": F.when(second, mask)}), rows


def test_points_stream_into_files_and_out_of_them(spark, tmp_path):
    tiles, rows = made(spark)
    listed = sinks.write_points(tiles, rows, str(tmp_path), overwrite=True)
    assert sorted(tuple(r) for r in listed.select("prefix", "bytes").collect()) == [("t0", 44 + 2500 * 12), ("t1", 76 + 2500 * 13 + 20 + 20), ("t2", 76)]
    whole = codec.read_tiles(spark, str(tmp_path), strict=True)
    name = F.regexp_extract("path", "([^/]+)[.]hypc", 1).alias("prefix")
    want = sorted(map(tuple, rows.select("prefix", "dx", "dy", "dz", F.coalesce("label", F.lit(-1))).collect()))
    assert sorted(map(tuple, whole.select(name, F.inline("points")).select("prefix", "dx", "dy", "dz", F.coalesce("label", F.lit(-1))).collect())) == want
    head = ["units_per_metre", "ax", "ay", "az", "labelled", "extent", "mask"]
    assert sorted(map(str, whole.select(name, *head).collect())) == sorted(map(str, tiles.select("prefix", *head).collect()))
    # a file that is none, and one that ends among its points
    (tmp_path / "none.hypc").write_bytes(b"none of them")
    (tmp_path / "cut.hypc").write_bytes((tmp_path / "t0.hypc").read_bytes()[:-5])
    flat = sorted(map(str, codec.points_of(codec.read_tiles(spark, str(tmp_path)).filter("error is null")).collect()))
    for split in (100, codec.SPLIT):
        assert sorted(map(str, codec.read_points(spark, str(tmp_path), split=split).collect())) == flat
    with pytest.raises(Exception, match="magic|ends within"):
        codec.read_points(spark, str(tmp_path), strict=True).count()


def test_files_that_are_there_stay_and_points_need_a_tile(spark, tmp_path):
    tiles, rows = made(spark, 100)
    sinks.write_points(tiles.filter("prefix = 't0'"), rows.filter("prefix = 't0'"), str(tmp_path), overwrite=True)
    assert [r.prefix for r in sinks.write_points(tiles, rows, str(tmp_path)).orderBy("prefix").collect()] == ["t1", "t2"]
    with pytest.raises(Exception, match="which has no tile"):
        sinks.write_points(tiles.filter("prefix <> 't1'"), rows, str(tmp_path / "other"), overwrite=True)
    with pytest.raises(Exception, match="several tiles"):
        sinks.write_points(tiles.unionByName(tiles), rows, str(tmp_path / "third"), overwrite=True)
