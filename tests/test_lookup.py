"""Labels of points from few and from many painted pixels."""

from tesselon.operators import cloud


def test_few_pixels_need_no_shuffle_of_points(spark, monkeypatch):
    """Points were dealt out by pixel, however few pixels a mask had."""
    points = spark.createDataFrame([(k % 3, 3.8e6 + k, 9e5 + 2.0 * k, 5.0e6 - k, 4 if k % 5 == 0 else None) for k in range(300)], "tile_id int, ex double, ey double, ez double, label int").repartition(3)
    mask = spark.createDataFrame([(t, y, x, 1 + (x + y) % 9) for t in range(2) for y in range(8) for x in range(8)], "tile_id int, y int, x int, class int")
    box = spark.createDataFrame([(t, 132000000, 134000000, 519000000, 521000000) for t in range(2)], "tile_id int, lon_min_q7 int, lon_max_q7 int, lat_min_q7 int, lat_max_q7 int")
    got = []
    for most, joins in ((1 << 18, 0), (0, 1)):
        monkeypatch.setattr(cloud, "BROADCAST_PIXELS", most)
        found = cloud.label_points(points, mask, box, 8)
        assert (", rightHint=(strategy=broadcast)" in found._jdf.queryExecution().optimizedPlan().toString()) == (joins == 0)
        got.append(sorted(map(tuple, found.collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == 300
