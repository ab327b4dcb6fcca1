"""Vertex records are parsed once a line."""

import pytest

from tesselon.sources import obj


def test_a_line_is_split_once(spark):
    """Every use of a coordinate split its line again: 827 seconds of tasks for six million lines."""
    rows = spark.createDataFrame([("v 1 2 3",)], "line string")
    plan = obj.vertices(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("rlike") + plan.count("RLIKE") <= 6


def test_records_and_numbers(spark):
    lines = ["v 1 2 3", " \t v +1.5 -.5 2e3 9 9 9\r", "v\t1 2 3", "vn 1 2 3", "v 1 inf 3", "v 1 -Infinity 3", "v NaN 1 2", "v 1  2\t3", "v 1. 2.e1 -0", ""]
    got = obj.vertices(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert got.columns == ["line", "x", "y", "z"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1.0, 2.0, 3.0), (1.0, 2.0, 3.0), (1.0, 20.0, 0.0), (1.5, -0.5, 2000.0)]
    for bad in ("v 1 2", "v 1 2 3d", "v 1 2 0x1", "v 1 2 infx", "v 1 2 1_0"):
        d = spark.createDataFrame([(bad,)], "line string")
        assert obj.vertices(d, strict=False).count() == 0
        with pytest.raises(Exception, match="not a vertex"):
            obj.vertices(d).collect()
