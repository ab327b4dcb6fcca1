"""Every query against its SQL in another engine."""

import os

import duckdb
import pytest

from tesselon.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    want = found.fetchall()
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(want) > 0
    assert rows(got.columns, have) == rows(names, want)


@pytest.mark.parametrize("name", ["edl_shade", "semantic_tint", "rgb_shift", "crt_pass", "debug_view"])
def test_screen_passes_draw_every_row(spark, duck, name):
    wide = catalogue.WIDE
    drawn = duck.execute(f"SELECT DISTINCT (l_orderkey*5 + l_linenumber*11) % {wide[1]}, (l_partkey*7 + l_suppkey) % {wide[0]} FROM lineitem").fetchall()
    assert {(r.y, r.x) for r in catalogue.QUERIES[f"{name}_all"](spark, SF).select("y", "x").collect()} == set(drawn)
    assert len(drawn) < wide[0] * wide[1]
