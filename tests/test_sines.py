"""Earth-centred coordinates to the last bit, so that no row falls on the other side of a rounding border."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tesselon.functions import geo
from tesselon.plans import catalogue


def test_coordinates_are_those_of_the_systems_library(spark):
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.col("h"))
    rows = spark.sql("select 5246e-2 + id*1e-6 as lat, 1334e-2 + id*1e-6 as lon, cast(id % 50 as double) as h from range(20000)")
    for r in rows.select("*", x.alias("x"), y.alias("y"), z.alias("z")).collect():
        phi, lam = math.radians(r.lat), math.radians(r.lon)
        n = geo.A / math.sqrt(1.0 - geo.E2 * math.sin(phi) * math.sin(phi))
        assert (r.x, r.y, r.z) == ((n + r.h) * math.cos(phi) * math.cos(lam), (n + r.h) * math.cos(phi) * math.sin(lam), (n * (1.0 - geo.E2) + r.h) * math.sin(phi))
    assert rows.limit(1).select(geo.sine(F.lit(None).cast("double"))).first()[0] is None


def test_billboards_at_rounding_borders_are_those_of_sql(spark, tmp_path):
    # steps of longitude and latitude, and height, of points whose corners lie at a border
    places = [(7577, 97395, 35.0), (8794, 21040, 49.0), (4636, 52825, 28.0), (7482, 55135, 10.0), (1067, 31996, 16.0), (18325, 36273, 49.0)]
    lon, lat = pow(7919, -1, 100003), pow(6151, -1, 99991)
    rows = [{"l_orderkey": i * lon % 100003, "l_linenumber": 0, "l_partkey": j * lat % 99991, "l_suppkey": 0, "l_quantity": h} for i, j, h in places]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "lineitem.parquet")
    got = sorted(map(tuple, catalogue.billboard_expand(spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
        assert got == sorted(c.execute(catalogue.ORACLES["billboard_expand"]).fetchall())
    assert len(got) == 6 * len(places)
