"""Spatial views derived from the raw tables, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("nation", "customer", "orders", "lineitem", "part")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tiles": (
        ("nation",),
        """select n_nationkey as tile_id, concat('tile_', cast(n_nationkey as string)) as prefix,
  1334e-2 + (n_nationkey % 5)*2e-2 as lon_min, 1334e-2 + (n_nationkey % 5)*2e-2 + 2e-2 as lon_max,
  5246e-2 + floor(n_nationkey/5e0)*2e-2 as lat_min, 5246e-2 + floor(n_nationkey/5e0)*2e-2 + 2e-2 as lat_max
from {nation}""",
    ),
    "points": (
        ("lineitem",),
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  1334e-2 + ((l_orderkey*7919 + l_linenumber*104729) % 100003)*1e-6 as lon,
  5246e-2 + ((l_partkey*6151 + l_suppkey*31) % 99991)*1e-6 as lat,
  cast(l_quantity as double) as h_m, cast(l_partkey % 10 as int) as label
from {lineitem}""",
    ),
    "osm_nodes": (
        ("orders",),
        """select o_orderkey as node_id,
  1334e-2 + ((o_custkey*7919) % 110017)*1e-6 + ((o_orderkey*104729) % 8009)*1e-6 as lon,
  5246e-2 + ((o_custkey*6151) % 110023)*1e-6 + ((o_orderkey*7351) % 8011)*1e-6 as lat
from {orders}""",
    ),
    "way_refs": (
        ("orders", "customer"),
        """select o_custkey as way_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as seq, o_orderkey as node_id from {orders}
union all
select c_custkey, cast(0 as bigint), -1 - c_custkey from {customer} where c_custkey % 5 = 0""",
    ),
    "osm_ways": (
        ("customer",),
        """select c_custkey as way_id,
  case when c_custkey % 10 < 3 then case when c_custkey % 20 = 1 then 'no' when c_custkey % 20 = 12 then '' else 'yes' end end as building,
  case when c_custkey % 10 between 2 and 6 then case c_custkey % 8 when 0 then 'motorway' when 1 then 'trunk' when 2 then 'primary' when 3 then 'secondary' when 4 then 'tertiary' when 5 then 'residential' when 6 then 'service' else 'footway' end end as highway,
  case when c_custkey % 7 = 0 then cast(c_nationkey % 6 as string) when c_custkey % 23 = 0 then 'two' end as lanes,
  case when c_custkey % 11 = 0 then '12 ft' when c_custkey % 13 = 0 then '3.5m' when c_custkey % 17 = 0 then 'wide' when c_custkey % 19 = 0 then '0.4' end as width,
  case when c_custkey % 30 = 7 then 'water' when c_custkey % 30 = 17 then 'wood' end as natural_tag,
  case when c_custkey % 30 = 27 then 'riverbank' end as waterway,
  case when c_custkey % 50 = 8 then 'forest' when c_custkey % 50 = 18 then 'grass' when c_custkey % 50 = 28 then 'reservoir' when c_custkey % 50 = 38 then 'residential' end as landuse,
  case when c_custkey % 50 = 48 then 'park' end as leisure,
  case when c_custkey % 20 = 9 then 'rail' end as railway,
  case when c_custkey % 20 = 19 then 'parking' end as amenity
from {customer}""",
    ),
    "obj_lines": (
        ("part",),
        """select p_partkey as line_no, p_partkey % 40 as file_id,
  case when p_partkey % 13 = 0 then concat('# ', p_name)
       when p_partkey % 13 = 1 then 'vn 0 0 1'
       when p_partkey % 13 = 2 then concat('f ', cast(p_partkey as string), ' 1 2')
       when p_partkey % 13 = 3 then 'v inf 0 0'
       when p_partkey % 13 = 4 then concat('  v ', cast(p_partkey % 180 as string), ' ', cast(p_size as string), ' 5 1 1 1')
       else concat('v ', cast(p_partkey % 180 as string), '.', cast(100 + p_size as string), ' ', cast(p_size as string), '.5 ', cast(p_partkey % 97 as string)) end as line
from {part}""",
    ),
    "files": (
        ("nation",),
        """select concat('in/tile_', cast(n_nationkey as string), '.obj') as path, concat('tile_', cast(n_nationkey as string)) as stem, 'obj' as ext from {nation} where n_nationkey % 3 <> 0
union all select concat('in/tile_', cast(n_nationkey as string), '.zip'), concat('tile_', cast(n_nationkey as string)), 'zip' from {nation} where n_nationkey % 2 = 0 and n_nationkey % 3 <> 0
union all select concat('in/tile_', cast(n_nationkey as string), '_lod1.obj'), concat('tile_', cast(n_nationkey as string), '_lod1'), 'obj' from {nation} where n_nationkey % 3 = 0
union all select concat('in/tile_', cast(n_nationkey as string), '_lod2.zip'), concat('tile_', cast(n_nationkey as string), '_lod2'), 'zip' from {nation} where n_nationkey % 6 = 0""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def ctes(*names: str) -> str:
    """The views as common table expressions over the raw tables, for an oracle."""
    return ",\n".join(f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names)
