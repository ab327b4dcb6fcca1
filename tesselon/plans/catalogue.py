"""Every query of the engine over the derived views, with independent SQL that checks it.

Results are whole numbers, strings and flags: lengths in millimetres, degrees in ticks of 1e-7, ratios
in millionths.  They do not depend on the order in which doubles are summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tesselon.functions import classify, fixed, geo, names
from tesselon.operators import cloud, progress, raster, render, spatial, tiles as tiling
from tesselon.plans import convert, load, samples
from tesselon.plans.fixtures import ctes, view
from tesselon.sources import codec, features, files, obj, pbf, sinks
from tesselon.streaming import ingest

GRID = 64
#: A conversion's own grid.
FULL_GRID = 512
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)
VIEWPORT = (320, 180)
SCREEN = (96, 64)
#: The screen on which every row is drawn; some of its pixels stay empty.
WIDE = (640, 360)
CAMERA = render.Camera(52.51, 13.39, 6000.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def scaled(c: Column, by: float = 1000.0) -> Column:
    return F.round(c * by).cast("bigint")


def num(v: float) -> str:
    """A double literal in either engine."""
    return f"({v:.17e})"


# ---------------------------------------------------------------- SQL parts

_S2 = "sin(radians(lat))*sin(radians(lat))"
ECEF = f"""(SELECT *, (nn + h_m)*cos(radians(lat))*cos(radians(lon)) AS ex, (nn + h_m)*cos(radians(lat))*sin(radians(lon)) AS ey, (nn*(1e0 - {num(geo.E2)}) + h_m)*sin(radians(lat)) AS ez
  FROM (SELECT *, {num(geo.A)}/sqrt(1e0 - {num(geo.E2)}*{_S2}) AS nn FROM {{src}}))"""


def geodetic_sql(src: str, x: str, y: str, z: str) -> str:
    """``src`` with glat, glon, gh."""
    return f"""(SELECT *, degrees(phi) AS glat, degrees(atan2({y}, {x})) AS glon, p/cos(phi) - {num(geo.A)}/sqrt(1e0 - {num(geo.E2)}*sin(phi)*sin(phi)) AS gh FROM
  (SELECT *, atan2({z} + {num(geo.EP2 * geo.B)}*pow(sin(th), 3), p - {num(geo.E2 * geo.A)}*pow(cos(th), 3)) AS phi FROM
  (SELECT *, sqrt({x}*{x} + {y}*{y}) AS p, atan2({z}*{num(geo.A)}, sqrt({x}*{x} + {y}*{y})*{num(geo.B)}) AS th FROM {src})))"""


def big(e: str) -> str:
    return f"CAST(round({e}) AS BIGINT)"


def _scaled_list(columns, by: str, suffix: str) -> str:
    return ", ".join(f"{big(f'{c}*{by}')} AS {c}{suffix}" for c in columns)


_TILED = f"tiled AS (SELECT e.*, t.tile_id FROM {ECEF.format(src='points')} e JOIN tiles t ON e.lon BETWEEN t.lon_min AND t.lon_max AND e.lat BETWEEN t.lat_min AND t.lat_max)"
_BOXED = ctes("tiles", "points") + ",\n" + _TILED


def anchored_sql(requested: int) -> str:
    reach = "greatest(hx - cx, cx - lx, hy - cy, cy - ly, hz - cz, cz - lz)"
    return f"""stat AS (SELECT tile_id, count(*) AS n, avg(ex) AS cx, avg(ey) AS cy, avg(ez) AS cz, min(ex) AS lx, max(ex) AS hx, min(ey) AS ly, max(ey) AS hy, min(ez) AS lz, max(ez) AS hz FROM tiled GROUP BY tile_id),
anch AS (SELECT *, {big('cx*upm')} AS ax, {big('cy*upm')} AS ay, {big('cz*upm')} AS az FROM
  (SELECT *, CASE WHEN {reach} <= 1e-12 THEN CAST({requested} AS BIGINT) ELSE CAST(greatest(least(floor(2147483647e0/({reach}*105e-2)), {requested}e0), 1e0) AS BIGINT) END AS upm FROM stat)),
offs AS (SELECT tiled.*, anch.upm, anch.ax, anch.ay, anch.az, {big('ex*anch.upm')} - anch.ax AS dx, {big('ey*anch.upm')} - anch.ay AS dy, {big('ez*anch.upm')} - anch.az AS dz FROM tiled JOIN anch USING (tile_id))"""


_PADDED = """padded AS (SELECT tile_id, lon_min - plon AS lon_min, lon_max + plon AS lon_max, lat_min - plat AS lat_min, lat_max + plat AS lat_max FROM
  (SELECT *, 50e0/110574e0 AS plat, 50e0/(111320e0*greatest(abs(cos(radians(5e-1*(lat_min + lat_max)))), 1e-6)) AS plon FROM tiles))"""
_KEPT = _PADDED + """,
kept AS (SELECT n.node_id, n.lon, n.lat, p.tile_id FROM osm_nodes n JOIN padded p ON n.lon BETWEEN p.lon_min AND p.lon_max AND n.lat BETWEEN p.lat_min AND p.lat_max)"""
_NUMERIC = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def _float_sql(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, {_NUMERIC}) THEN TRY_CAST({e} AS FLOAT) END"


_WIDTH = f"""w AS (SELECT *, CASE WHEN s LIKE '%m' THEN {_float_sql("trim(left(s, length(s) - 1))")}
  WHEN s LIKE '%ft' THEN CAST(({_float_sql("trim(left(s, length(s) - 2))")}) * CAST(0.3048 AS FLOAT) AS FLOAT)
  ELSE {_float_sql("s")} END AS wm, CASE WHEN regexp_matches(lanes, '^[+]?[0-9]+$') THEN TRY_CAST(lanes AS BIGINT) END AS ln FROM (SELECT *, lower(trim(width)) AS s FROM osm_ways))"""
_HIGHWAY = (
    _WIDTH
    + """,
hb AS (SELECT *, CASE WHEN highway IN ('motorway','trunk','primary') THEN 2 WHEN highway IN ('secondary','tertiary','residential','service') THEN 3 ELSE 4 END AS hc,
  CAST(CASE highway WHEN 'motorway' THEN 12 WHEN 'trunk' THEN 10 WHEN 'primary' THEN 8 WHEN 'secondary' THEN 7 WHEN 'tertiary' THEN 6 WHEN 'residential' THEN 5 WHEN 'service' THEN 5 ELSE 2 END AS FLOAT) AS base FROM w),
hw AS (SELECT *, CASE WHEN wm IS NOT NULL THEN greatest(wm, CAST(1 AS FLOAT)) WHEN coalesce(ln, 0) >= 2 THEN greatest(CAST(CAST(ln AS FLOAT) * CAST(3.2 AS FLOAT) AS FLOAT), base) ELSE base END AS hwm FROM hb)"""
)
_CLASS = (
    _HIGHWAY
    + """,
cl0 AS (SELECT way_id, CASE WHEN building <> '' THEN 1 WHEN highway IS NOT NULL THEN hc WHEN natural_tag = 'water' THEN 5 WHEN waterway = 'riverbank' THEN 5 WHEN landuse = 'forest' THEN 7
   WHEN landuse IN ('grass','meadow','reservoir') THEN 6 WHEN leisure IN ('park','pitch') THEN 6 WHEN railway <> '' THEN 8 WHEN amenity = 'parking' THEN 9 END AS class,
   CASE WHEN coalesce(building, '') <> '' THEN CAST(0 AS FLOAT) WHEN highway IS NOT NULL THEN hwm WHEN natural_tag = 'water' OR waterway = 'riverbank' OR landuse IN ('forest','grass','meadow','reservoir') OR leisure IN ('park','pitch') THEN CAST(0 AS FLOAT) WHEN railway <> '' THEN CAST(4 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS width_m,
   CASE WHEN coalesce(building, '') <> '' THEN true WHEN highway IS NOT NULL THEN false WHEN natural_tag = 'water' OR waterway = 'riverbank' OR landuse IN ('forest','grass','meadow','reservoir') OR leisure IN ('park','pitch') THEN true WHEN railway <> '' THEN false ELSE true END AS is_area FROM hw),
cl AS (SELECT * FROM cl0 WHERE class IS NOT NULL)"""
)
_CLASS_NAMES = ", ".join(f"({c[0]}, '{c[1]}')" for c in classify.CLASSES)
_OVERLAY_VIEWS = ctes("tiles", "osm_nodes", "way_refs", "osm_ways")
_OVERLAY = (
    _OVERLAY_VIEWS
    + ",\n"
    + _KEPT
    + ",\n"
    + _CLASS
    + """,
geo1 AS (SELECT r.way_id, r.seq, k.node_id, k.lon, k.lat FROM way_refs r JOIN (SELECT DISTINCT node_id, lon, lat FROM kept) k USING (node_id)),
geon AS (SELECT way_id, count(*) AS nv FROM geo1 GROUP BY way_id),
wt AS (SELECT DISTINCT r.way_id, k.tile_id FROM way_refs r JOIN kept k USING (node_id)),
ov AS (SELECT wt.tile_id, cl.*, geon.nv FROM cl JOIN geon USING (way_id) JOIN wt USING (way_id) WHERE nv >= CASE WHEN is_area THEN 3 ELSE 2 END)"""
)


def _pix(v: str, lo: str, hi: str, grid: int) -> str:
    return f"CAST(round(CAST(greatest(least(CAST(({v} - {lo})/greatest({hi} - {lo}, 1e-12) AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT)) * CAST({grid - 1} AS FLOAT) AS FLOAT)) AS INTEGER)"


_f = "CAST({} AS FLOAT)".format
_PREC = "CASE class WHEN 5 THEN 200 WHEN 1 THEN 200 WHEN 8 THEN 160 WHEN 2 THEN 150 WHEN 3 THEN 140 WHEN 4 THEN 130 WHEN 6 THEN 100 WHEN 7 THEN 90 WHEN 9 THEN 80 ELSE 0 END"


def _grid_sql(grid: int) -> tuple[str, str, str]:
    """Areas, then lines as well, then masks and runs, on grids of this size."""
    pixels = (
        _OVERLAY
        + f""",
vx AS (SELECT ov.tile_id, ov.way_id, ov.class, ov.is_area, ov.width_m, row_number() OVER (PARTITION BY ov.tile_id, ov.way_id ORDER BY g.seq) AS i, ov.nv, {_pix('g.lon', 't.lon_min', 't.lon_max', grid)} AS x, {_pix('g.lat', 't.lat_min', 't.lat_max', grid)} AS y,
  greatest(CAST(CAST(ov.width_m AS DOUBLE)*5e-1/(5e-1*(greatest(t.lon_max - t.lon_min, 1e-12)*111320e0*greatest(abs(cos(radians(5e-1*(t.lat_min + t.lat_max)))), 1e-6)/{grid}e0 + greatest(t.lat_max - t.lat_min, 1e-12)*110574e0/{grid}e0)) AS FLOAT), CAST(0.5 AS FLOAT)) AS radius
  FROM ov JOIN geo1 g USING (way_id) JOIN tiles t ON t.tile_id = ov.tile_id),
ed AS (SELECT a.tile_id, a.way_id, a.class, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM vx a JOIN vx b ON a.tile_id = b.tile_id AND a.way_id = b.way_id AND b.i = CASE WHEN a.i = 1 THEN a.nv ELSE a.i - 1 END WHERE a.is_area),
bb AS (SELECT tile_id, way_id, min(class) AS class, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vx WHERE is_area GROUP BY 1, 2),
cand AS (SELECT tile_id, way_id, class, y, unnest(generate_series(x0, x1)) AS x FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM bb)),
area AS (SELECT c.tile_id, c.way_id, c.class, c.y, c.x FROM cand c JOIN ed e ON c.tile_id = e.tile_id AND c.way_id = e.way_id AND (e.yi > c.y) <> (e.yj > c.y)
  AND CAST(c.x AS FLOAT) < CAST(CAST(CAST(e.xj - e.xi AS FLOAT) * CAST(CAST(c.y - e.yi AS FLOAT)/CAST(nullif(e.yj - e.yi, 0) AS FLOAT) AS FLOAT) AS FLOAT) + CAST(e.xi AS FLOAT) AS FLOAT)
  GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1)"""
    )
    lines = (
        pixels
        + f""",
sg AS (SELECT DISTINCT a.tile_id, a.way_id, a.class, a.radius AS r, {_f('a.x')} AS x0, {_f('a.y')} AS y0, {_f('b.x')} AS x1, {_f('b.y')} AS y1 FROM vx a JOIN vx b ON a.tile_id = b.tile_id AND a.way_id = b.way_id AND b.i = a.i + 1 WHERE NOT a.is_area),
lc AS (SELECT *, unnest(generate_series(greatest(least(CAST(floor(least(x0, x1) - r) AS INTEGER), {grid - 1}), 0), greatest(least(CAST(ceil(greatest(x0, x1) + r) AS INTEGER), {grid - 1}), 0))) AS x FROM
  (SELECT *, unnest(generate_series(greatest(least(CAST(floor(least(y0, y1) - r) AS INTEGER), {grid - 1}), 0), greatest(least(CAST(ceil(greatest(y0, y1) + r) AS INTEGER), {grid - 1}), 0))) AS y FROM sg)),
lt AS (SELECT *, {_f('x')} + {_f('0.5')} AS px, {_f('y')} + {_f('0.5')} AS py FROM lc),
lu AS (SELECT *, greatest(least(CAST(CAST((px - x0)*(x1 - x0) + (py - y0)*(y1 - y0) AS FLOAT)/CAST((x1 - x0)*(x1 - x0) + (y1 - y0)*(y1 - y0) + {_f('1e-12')} AS FLOAT) AS FLOAT), {_f('1')}), {_f('0')}) AS t FROM lt),
line AS (SELECT DISTINCT tile_id, way_id, class, y, x FROM lu WHERE (px - (x0 + t*(x1 - x0)))*(px - (x0 + t*(x1 - x0))) + (py - (y0 + t*(y1 - y0)))*(py - (y0 + t*(y1 - y0))) <= r*r)"""
    )
    mask = (
        lines
        + f""",
painted AS (SELECT tile_id, y, x, class FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, y, x ORDER BY {_PREC} DESC, ln DESC, way_id DESC) AS k FROM
  (SELECT *, 0 AS ln FROM area UNION ALL SELECT *, 1 AS ln FROM line)) WHERE k = 1),
withov AS (SELECT DISTINCT tile_id FROM ov),
full_grid AS (SELECT w.tile_id, y.y, x.x, coalesce(p.class, 0) AS class FROM withov w CROSS JOIN (SELECT unnest(generate_series(0, {grid - 1})) AS y) y CROSS JOIN (SELECT unnest(generate_series(0, {grid - 1})) AS x) x
  LEFT JOIN painted p ON p.tile_id = w.tile_id AND p.y = y.y AND p.x = x.x),
runs AS (SELECT tile_id, min(i) AS start, count(*) AS len, class FROM (SELECT *, i - row_number() OVER (PARTITION BY tile_id, class ORDER BY i) AS g FROM (SELECT *, CAST(y*{grid} + x AS BIGINT) AS i FROM full_grid)) GROUP BY tile_id, class, g)"""
    )
    return pixels, lines, mask


_PIXELS, _LINES, _MASK = _grid_sql(GRID)
_FULL_MASK = _grid_sql(FULL_GRID)[2]

_FRAG = """frag AS (SELECT CAST((l_partkey*7 + l_suppkey) % 96 AS INTEGER) AS x, CAST((l_orderkey*5 + l_linenumber*11) % 64 AS INTEGER) AS y, ((l_orderkey*31 + l_linenumber*17 + l_partkey) % 1000)/1001e0 + 5e-4 AS z, CAST(l_partkey % 10 AS INTEGER) AS label,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem})"""
_ALL_FRAG = f"""frag AS (SELECT CAST((l_partkey*7 + l_suppkey) % {WIDE[0]} AS INTEGER) AS x, CAST((l_orderkey*5 + l_linenumber*11) % {WIDE[1]} AS INTEGER) AS y, ((l_orderkey*31 + l_linenumber*17 + l_partkey) % 1000)/1001e0 + 5e-4 AS z, CAST(l_partkey % 10 AS INTEGER) AS label,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {{lineitem}})"""
_PIX_SQL = (
    f""",
pix AS (SELECT y, x, z, label, CASE WHEN (x + y) % 17 = 0 THEN 0e0 ELSE 1e0 END AS tag, 7e-1 AS r, 7e-1 AS g, 7e-1 AS b FROM
  (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY z, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM frag) WHERE k = 1),
col(class, cr, cg, cb) AS (VALUES {', '.join(f'({c[0]}, {num(c[3])}, {num(c[4])}, {num(c[5])})' for c in classify.CLASSES)}),
tinted AS (SELECT y, x, z, label, tag, """
    + ", ".join(f"CASE WHEN z < 9999e-4 AND label <> 0 THEN {c}*2e-1 + c{c}*8e-1 ELSE {c} END AS {c}" for c in "rgb")
    + " FROM pix JOIN col ON col.class = pix.label)"
)
_SCREEN_SQL = _FRAG.format(lineitem="lineitem") + _PIX_SQL
_ALL_SQL = _ALL_FRAG.format(lineitem="lineitem") + _PIX_SQL


def rgb_sql(src: str) -> str:
    return f"SELECT y, x, {_scaled_list('rgb', '1e6', '_u')} FROM {src}"


# ---------------------------------------------------------------- views


def _points(spark, d) -> DataFrame:
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.col("h_m"))
    return view(spark, d, "points").withColumns({"ex": x, "ey": y, "ez": z})


def _tiled(spark, d) -> DataFrame:
    return spatial.in_boxes(_points(spark, d), view(spark, d, "tiles"))


def _kept(spark, d) -> DataFrame:
    return spatial.keep_nodes(view(spark, d, "osm_nodes"), spatial.pad_tiles(view(spark, d, "tiles")))


def _overlay(spark, d) -> DataFrame:
    return spatial.overlay(view(spark, d, "osm_ways"), view(spark, d, "way_refs"), _kept(spark, d))


def _pixelised(spark, d) -> DataFrame:
    return raster.pixelised(_overlay(spark, d), view(spark, d, "tiles"), GRID)


def _mask(spark, d, grid: int = GRID) -> tuple[DataFrame, DataFrame]:
    """Painted pixels, and the tiles that have an overlay; what is kept for both is the painted rows, not the ways."""
    rows = files.checkpointed(raster.painted_rows(_overlay(spark, d), view(spark, d, "tiles"), grid))
    return raster.painted_pixels(rows), rows.select("tile_id").distinct()


def _dense(spark, d) -> DataFrame:
    return raster.dense(*_mask(spark, d), GRID)


def _runs(spark, d, grid: int = GRID) -> DataFrame:
    return raster.painted_runs(*_mask(spark, d, grid), grid)


def _anchored(spark, d, upm: int = 1000) -> tuple[DataFrame, DataFrame]:
    rows = _tiled(spark, d)
    found = tiling.anchors(rows, "tile_id", upm)
    return found, tiling.offsets(rows, found, "tile_id")


def _screen(spark, d, fragments: str = _FRAG) -> DataFrame:
    frag = spark.sql("WITH " + fragments + " SELECT * FROM frag", lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    px = render.depth_resolve(frag, KEYS)
    return render.coloured(px.withColumn("tag", F.when((F.col("x") + F.col("y")) % 17 == 0, 0.0).otherwise(1.0)))


def _rgb(px: DataFrame) -> DataFrame:
    return px.select("y", "x", *[scaled(F.col(c), 1e6).alias(f"{c}_u") for c in "rgb"])


# ---------------------------------------------------------------- scalar geodesy


@query(f"WITH {ctes('points')} SELECT {K}, {big('ex*1e3')} AS x_mm, {big('ey*1e3')} AS y_mm, {big('ez*1e3')} AS z_mm FROM {ECEF.format(src='points')}")
def geodetic_to_ecef_mm(spark, d):
    return _points(spark, d).select(*KEYS, *[scaled(F.col(f"e{a}")).alias(f"{a}_mm") for a in "xyz"])


@query(f"WITH {ctes('points')} SELECT {K}, {big('glat*1e7')} AS lat_q7, {big('glon*1e7')} AS lon_q7, {big('gh*1e3')} AS h_mm FROM {geodetic_sql(ECEF.format(src='points'), 'ex', 'ey', 'ez')}")
def ecef_roundtrip_deg(spark, d):
    lat, lon, h = geo.geodetic(F.col("ex"), F.col("ey"), F.col("ez"))
    return _points(spark, d).select(*KEYS, scaled(lat, 1e7).alias("lat_q7"), scaled(lon, 1e7).alias("lon_q7"), scaled(h).alias("h_mm"))


@query(f"WITH {ctes('points')} SELECT {K}, CAST(round(lon*1e7) AS INTEGER) AS lon_q7, CAST(round(lat*1e7) AS INTEGER) AS lat_q7, {big('(round(lon*1e7)*1e-7 - lon)*1e9')} AS err_lon FROM points")
def q7_roundtrip(spark, d):
    q = fixed.q7(F.col("lon"))
    return view(spark, d, "points").select(*KEYS, q.alias("lon_q7"), fixed.q7(F.col("lat")).alias("lat_q7"), scaled(fixed.q7_degrees(q) - F.col("lon"), 1e9).alias("err_lon"))


@query(f"WITH {ctes('points')}, m AS (SELECT {K}, round(ex*1e3)/1e3 AS v FROM {ECEF.format(src='points')}) SELECT {K}, {big('CAST(CAST(v AS FLOAT) AS DOUBLE)*1e3')} AS hi_mm, {big('CAST(CAST(v - CAST(CAST(v AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE)*1e6')} AS lo_um FROM m")
def hi_lo_split(spark, d):
    high, low = fixed.split_high_low(F.col("v"))
    return _points(spark, d).select(*KEYS, (F.round(F.col("ex") * 1000) / 1000).alias("v")).select(*KEYS, scaled(high.cast("double")).alias("hi_mm"), scaled(low.cast("double"), 1e6).alias("lo_um"))


_LOCAL = "SELECT l_orderkey % 25 AS tile_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey*7 % 1301)*1e0 AS x, (l_suppkey*13 % 1103)*1e0 AS y, CAST(l_quantity AS DOUBLE) AS z FROM {lineitem}"


@query(
    f"""WITH {ctes('tiles')}, v AS ({_LOCAL.format(lineitem='lineitem')}), o AS (SELECT tile_id, (min(x) + max(x))/2 AS e0, (min(y) + max(y))/2 AS n0 FROM v GROUP BY 1),
c AS (SELECT v.*, x - e0 AS xe, y - n0 AS yn, 5e-1*(lat_min + lat_max) AS lat, 5e-1*(lon_min + lon_max) AS lon FROM v JOIN o USING (tile_id) JOIN tiles USING (tile_id)),
r AS (SELECT *, 1e0 - {num(geo.E2)}*{_S2} AS ww FROM c)
SELECT {K}, {big(f"(lat + degrees(yn/({num(geo.A * (1 - geo.E2))}/(ww*sqrt(ww)))))*1e7")} AS lat_q7, {big(f"(lon + degrees(xe/({num(geo.A)}/sqrt(ww)*cos(radians(lat)))))*1e7")} AS lon_q7, {big('z*1e3')} AS h_mm FROM r"""
)
def local_to_geodetic(spark, d):
    v = spark.sql(_LOCAL, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    out = tiling.local_degrees(v, tiling.planar_origin(v, "tile_id"), view(spark, d, "tiles"), "tile_id")
    return out.select(*KEYS, scaled(F.col("lat"), 1e7).alias("lat_q7"), scaled(F.col("lon"), 1e7).alias("lon_q7"), scaled(F.col("h_m")).alias("h_mm"))


@query(f"WITH {ctes('tiles')}, {_PADDED} SELECT tile_id, {_scaled_list(('lon_min', 'lon_max', 'lat_min', 'lat_max'), '1e9', '_n')} FROM padded")
def tile_bbox_pad(spark, d):
    return spatial.pad_tiles(view(spark, d, "tiles")).select("tile_id", *[scaled(F.col(c), 1e9).alias(f"{c}_n") for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


@query(f"WITH {ctes('points')}, z AS (SELECT *, CAST(floor((lon + 18e1)/6e0) AS INTEGER) + 1 AS zone FROM points) SELECT {K}, zone, CAST(zone*6 - 183 AS BIGINT) AS meridian, {big('degrees(atan(tan(radians(lon - (zone*6 - 183)))*sin(radians(lat))))*1e6')} AS convergence_u FROM z")
def utm_convergence(spark, d):
    cm = geo.utm_central_meridian(F.col("lon"))
    return view(spark, d, "points").select(*KEYS, geo.utm_zone(F.col("lon")).alias("zone"), cm.cast("bigint").alias("meridian"), scaled(geo.meridian_convergence(F.col("lat"), F.col("lon"), cm), 1e6).alias("convergence_u"))


_T0 = render.Camera(52.5, 13.4, 1.0).target()


@query(
    f"""WITH {ctes('points')}, v AS (SELECT *, ex - {num(_T0[0])} AS vx, ey - {num(_T0[1])} AS vy, ez - {num(_T0[2])} AS vz, sin(radians(525e-1)) AS sp, cos(radians(525e-1)) AS cp, sin(radians(134e-1)) AS sl, cos(radians(134e-1)) AS cl FROM {ECEF.format(src='points')})
SELECT {K}, {big('(-sl*vx + cl*vy)*1e3')} AS e_mm, {big('(-sp*cl*vx - sp*sl*vy + cp*vz)*1e3')} AS n_mm, {big('(cp*cl*vx + cp*sl*vy + sp*vz)*1e3')} AS u_mm FROM v"""
)
def enu_rotation(spark, d):
    v = geo.rotate(geo.enu_basis(F.lit(52.5), F.lit(13.4)), tuple(F.col(f"e{a}") - t for a, t in zip("xyz", _T0, strict=True)))
    return _points(spark, d).select(*KEYS, *[scaled(c).alias(f"{n}_mm") for c, n in zip(v, "enu", strict=True)])


@query("SELECT c_custkey, CAST(floor(greatest(least((3e0 - greatest(least(ln(greatest(least(CAST(c_custkey AS DOUBLE), 1e3), 1e0))/ln(1e3), 1e0), 0e0)*(3e0 - 6e-1)), 1e9), 0e0)*1e6 + 5e-1) AS BIGINT) AS size_u FROM customer")
def point_size_altitude(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    return rows.select("c_custkey", F.floor(render.point_size(F.col("c_custkey").cast("double")) * 1e6 + 0.5).cast("bigint").alias("size_u"))


# ---------------------------------------------------------------- text scans and files


@query(
    f"""WITH {ctes('obj_lines')}, p AS (SELECT line_no, file_id, regexp_split_to_array(trim(line), '\\s+') AS f FROM obj_lines WHERE starts_with(trim(line), 'v '))
SELECT file_id, line_no, {big('CAST(f[2] AS DOUBLE)*1e3')} AS x_m, {big('CAST(f[3] AS DOUBLE)*1e3')} AS y_m, {big('CAST(f[4] AS DOUBLE)*1e3')} AS z_m FROM p WHERE isfinite(CAST(f[2] AS DOUBLE)) AND isfinite(CAST(f[3] AS DOUBLE)) AND isfinite(CAST(f[4] AS DOUBLE))"""
)
def finite_obj_vertices(spark, d):
    return obj.vertices(view(spark, d, "obj_lines")).select("file_id", "line_no", *[scaled(F.col(c)).alias(f"{c}_m") for c in "xyz"])


@query(
    f"""WITH {ctes('obj_lines')}, p AS (SELECT line_no, file_id, regexp_split_to_array(trim(line), '\\s+') AS f FROM obj_lines WHERE starts_with(trim(line), 'v ')),
v AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 4e6 ELSE 1e0 END*CAST(f[2] AS DOUBLE) AS x, CAST(f[3] AS DOUBLE)*CASE WHEN file_id % 3 = 1 THEN 1e2 ELSE 1e0 END AS y, CAST(f[4] AS DOUBLE) AS z, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM p WHERE isfinite(CAST(f[2] AS DOUBLE)))
SELECT file_id, CASE WHEN avg(CASE WHEN abs(x) <= 180 AND abs(y) <= 90 THEN 1e0 ELSE 0e0 END) >= 9e-1 THEN 'geodetic' WHEN avg(sqrt(x*x + y*y + z*z)) BETWEEN 62e5 AND 65e5 THEN 'ecef' ELSE 'local_m' END AS cs FROM v WHERE k <= 4096 GROUP BY file_id"""
)
def detect_input_cs(spark, d):
    v = obj.vertices(view(spark, d, "obj_lines")).withColumn("vid", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no")) - 1)
    v = v.withColumns({"x": F.col("x") * F.when(F.col("file_id") % 3 == 0, 4e6).otherwise(1.0), "y": F.col("y") * F.when(F.col("file_id") % 3 == 1, 100.0).otherwise(1.0)})
    return tiling.detect_system(v)


@query(f"WITH {ctes('tiles', 'files')}, x AS (SELECT t.prefix, f.path, f.stem, f.stem = t.prefix AS exact, row_number() OVER (PARTITION BY t.prefix ORDER BY CASE WHEN f.stem = t.prefix THEN 0 ELSE 1 END, f.stem, CASE WHEN f.ext = 'zip' THEN 0 ELSE 1 END, f.path) AS k FROM tiles t LEFT JOIN files f ON starts_with(f.stem, t.prefix)) SELECT prefix, path, coalesce(exact, false) AS exact FROM x WHERE k = 1")
def resolve_prefix(spark, d):
    return spatial.resolve_prefixes(view(spark, d, "tiles").select("prefix"), view(spark, d, "files"))


_STEMS = "SELECT concat('scan/block_', cast(o_orderkey as string), '.', case when o_orderkey % 3 = 0 then 'zip' else 'obj' end) AS path, concat('block_', cast(o_orderkey as string)) AS stem, case when o_orderkey % 3 = 0 then 'zip' else 'obj' end AS ext FROM {orders}"
_LEADS = "SELECT concat('block_', cast(c_custkey as string)) AS prefix FROM {customer}"


@query(
    f"""WITH files AS ({_STEMS.format(orders='orders')}), wanted AS ({_LEADS.format(customer='customer')}),
starts AS (SELECT left(stem, i) AS prefix, min(stem) AS stem FROM (SELECT stem, unnest(generate_series(1, length(stem))) AS i FROM files) GROUP BY 1)
SELECT w.prefix, f.path, coalesce(s.stem = w.prefix, false) AS exact FROM wanted w LEFT JOIN starts s USING (prefix) LEFT JOIN files f ON f.stem = s.stem"""
)
def resolve_prefix_of_one_lead(spark, d):
    """Prefixes and stems that all begin alike, one for each customer and order, as files of a set do."""
    stems = spark.sql(_STEMS, orders=spark.read.parquet(f"{d}/orders.parquet"))
    return spatial.resolve_prefixes(spark.sql(_LEADS, customer=spark.read.parquet(f"{d}/customer.parquet")), stems)


@query(f"WITH {ctes('tiles')} SELECT concat('out/', prefix, '.tile') AS path FROM tiles WHERE tile_id % 4 <> 0")
def incremental_skip(spark, d):
    t = view(spark, d, "tiles")
    done = t.filter("tile_id % 4 = 0").select(names.output_path("out", F.col("prefix"), ".tile").alias("path"))
    return t.select(names.output_path("out", F.col("prefix"), ".tile").alias("path")).join(done, "path", "left_anti")


@query(f"WITH {ctes('tiles', 'files')} SELECT tile_id, prefix FROM tiles t WHERE EXISTS (SELECT 1 FROM files f WHERE starts_with(f.stem, t.prefix) AND f.ext = 'zip')")
def required_work(spark, d):
    zips = view(spark, d, "files").filter("ext = 'zip'")
    found = spatial.resolve_prefixes(view(spark, d, "tiles").select("prefix"), zips).filter("path is not null")
    return view(spark, d, "tiles").join(found, "prefix", "left_semi").select("tile_id", "prefix")


@query(f"WITH {ctes('tiles')} SELECT tile_id, prefix, lower(hex(encode(prefix))) AS head, CAST(32 AS INTEGER) AS key_bytes, prefix AS shown FROM tiles")
def tile_keys(spark, d):
    key = names.tile_key(F.col("prefix"))
    rows = view(spark, d, "tiles").select("tile_id", "prefix", key.alias("k"))
    return rows.select("tile_id", "prefix", F.lower(F.hex(F.encode(names.key_text(F.col("k")), "UTF-8"))).alias("head"), F.octet_length("k").alias("key_bytes"), names.key_text(F.col("k")).alias("shown"))


# ---------------------------------------------------------------- classification


@query(f"WITH {ctes('osm_ways')}, {_WIDTH} SELECT way_id, width, {big('CAST(wm AS DOUBLE)*1e6')} AS width_u FROM w WHERE width IS NOT NULL")
def parse_width(spark, d):
    rows = view(spark, d, "osm_ways").filter("width is not null")
    return rows.select("way_id", "width", scaled(classify.width_m(F.col("width")).cast("double"), 1e6).alias("width_u"))


@query(f"WITH {ctes('osm_ways')}, {_HIGHWAY} SELECT way_id, highway, CAST(hc AS INTEGER) AS class, {big('CAST(hwm AS DOUBLE)*1e6')} AS width_u FROM hw WHERE highway IS NOT NULL")
def highway_width(spark, d):
    cls, wide = classify.highway(F.col("highway"), classify.lanes(F.col("lanes")), classify.width_m(F.col("width")))
    return view(spark, d, "osm_ways").filter("highway is not null").select("way_id", "highway", cls.cast("int").alias("class"), scaled(wide.cast("double"), 1e6).alias("width_u"))


@query(f"WITH {ctes('osm_ways')}, {_CLASS} SELECT way_id, CAST(class AS INTEGER) AS class, {big('CAST(width_m AS DOUBLE)*1e6')} AS width_u, is_area FROM cl")
def classify_way(spark, d):
    return spatial.classified(view(spark, d, "osm_ways")).select("way_id", "class", scaled(F.col("width_m").cast("double"), 1e6).alias("width_u"), "is_area")


@query(f"WITH {ctes('osm_ways')}, {_CLASS} SELECT name, CAST({_PREC} AS INTEGER) AS precedence, count(*) AS ways FROM cl JOIN (VALUES {_CLASS_NAMES}) n(k, name) ON k = class GROUP BY 1, 2")
def class_dimension(spark, d):
    dim = F.broadcast(classify.dimension(spark))
    return spatial.classified(view(spark, d, "osm_ways")).join(dim, "class").groupBy("name", "precedence").agg(F.count("*").alias("ways"))


# ---------------------------------------------------------------- spatial joins

_NODES = f"WITH {ctes('tiles', 'osm_nodes')}, {_KEPT} SELECT node_id, tile_id FROM kept"


@query(_NODES)
def nodes_in_tiles_broadcast(spark, d):
    return spatial.in_boxes_broadcast(view(spark, d, "osm_nodes"), spatial.pad_tiles(view(spark, d, "tiles"))).select("node_id", "tile_id")


@query(_NODES)
def nodes_in_tiles_cells(spark, d):
    return spatial.in_boxes_cells(view(spark, d, "osm_nodes"), spatial.pad_tiles(view(spark, d, "tiles"))).select("node_id", "tile_id")


@query(f"WITH {_OVERLAY_VIEWS}, {_KEPT} SELECT r.way_id, count(*) AS n, string_agg(CAST(k.node_id AS VARCHAR), ',' ORDER BY r.seq) AS nodes FROM way_refs r JOIN (SELECT DISTINCT node_id FROM kept) k USING (node_id) GROUP BY 1")
def resolve_way_vertices(spark, d):
    found = spatial.resolve_ways(view(spark, d, "way_refs"), _kept(spark, d))
    return found.select("way_id", F.size("verts").cast("bigint").alias("n"), F.array_join(F.transform("verts", lambda v: v["node_id"].cast("string")), ",").alias("nodes"))


@query(f"WITH {_OVERLAY_VIEWS}, {_KEPT} SELECT DISTINCT r.way_id, k.tile_id FROM way_refs r JOIN kept k USING (node_id)")
def way_tile_fanout(spark, d):
    return spatial.way_tiles(view(spark, d, "way_refs"), _kept(spark, d))


@query(f"WITH {_OVERLAY} SELECT tile_id, CAST(class AS INTEGER) AS class, is_area, count(*) AS ways, CAST(sum(nv) AS BIGINT) AS vertices FROM ov GROUP BY 1, 2, 3")
def overlay_by_class(spark, d):
    return _overlay(spark, d).groupBy("tile_id", "class", "is_area").agg(F.count("*").alias("ways"), F.sum(F.size("verts")).alias("vertices"))


@query(f"WITH {_OVERLAY_VIEWS}, {_KEPT}, g AS (SELECT r.way_id, k.lon, k.lat FROM way_refs r JOIN (SELECT DISTINCT node_id, lon, lat FROM kept) k USING (node_id)) SELECT way_id, {big('min(lon)*1e7')} AS lon_min, {big('min(lat)*1e7')} AS lat_min, {big('max(lon)*1e7')} AS lon_max, {big('max(lat)*1e7')} AS lat_max FROM g GROUP BY 1")
def ring_bbox(spark, d):
    ways = spatial.resolve_ways(view(spark, d, "way_refs"), _kept(spark, d))
    box = features.ring_bounds(F.transform("verts", lambda v: F.array(v["lon"], v["lat"])))
    return ways.select("way_id", box.alias("b")).select("way_id", *[scaled(F.col(f"b.{c}"), 1e7).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])


# ---------------------------------------------------------------- tiles

_BOUNDS = ", ".join(f"CAST({f}(d{a}) AS INTEGER) AS {f}_d{a}" for a in "xyz" for f in ("min", "max"))


@query(f"WITH {_BOXED}, {anchored_sql(1000)} SELECT tile_id, count(*) AS n, min(upm) AS upm, min(ax) AS ax, min(ay) AS ay, min(az) AS az, {_BOUNDS} FROM offs GROUP BY tile_id")
def quantise_offsets(spark, d):
    found, rows = _anchored(spark, d)
    return found.select("tile_id", "n", "upm", "ax", "ay", "az").join(cloud.offset_bounds(rows).drop("n"), "tile_id")


@query(f"WITH {_BOXED}, {anchored_sql(2000000000)} SELECT tile_id, n, {big('upm/1e2')} AS upm_hundreds FROM anch")
def adaptive_upm(spark, d):
    found, _ = _anchored(spark, d, 2_000_000_000)
    return found.select("tile_id", "n", scaled(F.col("upm"), 1e-2).alias("upm_hundreds"))


_ASKED = 400_000_000_000


def _fits_sql(u: str) -> str:
    return " AND ".join(f"round(l{a}*{u}) - round(c{a}*{u}) >= -2147483648e0 AND round(h{a}*{u}) - round(c{a}*{u}) <= 2147483647e0" for a in "xyz")


@query(
    f"""WITH {_BOXED}, {anchored_sql(1000)}, k AS (SELECT *, unnest(generate_series(0, 31)) AS k FROM stat), u AS (SELECT *, greatest(floor({_ASKED}e0/pow(2e0, k)), 1e0) AS u FROM k)
SELECT tile_id, min(n) AS n, min(k) AS halvings, CAST(arg_min(u, k) AS BIGINT) AS upm FROM u WHERE {_fits_sql('u')} GROUP BY tile_id"""
)
def halved_upm(spark, d):
    """A precision that no tile's offsets fit is halved until they do."""
    found = tiling.anchors(_tiled(spark, d), "tile_id", _ASKED, fitted=False)
    halvings = F.round(F.log2(F.lit(float(_ASKED)) / F.col("upm"))).cast("bigint")
    return found.select("tile_id", "n", halvings.alias("halvings"), "upm")


@query(f"WITH {_BOXED} SELECT tile_id, {', '.join(f'CAST(round({f}({c})*1e7) AS INTEGER) AS {c}_{f}_q7' for c in ('lon', 'lat') for f in ('min', 'max'))} FROM tiled GROUP BY tile_id")
def geodetic_extent(spark, d):
    return tiling.extents(_tiled(spark, d), "tile_id")


@query(f"WITH {_BOXED}, {anchored_sql(1000)} SELECT tile_id, count(*) AS n, {_BOUNDS} FROM offs GROUP BY tile_id")
def offset_aabb(spark, d):
    return cloud.offset_bounds(_anchored(spark, d)[1])


@query(
    f"""WITH {_BOXED}, {anchored_sql(1000)}, m AS (SELECT n, upm, ax/1e3 AS mx, ay/1e3 AS my, az/1e3 AS mz FROM anch), c AS (SELECT sum(mx*n)/sum(n) AS cx, sum(my*n)/sum(n) AS cy, sum(mz*n)/sum(n) AS cz, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS points, min(upm) AS upm_min, max(upm) AS upm_max FROM m),
s AS (SELECT max(sqrt((mx - cx)*(mx - cx) + (my - cy)*(my - cy) + (mz - cz)*(mz - cz))) AS sp FROM m CROSS JOIN c)
SELECT tiles, points, upm_min, upm_max, {big('cx*1e2')} AS cx_cm, {big('cy*1e2')} AS cy_cm, {big('cz*1e2')} AS cz_cm, {big('sp*1e2')} AS spread_cm, {big('greatest(least(2e0*sp, 5e4), 1e2)*1e2')} AS orbit_cm, sqrt(cx*cx + cy*cy + cz*cz) BETWEEN 62e5 AND 65e5 AS plausible FROM c CROSS JOIN s"""
)
def dataset_stats(spark, d):
    return _stats_row(cloud.dataset_stats(_anchored(spark, d)[0]))


def _stats_row(s: DataFrame) -> DataFrame:
    return s.select("tiles", "points", "upm_min", "upm_max", *[scaled(F.col(f"c{a}"), 100).alias(f"c{a}_cm") for a in "xyz"], scaled(F.col("spread_m"), 100).alias("spread_cm"), scaled(F.col("orbit_m"), 100).alias("orbit_cm"), "plausible")


@query(
    f"""WITH {_BOXED}, {anchored_sql(1000)}, f AS (SELECT tile_id, glat, glon FROM {geodetic_sql("(SELECT tile_id, ax/1e3 AS x, ay/1e3 AS y, az/1e3 AS z FROM anch)", "x", "y", "z")}),
e AS (SELECT tile_id, -sin(radians(glon))*dx/1e3 + cos(radians(glon))*dy/1e3 AS e, -sin(radians(glat))*cos(radians(glon))*dx/1e3 - sin(radians(glat))*sin(radians(glon))*dy/1e3 + cos(radians(glat))*dz/1e3 AS n FROM offs JOIN f USING (tile_id)),
s AS (SELECT tile_id, var_pop(e) AS ve, var_pop(n) AS vn, covar_pop(e, n) AS c FROM e GROUP BY 1)
SELECT tile_id, {big('ve')} AS var_e, {big('vn')} AS var_n, {big('c')} AS cov_en, {big('degrees(5e-1*atan2(2e0*c, ve - vn))*1e3')} AS angle_m FROM s"""
)
def tile_pca(spark, d):
    found, rows = _anchored(spark, d)
    return cloud.orientation(rows, found).select("tile_id", *[scaled(F.col(c), 1.0).alias(c) for c in ("var_e", "var_n", "cov_en")], scaled(F.col("angle_from_east")).alias("angle_m"))


# ---------------------------------------------------------------- raster


@query(f"WITH {_PIXELS} SELECT tile_id, way_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM area GROUP BY 1, 2")
def polygon_fill(spark, d):
    return raster.span_sums(raster.area_spans(_pixelised(spark, d).filter("is_area"), GRID))


@query(f"WITH {_LINES} SELECT tile_id, way_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM line GROUP BY 1, 2")
def buffered_polyline(spark, d):
    return raster.span_sums(raster.line_spans(_pixelised(spark, d).filter("not is_area"), GRID))


@query(f"WITH {_MASK} SELECT tile_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(class AS INTEGER) AS class FROM painted")
def paint_mask(spark, d):
    return raster.build_mask(_overlay(spark, d), view(spark, d, "tiles"), GRID)


@query(f"WITH {_MASK} SELECT tile_id, CAST(class AS INTEGER) AS class, count(*) AS n FROM full_grid GROUP BY 1, 2")
def mask_dense(spark, d):
    return _dense(spark, d).groupBy("tile_id", "class").agg(F.count("*").alias("n"))


@query(f"WITH {_MASK} SELECT tile_id, start, len, CAST(class AS INTEGER) AS class FROM runs")
def mask_rle_encode(spark, d):
    return _runs(spark, d)


@query(
    f"""WITH {_FULL_MASK}, cut AS (SELECT tile_id, start + k*{raster.LONGEST_RUN} AS start, least({raster.LONGEST_RUN}, len - k*{raster.LONGEST_RUN}) AS len, class FROM
  (SELECT *, unnest(generate_series(0, (len - 1)//{raster.LONGEST_RUN})) AS k FROM runs))
SELECT tile_id, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len, CAST(class AS INTEGER) AS class FROM cut"""
)
def mask_rle_encode_full_grid(spark, d):
    return _runs(spark, d, FULL_GRID)


@query(f"WITH {_MASK} SELECT tile_id, CAST(y AS INTEGER) AS y, count(*) AS n, CAST(sum(x*class) AS BIGINT) AS check_sum FROM full_grid GROUP BY 1, 2")
def mask_rle_decode(spark, d):
    back = raster.expand_runs(_runs(spark, d), GRID)
    return back.groupBy("tile_id", "y").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("class")).alias("check_sum"))


_BOXQ = ", ".join(f"round({c}*1e7)*1e-7 AS {c}" for c in ("lon_min", "lon_max", "lat_min", "lat_max"))


@query(
    f"""WITH {_MASK}, {ctes('points')}, {_TILED}, q AS (SELECT tile_id, round(ex*1e3)/1e3 AS qx, round(ey*1e3)/1e3 AS qy, round(ez*1e3)/1e3 AS qz FROM tiled),
gq AS (SELECT * FROM {geodetic_sql('q', 'qx', 'qy', 'qz')}), bx AS (SELECT tile_id, {_BOXQ} FROM tiles JOIN withov USING (tile_id)),
ix AS (SELECT gq.tile_id, CAST(round(greatest(least((glon - lon_min)/(lon_max - lon_min + 1e-12), 1e0), 0e0)*{GRID - 1}e0) AS INTEGER) AS x, CAST(round(greatest(least((glat - lat_min)/(lat_max - lat_min + 1e-12), 1e0), 0e0)*{GRID - 1}e0) AS INTEGER) AS y FROM gq LEFT JOIN bx USING (tile_id))
SELECT tile_id, CAST(coalesce(p.class, 0) AS INTEGER) AS label, count(*) AS n FROM ix LEFT JOIN painted p USING (tile_id, y, x) GROUP BY 1, 2"""
)
def label_points(spark, d):
    rows = _tiled(spark, d).select("tile_id", *[fixed.dequantise(fixed.quantise(F.col(f"e{a}"), 1000), 1000).alias(f"e{a}") for a in "xyz"], F.lit(None).cast("int").alias("label"))
    mask, with_overlay = _mask(spark, d)
    covered = view(spark, d, "tiles").join(with_overlay, "tile_id", "left_semi")
    box = covered.select("tile_id", *[fixed.q7(F.col(c)).alias(f"{c}_q7") for c in ("lon_min", "lon_max", "lat_min", "lat_max")])
    return cloud.label_points(rows, mask, box, GRID).groupBy("tile_id", "label").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_MASK}, {ctes('points')}, {_TILED}, q AS (SELECT tile_id, l_partkey, round(ex*1e3)/1e3 AS qx, round(ey*1e3)/1e3 AS qy, round(ez*1e3)/1e3 AS qz FROM tiled),
gq AS (SELECT * FROM {geodetic_sql('q', 'qx', 'qy', 'qz')}), bx AS (SELECT tile_id, round(lon_min*1e7)*1e-7 AS lon_min, round((lon_min + 1e-2)*1e7)*1e-7 AS lon_max, round(lat_min*1e7)*1e-7 AS lat_min, round(lat_max*1e7)*1e-7 AS lat_max FROM tiles JOIN withov USING (tile_id) WHERE tile_id % 7 <> 3),
uv AS (SELECT gq.tile_id, l_partkey, (glon - lon_min)/(lon_max - lon_min + 1e-12) AS u, (glat - lat_min)/(lat_max - lat_min + 1e-12) AS v FROM gq LEFT JOIN bx USING (tile_id)),
ix AS (SELECT tile_id, l_partkey, CASE WHEN u BETWEEN 0e0 AND 1e0 THEN CAST(round(u*{GRID - 1}e0) AS INTEGER) END AS x, CASE WHEN v BETWEEN 0e0 AND 1e0 THEN CAST(round(v*{GRID - 1}e0) AS INTEGER) END AS y FROM uv)
SELECT tile_id, CAST(CASE WHEN tile_id % 5 = 0 THEN l_partkey % 10 ELSE coalesce(p.class, 0) END AS INTEGER) AS label, count(*) AS n FROM ix LEFT JOIN painted p USING (tile_id, y, x) GROUP BY 1, 2"""
)
def label_precedence(spark, d):
    """Own labels come before a mask's class, tiles without a usable mask get 0, as does what lies outside."""
    own = F.when(F.col("tile_id") % 5 == 0, (F.col("l_partkey") % 10).cast("int"))
    rows = _tiled(spark, d).select("tile_id", *[fixed.dequantise(fixed.quantise(F.col(f"e{a}"), 1000), 1000).alias(f"e{a}") for a in "xyz"], own.alias("label"))
    mask, with_overlay = _mask(spark, d)
    covered = view(spark, d, "tiles").filter("tile_id % 7 <> 3").join(with_overlay, "tile_id", "left_semi")
    box = covered.withColumn("lon_max", F.col("lon_min") + 0.01).select("tile_id", *[fixed.q7(F.col(c)).alias(f"{c}_q7") for c in ("lon_min", "lon_max", "lat_min", "lat_max")])
    return cloud.label_points(rows, mask, box, GRID, mode="zero").groupBy("tile_id", "label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- files written and read back


@query(
    f"""WITH {_BOXED}, {anchored_sql(1000)} SELECT CAST(tile_id AS VARCHAR) AS name, count(*) AS n, min(upm) AS upm, min(ax) AS ax, min(ay) AS ay, min(az) AS az, {', '.join(f'CAST(sum(d{a}) AS BIGINT) AS sum_d{a}' for a in 'xyz')},
  CAST(sum(CASE WHEN tile_id % 2 = 0 THEN label ELSE 0 END) AS BIGINT) AS labels, concat('tile_', CAST(tile_id AS VARCHAR)) AS shown,
  {', '.join(f'CAST(round({f}({c})*1e7) AS INTEGER) AS {c}_{f}' for c in ('lon', 'lat') for f in ('min', 'max'))} FROM offs GROUP BY tile_id"""
)
def tile_codec_roundtrip(spark, d):
    """Quantised tiles as binary files, every second with labels, written and read back."""
    folder = _written_tiles(spark, d)
    sums = codec.read_points(spark, folder, strict=True).groupBy("path").agg(F.count("*").alias("n"), F.min("units_per_metre").alias("upm"), *[F.min(f"a{a}").alias(f"a{a}") for a in "xyz"], *[F.sum(f"d{a}").alias(f"sum_d{a}") for a in "xyz"], F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("labels"))
    heads = codec.read_headers(spark, folder, strict=True).select("path", names.key_text(F.col("tile_key")).alias("shown"), *[F.col(f"extent.{c}_{n}").alias(f"{c}_{n}") for c in ("lon", "lat") for n in ("min", "max")])
    return sums.join(heads, "path").withColumn("path", names.stem(F.col("path"))).withColumnRenamed("path", "name")


def _written_tiles(spark, d) -> str:
    tiled = _tiled(spark, d)
    name, labelled = F.col("tile_id").cast("string"), F.col("tile_id") % 2 == 0
    empty = F.lit(None).cast("struct<width:int,height:int,coord_space:smallint,encoding:smallint,palette:array<struct<class:smallint,precedence:smallint>>,data:binary>")
    folder = files.fresh_folder(spark, "tiles")
    with files.Scratch(spark) as scratch:
        found = scratch.stored(tiling.anchors(tiled, "tile_id", 1000), "anchors")
        ends = tiling.extents(tiled, "tile_id").select("tile_id", F.struct(*[F.col(f"{c}_{n}_q7").alias(f"{c}_{n}") for c in ("lon", "lat") for n in ("min", "max")]).alias("extent"))
        tiles = found.join(ends, "tile_id").select(name.alias("prefix"), "n", F.col("upm").alias("units_per_metre"), "ax", "ay", "az", names.tile_key(F.concat(F.lit("tile_"), name)).alias("tile_key"), labelled.alias("labelled"), "extent", empty.alias("mask"))
        points = tiling.offsets(tiled, found, "tile_id").select(name.alias("prefix"), labelled.alias("labelled"), "dx", "dy", "dz", "label")
        sinks.write_points(tiles, points, folder, overwrite=True)
    return folder


@query(ORACLES["dataset_stats"])
def tile_header_stats(spark, d):
    """Statistics of the set from tile files' headers: their points are not read."""
    return _stats_row(cloud.dataset_stats(load.summary(spark, _written_tiles(spark, d))))


@query(ORACLES["dataset_stats"])
def streamed_stats(spark, d):
    """The same, kept up to date by a stream of tile files in several micro-batches."""
    kept, checkpoint = (files.fresh_folder(spark, n) for n in ("headers", "progress"))
    ingest.keep_headers(spark, _written_tiles(spark, d), kept, checkpoint, files_per_batch=10).awaitTermination()
    return _stats_row(ingest.running_stats(spark, kept))


@query(f"WITH {ctes('tiles')} SELECT prefix, {', '.join(f'CAST(round({c}*1e7) AS INTEGER) AS {c}' for c in ('lon_min', 'lat_min', 'lon_max', 'lat_max'))} FROM tiles")
def feature_index(spark, d):
    """The index of the tiles' boxes, written as one feature collection and scanned."""
    folder = files.fresh_folder(spark, "index")
    samples.write_index(view(spark, d, "tiles"), folder)
    return features.read_index(spark, folder).select("prefix", *[fixed.q7(F.col(c)).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])


def _mesh_lines(spark, d) -> DataFrame:
    name = F.concat(F.lit("mesh_"), "file_id", F.when(F.col("file_id") % 2 == 0, ".zip").otherwise(".obj"))
    return view(spark, d, "obj_lines").select(name.alias("file"), "line_no", "line")


@query(
    f"""WITH {ctes('obj_lines')}, p AS (SELECT line_no, file_id, regexp_split_to_array(trim(line), '\\s+') AS f FROM obj_lines WHERE starts_with(trim(line), 'v ')),
v AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS vid FROM p WHERE isfinite(CAST(f[2] AS DOUBLE)))
SELECT concat('mesh_', CAST(file_id AS VARCHAR)) AS stem, vid, {', '.join(f"{big(f'CAST(f[{i}] AS DOUBLE)*1e3')} AS {c}_m" for i, c in ((2, 'x'), (3, 'y'), (4, 'z')))} FROM v"""
)
def mesh_files(spark, d):
    """Meshes as text and in archives, found in their folder and scanned."""
    folder = files.fresh_folder(spark, "meshes")
    samples.write_meshes(_mesh_lines(spark, d), folder)
    return obj.read_vertices(spark, folder).select(names.stem(F.col("path")).alias("stem"), "vid", *[scaled(F.col(c)).alias(f"{c}_m") for c in "xyz"])


_TAGS = ("building", "highway", "lanes", "width", "natural_tag", "waterway", "landuse", "leisure", "railway", "amenity")


def _written_map(spark, d) -> str:
    folder = files.fresh_folder(spark, "map")
    tags = F.map_filter(F.create_map(*[x for t in _TAGS for x in (F.lit(t.removesuffix("_tag")), F.col(t))]), lambda k, v: v.isNotNull())
    refs = view(spark, d, "way_refs").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("r"))
    ways = view(spark, d, "osm_ways").select("way_id", tags.alias("tags")).join(refs, "way_id", "left")
    samples.write_map(view(spark, d, "osm_nodes"), ways.select("way_id", "tags", F.coalesce("r.node_id", F.array().cast("array<long>")).alias("refs")), folder)
    return folder


@query(f"WITH {ctes('osm_nodes')} SELECT node_id, {big('lon*1e7')} AS lon_q7, {big('lat*1e7')} AS lat_q7 FROM osm_nodes")
def map_nodes(spark, d):
    """Nodes of a map extract, decoded from its blocks."""
    return pbf.read_nodes(spark, _written_map(spark, d)).select("node_id", scaled(F.col("lon"), 1e7).alias("lon_q7"), scaled(F.col("lat"), 1e7).alias("lat_q7"))


@query(
    f"""WITH {ctes('osm_ways', 'way_refs')}, r AS (SELECT way_id, count(*) AS refs, CAST(sum(k*node_id) AS BIGINT) AS check_sum FROM (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY seq) AS k FROM way_refs) GROUP BY 1)
SELECT way_id, row_number() OVER (ORDER BY way_id) AS place, CAST({' + '.join(f'CASE WHEN {t} IS NULL THEN 0 ELSE 1 END' for t in _TAGS)} AS INTEGER) AS tags, building, highway, width, coalesce(refs, 0) AS refs, coalesce(check_sum, 0) AS check_sum FROM osm_ways LEFT JOIN r USING (way_id)"""
)
def map_ways(spark, d):
    """Ways of a map extract with tags and references; ``place`` is their order in the files."""
    ways = pbf.read_ways(spark, _written_map(spark, d))
    before = ways.groupBy(F.shiftright("seq", 24).alias("block")).agg(F.count("*").alias("n"))
    before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for each block
    total = F.aggregate(F.transform("refs", lambda r, i: r * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    tag = [F.try_element_at("tags", F.lit(t)).alias(t) for t in ("building", "highway", "width")]
    place = F.col("before") + F.col("seq").bitwiseAND((1 << 24) - 1) + 1
    return ways.join(before, F.shiftright("seq", 24) == F.col("block")).select("way_id", place.alias("place"), F.size("tags").alias("tags"), *tag, F.size("refs").cast("long").alias("refs"), total.alias("check_sum"))


_PLACES = "(l_partkey*7919) % 65536 AS qx, (l_suppkey*104729) % 65536 AS qy, (l_linenumber*9973 + l_orderkey) % 65536 AS qz"


@query(
    f"""WITH p AS (SELECT l_orderkey % 25 AS tile_id, {_PLACES} FROM lineitem)
SELECT concat('old_', CAST(tile_id AS VARCHAR)) AS name, count(*) AS n, CAST(sum({big('(tile_id*1e1 + qx*(1e2/65535e0))*1e3')}) AS BIGINT) AS sum_x, CAST(sum({big('(tile_id*2e1 + 5e-1 + qy*(5e1/65535e0))*1e3')}) AS BIGINT) AS sum_y, CAST(sum({big('(-tile_id*1e0 + qz*(25e0/65535e0))*1e3')}) AS BIGINT) AS sum_z FROM p GROUP BY tile_id"""
)
def old_layout(spark, d):
    """Files in the older layout, written and scanned."""
    rows = spark.sql(f"SELECT l_orderkey % 25 AS t, {_PLACES} FROM {{lineitem}}", lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    t = F.col("t").cast("double")
    low = F.array(t * 10, t * 20 + 0.5, -t)
    high = F.array(t * 10 + 100, t * 20 + 50.5, 25 - t)
    made = rows.select(F.concat(F.lit("old_"), "t", F.lit(".bin")).alias("file"), low.alias("low"), high.alias("high"), "qx", "qy", "qz")
    folder = files.fresh_folder(spark, "old")
    samples.write_old_tiles(made, folder)
    points = codec.read_old_points(spark, folder).select(names.stem(F.col("path")).alias("name"), "x", "y", "z")
    return points.groupBy("name").agg(F.count("*").alias("n"), *[F.sum(scaled(F.col(c))).alias(f"sum_{c}") for c in "xyz"])


@query(
    f"""WITH {ctes('obj_lines')}, p AS (SELECT file_id, regexp_split_to_array(trim(line), '\\s+') AS f FROM obj_lines WHERE starts_with(trim(line), 'v '))
SELECT concat('mesh_', CAST(file_id AS VARCHAR)) AS name, count(*) AS n, 1000 AS upm, {', '.join(f"CAST(sum({big(f'CAST(f[{i}] AS DOUBLE)*1e3')}) AS BIGINT) AS sum_{c}" for i, c in ((2, 'x'), (3, 'y'), (4, 'z')))}, false AS has_extent, false AS has_mask FROM p WHERE isfinite(CAST(f[2] AS DOUBLE)) GROUP BY file_id"""
)
def conversion_forced_system(spark, d):
    """A conversion of every mesh in a folder, without index or map, whose system is given, not detected."""
    folder = files.fresh_folder(spark, "forced")
    samples.write_meshes(_mesh_lines(spark, d), f"{folder}/in")
    convert.convert(spark, f"{folder}/in", f"{folder}/out", options=convert.Options(system="ecef")).write.format("noop").mode("overwrite").save()
    back = codec.read_tiles(spark, f"{folder}/out", strict=True).withColumn("name", names.stem(F.col("path")))
    sums = codec.points_of(back, "name").groupBy("name").agg(F.count("*").alias("n"), F.min("units_per_metre").cast("int").alias("upm"), *[F.sum(F.col(f"a{c}") + F.col(f"d{c}")).alias(f"sum_{c}") for c in "xyz"])
    return sums.join(back.select("name", F.col("extent").isNotNull().alias("has_extent"), F.col("mask").isNotNull().alias("has_mask")), "name")


@query(
    f"""WITH {_MASK}, {ctes('points')}, {_TILED}, q AS (SELECT tile_id, round(ex*1e3)/1e3 AS qx, round(ey*1e3)/1e3 AS qy, round(ez*1e3)/1e3 AS qz FROM tiled),
gq AS (SELECT * FROM {geodetic_sql('q', 'qx', 'qy', 'qz')}), bx AS (SELECT tile_id, {_BOXQ} FROM tiles JOIN withov USING (tile_id)),
ix AS (SELECT gq.tile_id, CAST(round(greatest(least((glon - lon_min)/(lon_max - lon_min + 1e-12), 1e0), 0e0)*{GRID - 1}e0) AS INTEGER) AS x, CAST(round(greatest(least((glat - lat_min)/(lat_max - lat_min + 1e-12), 1e0), 0e0)*{GRID - 1}e0) AS INTEGER) AS y FROM gq LEFT JOIN bx USING (tile_id))
SELECT concat('tile_', CAST(tile_id AS VARCHAR)) AS name, CAST(coalesce(p.class, 0) AS INTEGER) AS label, count(*) AS n FROM ix LEFT JOIN painted p USING (tile_id, y, x) GROUP BY tile_id, 2"""
)
def conversion_labels(spark, d):
    """Meshes, index and map converted to masked tiles, which are loaded and label their points."""
    folder = files.fresh_folder(spark, "conversion")
    tile = F.col("tile_id")
    line = F.concat_ws(" ", F.lit("v"), "lon", "lat", "h_m")
    lines = _tiled(spark, d).select(F.concat(F.lit("tile_"), tile, F.when(tile % 2 == 0, ".zip").otherwise(".obj")).alias("file"), F.col("l_orderkey").alias("line_no"), line.alias("line"))
    samples.write_meshes(lines, f"{folder}/in")
    samples.write_index(view(spark, d, "tiles"), f"{folder}/index")
    made = convert.convert(spark, f"{folder}/in", f"{folder}/out", f"{folder}/index", _written_map(spark, d), convert.Options(grid=GRID))
    made.write.format("noop").mode("overwrite").save()
    points, _ = load.load(spark, f"{folder}/out")
    # a file's name is taken from its path once, not for each point
    counts = points.groupBy("path", "label").agg(F.count("*").alias("n"))
    return counts.groupBy(names.stem(F.col("path")).alias("name"), "label").agg(F.sum("n").alias("n"))


@query(f"WITH {ctes('points')} SELECT 'points' AS step, count(*) AS items, {', '.join(f'{big(f"{f}({c})*1e3")} AS {f}_{c}' for c in ('ex', 'ey', 'ez', 'h_m') for f in ('min', 'max'))} FROM {ECEF.format(src='points')}")
def value_ranges(spark, d):
    """Rows and ranges of values, observed while the points are written elsewhere."""
    step = progress.Progress("points")
    step.watch(_points(spark, d), "ex", "ey", "ez", "h_m").write.format("noop").mode("overwrite").save()
    return step.metrics(spark).select("step", "items", *[scaled(F.col(f"{f}_{c}")).alias(f"{f}_{c}") for c in ("ex", "ey", "ez", "h_m") for f in ("min", "max")])


_THREE = f"""SELECT l_orderkey % 25 AS tile_id, {K}, CASE l_orderkey % 3 WHEN 0 THEN lon WHEN 1 THEN (l_partkey*7 % 1301)*1e0 ELSE 6371e3 + l_partkey % 997 END AS x,
  CASE l_orderkey % 3 WHEN 0 THEN lat WHEN 1 THEN (l_suppkey*13 % 1103)*1e0 ELSE l_suppkey*1e0 END AS y, CAST(h_m AS DOUBLE) AS z, l_orderkey % 3 AS kind FROM {{points}}"""


@query(
    f"""WITH {ctes('tiles', 'points')}, v AS ({_THREE.format(points='points')}), o AS (SELECT tile_id, (min(x) + max(x))/2 AS e0, (min(y) + max(y))/2 AS n0 FROM v WHERE kind = 1 GROUP BY 1),
c AS (SELECT v.*, x - e0 AS xe, y - n0 AS yn, 5e-1*(lat_min + lat_max) AS lat, 5e-1*(lon_min + lon_max) AS lon FROM v JOIN o USING (tile_id) JOIN tiles USING (tile_id) WHERE kind = 1),
r AS (SELECT *, 1e0 - {num(geo.E2)}*{_S2} AS ww FROM c),
deg AS (SELECT tile_id, kind, lat + degrees(yn/({num(geo.A * (1 - geo.E2))}/(ww*sqrt(ww)))) AS lat, lon + degrees(xe/({num(geo.A)}/sqrt(ww)*cos(radians(lat)))) AS lon, z AS h_m FROM r UNION ALL SELECT tile_id, kind, y, x, z FROM v WHERE kind = 0),
every AS (SELECT tile_id, kind, ex, ey, ez FROM {ECEF.format(src='deg')} UNION ALL SELECT tile_id, kind, x, y, z FROM v WHERE kind = 2)
SELECT tile_id, kind, count(*) AS n, {', '.join(f'CAST(sum({big(f"e{a}*1e2")}) AS BIGINT) AS sum_{a}_cm' for a in 'xyz')} FROM every GROUP BY 1, 2"""
)
def dispatch_to_ecef(spark, d):
    """Vertices in the three systems, each file in one that is given, become Earth-centred."""
    v = spark.sql(_THREE.format(points="{points}"), points=view(spark, d, "points"))
    v = v.withColumn("file", F.concat_ws("/", "tile_id", "kind")).withColumn("vid", F.lit(0))
    systems = v.select("file", F.when(F.col("kind") == 0, "geodetic").when(F.col("kind") == 1, "local_m").otherwise("ecef").alias("cs")).distinct()
    boxes = v.select("file", "tile_id").distinct().join(view(spark, d, "tiles"), "tile_id").select("file", "lon_min", "lat_min", "lon_max", "lat_max")
    out = tiling.to_ecef(v.select("file", "vid", "x", "y", "z"), systems, boxes, "file")
    part = F.split("file", "/")
    return out.groupBy("file").agg(F.count("*").alias("n"), *[F.sum(scaled(F.col(f"e{a}"), 100)).alias(f"sum_{a}_cm") for a in "xyz"]).select(part[0].cast("bigint").alias("tile_id"), part[1].cast("bigint").alias("kind"), "n", *[f"sum_{a}_cm" for a in "xyz"])


@query(
    f"""WITH {ctes('tiles', 'points')}, {_TILED}, g AS (SELECT tile_id, min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM tiled WHERE tile_id % 4 <> 1 GROUP BY 1)
SELECT tile_id, tile_id % 3 <> 0 AS boxed, {', '.join(f'CAST(round(CASE WHEN tile_id % 3 <> 0 THEN {box} ELSE {own} END*1e7) AS INTEGER) AS {box}' for box, own in (('lon_min', 'a'), ('lon_max', 'b'), ('lat_min', 'c'), ('lat_max', 'd')))}
FROM tiles LEFT JOIN g USING (tile_id)"""
)
def extent_source(spark, d):
    """A tile's extent is its box where there is one, else the bounds of its geodetic points, else none."""
    ends = _tiled(spark, d).filter("tile_id % 4 <> 1").groupBy("tile_id").agg(*[f(c).alias(n) for c, f, n in (("lon", F.min, "g0"), ("lon", F.max, "g1"), ("lat", F.min, "g2"), ("lat", F.max, "g3"))])
    t = view(spark, d, "tiles").join(ends, "tile_id", "left")
    sides = ("lon_min", "lon_max", "lat_min", "lat_max")
    box = [F.when(F.col("tile_id") % 3 != 0, F.col(c)) for c in sides]
    return t.select("tile_id", (F.col("tile_id") % 3 != 0).alias("boxed"), tiling.choose_extent(box, [F.col(f"g{i}") for i in range(4)]).alias("e")).select("tile_id", "boxed", *[F.col(f"e.{c}").alias(c) for c in sides])


# ---------------------------------------------------------------- views of a cloud

_P, _M = CAMERA.position(), CAMERA.matrix(VIEWPORT[0] / VIEWPORT[1])


_LENS = render.NEAR * render.FAR / (render.NEAR - render.FAR)
def _eye_sql(cameras: str) -> str:
    """Cameras (step, radius, az, el, phi, lam) with where they stand and their axes."""
    return f"""cam AS ({cameras}),
targ AS (SELECT *, {num(geo.A)}/sqrt(1 - {num(geo.E2)}*sin(phi)*sin(phi)) AS nn FROM cam),
tgt AS (SELECT *, nn*cos(phi)*cos(lam) AS tx, nn*cos(phi)*sin(lam) AS ty, nn*(1 - {num(geo.E2)})*sin(phi) AS tz, radius*cos(el)*sin(az) AS oe, radius*cos(el)*cos(az) AS os, radius*sin(el) AS ou FROM targ),
eye AS (SELECT step, tx, ty, tz, tx - sin(lam)*oe - sin(phi)*cos(lam)*os + cos(phi)*cos(lam)*ou AS px, ty + cos(lam)*oe - sin(phi)*sin(lam)*os + cos(phi)*sin(lam)*ou AS py, tz + cos(phi)*os + sin(phi)*ou AS pz FROM tgt),
lookat AS (SELECT g.* EXCLUDE (phi), sqrt(pow(tx - px, 2) + pow(ty - py, 2) + pow(tz - pz, 2)) AS far, cos(phi)*cos(radians(glon)) AS ux, cos(phi)*sin(radians(glon)) AS uy, sin(phi) AS uz FROM {geodetic_sql('eye', 'px', 'py', 'pz')} g),
fwd AS (SELECT *, (tx - px)/far AS fx, (ty - py)/far AS fy, (tz - pz)/far AS fz FROM lookat),
sid AS (SELECT *, fy*uz - fz*uy AS ax, fz*ux - fx*uz AS ay, fx*uy - fy*ux AS az FROM fwd),
side AS (SELECT *, ax/sqrt(ax*ax + ay*ay + az*az) AS sx, ay/sqrt(ax*ax + ay*ay + az*az) AS sy, az/sqrt(ax*ax + ay*ay + az*az) AS sz FROM sid)"""


_EYE = _eye_sql(
    """SELECT *, CASE step WHEN 1 THEN 6e3*pow(11e-1, -3e0) WHEN 2 THEN 1e1 WHEN 3 THEN 1e6 ELSE 6e3 END AS radius, CASE WHEN step = 4 THEN pi() - 40*5e-3 ELSE pi() END AS az,
  CASE step WHEN 4 THEN pi()/6 + 25*5e-3 WHEN 5 THEN radians(89) WHEN 6 THEN radians(1) ELSE pi()/6 END AS el, radians(5251e-2) AS phi, radians(1339e-2) AS lam FROM (SELECT unnest(generate_series(0, 6)) AS step)"""
)
_CAMERAS = "SELECT n_nationkey AS step, n_nationkey AS tile_id, 5246e-2 + floor(n_nationkey/5e0)*2e-2 + 1e-2 AS lat, 1334e-2 + (n_nationkey % 5)*2e-2 + 1e-2 AS lon, n_nationkey - 12 AS zoom, n_nationkey*31 - 300 AS dx, n_nationkey*13 - 150 AS dy FROM {nation}"
_VIEWS = _eye_sql(
    f"""SELECT step, tile_id, greatest(least(5e3*pow(11e-1, -CAST(zoom AS DOUBLE)), 1e6), 1e1) AS radius, pi() - dx*5e-3 AS az, greatest(least(pi()/6 + dy*5e-3, radians(89)), radians(1)) AS el, radians(lat) AS phi, radians(lon) AS lam FROM ({_CAMERAS.format(nation='nation')})"""
)
_VIEW_ROWS = {
    "x": [f"(-s{c}/tan(radians(30))*{VIEWPORT[1]}e0/{VIEWPORT[0]}e0)" for c in "xyz"],
    "y": [f"(-({e})/tan(radians(30)))" for e in ("sy*fz - sz*fy", "sz*fx - sx*fz", "sx*fy - sy*fx")],
    "z": [f"(5e-1*(1e0 - {num(render.FAR)}/({num(render.NEAR)} - {num(render.FAR)}))*f{c})" for c in "xyz"],
    "w": [f"f{c}" for c in "xyz"],
}


def _cameras(spark, d) -> DataFrame:
    """A camera above each tile, zoomed and dragged differently."""
    rows = spark.sql(_CAMERAS, nation=spark.read.parquet(f"{d}/nation.parquet"))
    azimuth, elevation = render.dragged(F.lit(math.pi), F.lit(math.pi / 6), F.col("dx"), F.col("dy"))
    rows = rows.withColumns({"radius": render.zoomed(F.lit(5000.0), F.col("zoom")), "azimuth": azimuth, "elevation": elevation})
    return render.looking(render.orbiting(rows), VIEWPORT[0] / VIEWPORT[1])


@query(
    f"""WITH {_VIEWS} SELECT step AS tile_id, {', '.join(f"{big(f'{c}*1e3')} AS {c}_mm" for c in ('px', 'py', 'pz'))},
  {', '.join(f"{big(f'{e}*1e6')} AS {n}_{c}" for n, row in _VIEW_ROWS.items() for c, e in zip('xyz', row, strict=True))} FROM side"""
)
def camera_table(spark, d):
    """Where the cameras of a table stand after zooming and dragging, and the rows of their clip matrices."""
    rows = _cameras(spark, d)
    return rows.select("tile_id", *[scaled(F.col(f"eye.{a}")).alias(f"p{a}_mm") for a in "xyz"], *[scaled(F.col(f"view.{n}.{a}"), 1e6).alias(f"{n}_{a}") for n in _VIEW_ROWS for a in "xyz"])


@query(
    f"""WITH {_VIEWS}, {ctes('points')}, c AS (SELECT v.step AS tile_id, {', '.join(f"(ex - px)*{r[0]} + (ey - py)*{r[1]} + (ez - pz)*{r[2]}{f' + 5e-1*{num(_LENS)}' if n == 'z' else ''} AS c{n}" for n, r in _VIEW_ROWS.items())} FROM {ECEF.format(src='points')} p JOIN side v ON v.step = p.l_orderkey % 25),
f AS (SELECT *, CAST(floor((cx/cw + 1e0)*5e-1*{VIEWPORT[0]}) AS INTEGER) AS x, CAST(floor((1e0 - cy/cw)*5e-1*{VIEWPORT[1]}) AS INTEGER) AS y, greatest(least(cz/cw, 1e0), 0e0) AS z FROM c WHERE cw > 0)
SELECT tile_id, y, x, count(*) AS n, {big('min(z)*1e7')} AS z_q7 FROM f WHERE x BETWEEN 0 AND {VIEWPORT[0] - 1} AND y BETWEEN 0 AND {VIEWPORT[1] - 1} GROUP BY 1, 2, 3"""
)
def camera_table_views(spark, d):
    """Every point in the view of one of the table's cameras: pixels, how many points, the nearest depth."""
    points = _points(spark, d).select((F.col("l_orderkey") % 25).alias("tile_id"), "ex", "ey", "ez")
    found = render.seen(points, _cameras(spark, d), "tile_id", *VIEWPORT)
    return found.groupBy("tile_id", "y", "x").agg(F.count("*").alias("n"), scaled(F.min("z"), 1e7).alias("z_q7"))


@query(
    f"""WITH {_EYE}
SELECT CAST(step AS BIGINT) AS step, {', '.join(f"{big(f'{c}*1e3')} AS {c}_mm" for c in ('px', 'py', 'pz'))},
  {', '.join(f"{big(f'-s{c}/tan(radians(30))*{VIEWPORT[1]}e0/{VIEWPORT[0]}e0*1e6')} AS right_{c}" for c in 'xyz')},
  {', '.join(f"{big(f'-({e})/tan(radians(30))*1e6')} AS up_{c}" for c, e in (('x', 'sy*fz - sz*fy'), ('y', 'sz*fx - sx*fz'), ('z', 'sx*fy - sy*fx')))},
  {', '.join(f"{big(f'5e-1*(1e0 - {num(render.FAR)}/({num(render.NEAR)} - {num(render.FAR)}))*f{c}*1e6')} AS depth_{c}" for c in 'xyz')}, {big(f'5e-1*{num(_LENS)}*1e6')} AS depth_w,
  {', '.join(f"{big(f'f{c}*1e6')} AS ahead_{c}" for c in 'xyz')} FROM side"""
)
def camera_frames(spark, d):
    """Where the camera stands and its clip matrix: at first, zoomed, at both limits, and dragged."""
    steps = [CAMERA, CAMERA.zoomed(3), CAMERA.zoomed(1000), CAMERA.zoomed(-1000), CAMERA.dragged(40, 25), CAMERA.dragged(0, 1e6), CAMERA.dragged(0, -1e6)]
    rows = []
    for k, c in enumerate(steps):
        m = c.matrix(VIEWPORT[0] / VIEWPORT[1])
        rows.append((k, *c.position(), *m[0][:3], *m[1][:3], *m[2], *m[3][:3]))
    axes = [f"{n}_{c}" for n in ("right", "up", "depth", "ahead") for c in ("xyzw" if n == "depth" else "xyz")]
    found = spark.createDataFrame(rows, ["step", "px", "py", "pz", *axes])
    return found.select("step", *[scaled(F.col(c)).alias(f"{c}_mm") for c in ("px", "py", "pz")], *[scaled(F.col(c), 1e6).alias(c) for c in axes])


@query(
    f"""WITH {_BOXED}, {anchored_sql(1000)}, m AS (SELECT tile_id, {', '.join(f'a{c}/CAST(upm AS DOUBLE) - p{c} AS v{c}' for c in 'xyz')} FROM anch, (SELECT {', '.join(f'{num(v)} AS p{c}' for c, v in zip('xyz', _P, strict=True))}))
SELECT tile_id, {', '.join(f"{big(f'CAST(CAST(v{c} AS FLOAT) AS DOUBLE)*1e6')} AS high_{c}, {big(f'CAST(CAST(v{c} - CAST(CAST(v{c} AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE)*1e9')} AS low_{c}" for c in 'xyz')} FROM m"""
)
def tile_deltas(spark, d):
    """Anchors relative to the camera as pairs of floats."""
    found = render.tile_deltas(_anchored(spark, d)[0], CAMERA)
    return found.select("tile_id", *[scaled(F.col(f"{n}_{c}").cast("double"), by).alias(f"{n}_{c}") for c in "xyz" for n, by in (("high", 1e6), ("low", 1e9))])


def _clip(i: int) -> str:
    return f"(ex - {num(_P[0])})*{num(_M[i][0])} + (ey - {num(_P[1])})*{num(_M[i][1])} + (ez - {num(_P[2])})*{num(_M[i][2])} + {num(_M[i][3])}"


@query(
    f"""WITH {ctes('points')}, c AS (SELECT {K}, label, {', '.join(f'{_clip(i)} AS c{n}' for i, n in enumerate('xyzw'))} FROM {ECEF.format(src='points')}),
f AS (SELECT *, CAST(floor((cx/cw + 1e0)*5e-1*{VIEWPORT[0]}) AS INTEGER) AS x, CAST(floor((1e0 - cy/cw)*5e-1*{VIEWPORT[1]}) AS INTEGER) AS y, greatest(least(cz/cw, 1e0), 0e0) AS z FROM c WHERE cw > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY z, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM f WHERE x BETWEEN 0 AND {VIEWPORT[0] - 1} AND y BETWEEN 0 AND {VIEWPORT[1] - 1})
SELECT y, x, {big('z*1e7')} AS z_q7, label FROM k WHERE k = 1"""
)
def camera_cull_depth(spark, d):
    px = render.depth_resolve(render.fragments(_points(spark, d), CAMERA, *VIEWPORT), KEYS)
    return px.select("y", "x", scaled(F.col("z"), 1e7).alias("z_q7"), "label")


_SOLID = "tag >= 5e-1 AND z < 9999e-4"


@query(
    f"""WITH {_SCREEN_SQL}, s AS (SELECT a.y, a.x, sum(greatest(ln(n.z + 1e-6) - ln(a.z + 1e-6), 0e0)) AS s FROM (SELECT * FROM pix WHERE {_SOLID}) a JOIN (SELECT * FROM pix WHERE {_SOLID}) n ON abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 AND (n.x <> a.x OR n.y <> a.y) GROUP BY 1, 2),
o AS (SELECT pix.y, pix.x, CASE WHEN {_SOLID} THEN exp(-14e-1*coalesce(s, 0e0)) ELSE 1e0 END AS k, r, g, b FROM pix LEFT JOIN s USING (y, x)), e AS (SELECT y, x, r*k AS r, g*k AS g, b*k AS b FROM o) {rgb_sql('e')}"""
)
def edl_shade(spark, d):
    return _rgb(render.edl(_screen(spark, d)))


@query(
    f"""WITH {_ALL_SQL}, solid AS (SELECT y, x, z FROM pix WHERE {_SOLID}), step(i) AS (VALUES (-1), (0), (1)),
s AS (SELECT a.y, a.x, sum(greatest(ln(n.z + 1e-6) - ln(a.z + 1e-6), 0e0)) AS s FROM (SELECT solid.*, y + v.i AS ny, x + h.i AS nx FROM solid CROSS JOIN step v CROSS JOIN step h WHERE v.i <> 0 OR h.i <> 0) a JOIN solid n ON n.y = ny AND n.x = nx GROUP BY 1, 2),
o AS (SELECT pix.y, pix.x, CASE WHEN {_SOLID} THEN exp(-14e-1*coalesce(s, 0e0)) ELSE 1e0 END AS k, r, g, b FROM pix LEFT JOIN s USING (y, x)), e AS (SELECT y, x, r*k AS r, g*k AS g, b*k AS b FROM o) {rgb_sql('e')}"""
)
def edl_shade_all(spark, d):
    return _rgb(render.edl(_screen(spark, d, _ALL_FRAG)))


@query(f"WITH {_SCREEN_SQL} {rgb_sql('tinted')}")
def semantic_tint(spark, d):
    return _rgb(render.tint(_screen(spark, d)))


@query(f"WITH {_ALL_SQL} {rgb_sql('tinted')}")
def semantic_tint_all(spark, d):
    return _rgb(render.tint(_screen(spark, d, _ALL_FRAG)))


def _shifted(c: str, size: int, by: float) -> str:
    return f"greatest(least(CAST(floor(({c} + 5e-1) + {num(by * size)}) AS INTEGER), {size - 1}), 0)"


_OX, _OY = 0.03 * 0.16996714290024104, 0.03 * 0.98544972998846014  # of the angle 1.4


def _shift_sql(screen: str, size: tuple[int, int]) -> str:
    return f"""WITH {screen}, s AS (SELECT *, {_shifted('x', size[0], _OX)} AS rx, {_shifted('y', size[1], _OY)} AS ry, {_shifted('x', size[0], -_OX)} AS gx, {_shifted('y', size[1], -_OY)} AS gy FROM tinted),
o AS (SELECT s.y, s.x, CASE WHEN s.tag >= 5e-1 AND s.z < 9999e-4 THEN coalesce(p.r, 0e0) ELSE s.r END AS r, CASE WHEN s.tag >= 5e-1 AND s.z < 9999e-4 THEN coalesce(q.g, 0e0) ELSE s.g END AS g, CASE WHEN s.tag >= 5e-1 AND s.z < 9999e-4 THEN coalesce(q.b, 0e0) ELSE s.b END AS b
  FROM s LEFT JOIN tinted p ON p.x = rx AND p.y = ry LEFT JOIN tinted q ON q.x = gx AND q.y = gy) {rgb_sql('o')}"""


@query(_shift_sql(_SCREEN_SQL, SCREEN))
def rgb_shift(spark, d):
    return _rgb(render.rgb_shift(render.tint(_screen(spark, d)), *SCREEN, amount=0.03))


@query(_shift_sql(_ALL_SQL, WIDE))
def rgb_shift_all(spark, d):
    return _rgb(render.rgb_shift(render.tint(_screen(spark, d, _ALL_FRAG)), *WIDE, amount=0.03))


def _crt_sql(screen: str, size: tuple[int, int]) -> str:
    return f"""WITH {screen}, u AS (SELECT *, (x + 5e-1)/{size[0]} AS u, (y + 5e-1)/{size[1]} AS v FROM tinted),
w AS (SELECT *, 5e-1 + 5e-1*sin(6.28318e0*(v*{size[1]}*5e-1 + 5e-1*12e0)) AS sc, sin((u*2048e0 + 5e-1)*12.9898e0 + (v*2048e0 - 5e-1)*78.233e0)*43758.5453e0 AS raw, greatest(least((sqrt(((u - 5e-1)/11e-1)*((u - 5e-1)/11e-1) + ((v - 5e-1)/95e-2)*((v - 5e-1)/95e-2)) - 6e-1)/4e-1, 1e0), 0e0) AS q FROM u),
g AS (SELECT *, (raw - floor(raw) - 5e-1)*2e-2 AS gr, 1e0 - 8e-1*q*q*(3e0 - 2e0*q) AS vg FROM w),
o AS (SELECT y, x, {', '.join(f'CASE WHEN z >= 9999e-4 OR tag < 5e-1 THEN (1e-2*85e-2 + gr)*(1e0 - sc) ELSE ({c} + gr*4e-1)*(1e0 - 25e-2*sc) END*vg AS {c}' for c in 'rgb')} FROM g) {rgb_sql('o')}"""


@query(_crt_sql(_SCREEN_SQL, SCREEN))
def crt_pass(spark, d):
    return _rgb(render.crt(render.tint(_screen(spark, d)), *SCREEN, time=0.5))


@query(_crt_sql(_ALL_SQL, WIDE))
def crt_pass_all(spark, d):
    return _rgb(render.crt(render.tint(_screen(spark, d, _ALL_FRAG)), *WIDE, time=0.5))


def _chain_sql() -> str:
    """All passes in their order, each from the one before."""
    shift, screen = _shift_sql(_ALL_SQL, WIDE), _crt_sql(_ALL_SQL, WIDE)
    moved = shift[shift.index(", s AS (SELECT *,") + 2 : shift.index(" SELECT y, x,", shift.index("o AS ("))]
    last = screen[screen.index(", u AS (SELECT *,") + 2 :]
    lit = f"""solid AS (SELECT y, x, z FROM pix WHERE {_SOLID}), step(i) AS (VALUES (-1), (0), (1)),
d AS (SELECT a.y, a.x, sum(greatest(ln(n.z + 1e-6) - ln(a.z + 1e-6), 0e0)) AS s FROM (SELECT solid.*, y + v.i AS ny, x + h.i AS nx FROM solid CROSS JOIN step v CROSS JOIN step h WHERE v.i <> 0 OR h.i <> 0) a JOIN solid n ON n.y = ny AND n.x = nx GROUP BY 1, 2),
lit AS (SELECT pix.y, pix.x, z, label, tag, {', '.join(f'{c}*CASE WHEN {_SOLID} THEN exp(-14e-1*coalesce(s, 0e0)) ELSE 1e0 END AS {c}' for c in 'rgb')} FROM pix LEFT JOIN d USING (y, x)),
toned AS (SELECT y, x, z, label, tag, {', '.join(f'CASE WHEN z < 9999e-4 AND label <> 0 THEN {c}*2e-1 + c{c}*8e-1 ELSE {c} END AS {c}' for c in 'rgb')} FROM lit JOIN col ON col.class = lit.label)"""
    moved = moved.replace("FROM tinted", "FROM toned").replace("JOIN tinted", "JOIN toned").replace("SELECT s.y, s.x,", "SELECT s.y, s.x, s.z, s.label, s.tag,").replace("o AS (", "moved AS (")
    return f"WITH {_ALL_SQL}, {lit}, {moved}, {last.replace('FROM tinted', 'FROM moved')}"


@query(_chain_sql())
def post_chain(spark, d):
    """Lighting, class colours, colour shift and screen, one after the other."""
    return _rgb(render.post_chain(_screen(spark, d, _ALL_FRAG), *WIDE, shift=0.03, time=0.5))


def _debug_sql(screen: str) -> str:
    return f"""WITH {screen}, o AS (SELECT 1 AS mode, y, x, 1e0 - greatest(least(z, 1e0), 0e0) AS r, 1e0 - greatest(least(z, 1e0), 0e0) AS g, 1e0 - greatest(least(z, 1e0), 0e0) AS b FROM pix
UNION ALL SELECT 2, y, x, CASE WHEN z >= 9999e-4 THEN 5e-2 ELSE cr END, CASE WHEN z >= 9999e-4 THEN 5e-2 ELSE cg END, CASE WHEN z >= 9999e-4 THEN 5e-2 ELSE cb END FROM pix JOIN col ON class = label
UNION ALL SELECT 3, y, x, tag, tag, tag FROM pix) SELECT mode, y, x, {big('r*1e6')} AS r_u, {big('g*1e6')} AS g_u, {big('b*1e6')} AS b_u FROM o"""


def _debug_views(px: DataFrame) -> DataFrame:
    out = None
    for mode in (1, 2, 3):
        part = _rgb(render.debug_view(px, mode)).select(F.lit(mode).alias("mode"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(_debug_sql(_SCREEN_SQL))
def debug_view(spark, d):
    return _debug_views(_screen(spark, d))


@query(_debug_sql(_ALL_SQL))
def debug_view_all(spark, d):
    return _debug_views(_screen(spark, d, _ALL_FRAG))


_METRES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey*137 % 50021)*1e-1 AS px, (l_suppkey*911 % 30011)*1e-1 AS py, 4e0 AS fx, 6e0 AS fy FROM {lineitem}"


def _line(c: str, f: str, s: float) -> str:
    x = f"greatest(least(least({c}/{num(s)} - floor({c}/{num(s)}), 1e0 - ({c}/{num(s)} - floor({c}/{num(s)})))/least({f}/{num(s)}*15e-1, 5e-1), 1e0), 0e0)"
    return f"(1e0 - {x}*{x}*(3e0 - 2e0*{x}))"


def _ground(s: float) -> str:
    return f"(greatest({_line('px', 'fx', s)}, {_line('py', 'fy', s)})*5e-1 + greatest({_line('px', 'fx', s * 10)}, {_line('py', 'fy', s * 10)})*5e-1)"


@query(f"WITH m AS ({_METRES.format(lineitem='lineitem')}) SELECT {K}, {big(f'({_ground(100.0)}*(1e0 - (log10(4e2) - 2e0)) + {_ground(1000.0)}*(log10(4e2) - 2e0))*1e-1*1e6')} AS opacity_u FROM m")
def ground_grid(spark, d):
    rows = spark.sql(_METRES, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return render.ground_grid(rows, 400.0).select(*KEYS, scaled(F.col("opacity"), 1e6).alias("opacity_u"))


_GROUND = "SELECT DISTINCT CAST((l_partkey*7 + l_suppkey) % 640 AS INTEGER) AS x, CAST((l_orderkey*5 + l_linenumber*11) % 360 AS INTEGER) AS y FROM {lineitem}"
_ON_GROUND = "(x - 3200e-1)*(36e3/(y + 40e0))/64e1 AS px, 36e4/(y + 40e0) + x*1e-2 AS py"


@query(
    f"""WITH p AS (SELECT *, {_ON_GROUND} FROM ({_GROUND.format(lineitem='lineitem')})),
m AS (SELECT p.*, {', '.join(f'coalesce(abs(h.p{c} - p.p{c}), 0e0) + coalesce(abs(v.p{c} - p.p{c}), 0e0) AS f{c}' for c in 'xy')} FROM p LEFT JOIN p h ON h.y = p.y AND h.x = xor(p.x, 1) LEFT JOIN p v ON v.x = p.x AND v.y = xor(p.y, 1))
SELECT y, x, {big('fx*1e3')} AS fx_mm, {big('fy*1e3')} AS fy_mm, {big(f'({_ground(100.0)}*(1e0 - (log10(4e2) - 2e0)) + {_ground(1000.0)}*(log10(4e2) - 2e0))*1e-1*1e6')} AS opacity_u FROM m WHERE fx > 0 AND fy > 0"""
)
def ground_footprints(spark, d):
    """The ground grid on a screen, with pixel footprints from the pixels' own quads."""
    rows = spark.sql(f"SELECT *, {_ON_GROUND} FROM ({_GROUND})", lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    found = render.ground_grid(render.footprints(rows, px="fx", py="fy").filter("fx > 0 and fy > 0"), 400.0)
    return found.select("y", "x", scaled(F.col("fx")).alias("fx_mm"), scaled(F.col("fy")).alias("fy_mm"), scaled(F.col("opacity"), 1e6).alias("opacity_u"))


@query(
    f"""WITH {ctes('points')}, c AS (SELECT {K}, {_clip(0)} AS cx, {_clip(1)} AS cy, {_clip(3)} AS cw FROM {ECEF.format(src='points')}),
q(corner, u, v) AS (VALUES (0, -1e0, -1e0), (1, 1e0, -1e0), (2, 1e0, 1e0), (3, -1e0, -1e0), (4, 1e0, 1e0), (5, -1e0, 1e0))
SELECT {K}, CAST(corner AS INTEGER) AS corner, {big(f'(cx + u*3e0/{VIEWPORT[0]}*2e0*cw)*1e3')} AS vx_m, {big(f'(cy + v*3e0/{VIEWPORT[1]}*2e0*cw)*1e3')} AS vy_m FROM c CROSS JOIN q WHERE cw > 0"""
)
def billboard_expand(spark, d):
    rel = [F.col(f"e{a}") - F.lit(p) for a, p in zip("xyz", _P, strict=True)]
    clip = {n: rel[0] * _M[i][0] + rel[1] * _M[i][1] + rel[2] * _M[i][2] + _M[i][3] for n, i in (("cx", 0), ("cy", 1), ("cw", 3))}
    out = render.billboard(_points(spark, d).withColumns(clip).filter("cw > 0"), F.lit(3.0), *VIEWPORT)
    return out.select(*KEYS, "corner", scaled(F.col("vx")).alias("vx_m"), scaled(F.col("vy")).alias("vy_m"))


_DISC = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 201 - 100)*1e-2 AS u, (l_suppkey*3 % 201 - 100)*1e-2 AS v FROM {lineitem}"


@query(f"WITH m AS ({_DISC.format(lineitem='lineitem')}), t AS (SELECT *, greatest(least((u*u + v*v - 8e-1)/2e-1, 1e0), 0e0) AS t FROM m WHERE u*u + v*v <= 1e0) SELECT {K}, {big('(1e0 - t*t*(3e0 - 2e0*t))*1e6')} AS alpha_u FROM t")
def disc_mask(spark, d):
    rows = spark.sql(_DISC, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return render.disc(rows).select(*KEYS, scaled(F.col("alpha"), 1e6).alias("alpha_u"))
