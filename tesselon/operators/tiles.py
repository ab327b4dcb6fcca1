"""From vertices to quantised tiles: coordinate systems, anchors, precision, offsets, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions import fixed, geo

#: Vertices of a file that decide its coordinate system.
SAMPLE = 4096
#: Times a precision may be halved until offsets fit.
HALVINGS = 31


def detect_system(vertices: DataFrame, key: str = "file_id", order: str = "vid") -> DataFrame:
    """(key, cs): geodetic, ecef or local_m, from the vertices numbered below the sample size."""
    seen = vertices.filter(F.col(order) < SAMPLE)
    geographic = ((F.abs("x") <= 180.0) & (F.abs("y") <= 90.0)).cast("double")
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    found = seen.groupBy(key).agg(F.avg(geographic).alias("share"), F.avg(radius).alias("radius"))
    cs = F.when(F.col("share") >= 0.90, "geodetic").when(F.col("radius").between(geo.EARTH_LOW, geo.EARTH_HIGH), "ecef").otherwise("local_m")
    return found.select(key, cs.alias("cs"))


def planar_origin(vertices: DataFrame, key: str) -> DataFrame:
    """The middle of the planar range of each key: (key, e0, n0)."""
    return vertices.groupBy(key).agg(((F.min("x") + F.max("x")) / 2).alias("e0"), ((F.min("y") + F.max("y")) / 2).alias("n0"))


def local_degrees(vertices: DataFrame, origins: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Planar vertices as lon, lat, h around the centre of their tile's box."""
    rows = vertices.join(origins, key).join(boxes.select(key, "lon_min", "lat_min", "lon_max", "lat_max"), key)
    lat, lon = geo.local_to_geodetic(F.col("x") - F.col("e0"), F.col("y") - F.col("n0"), 0.5 * (F.col("lat_min") + F.col("lat_max")), 0.5 * (F.col("lon_min") + F.col("lon_max")))
    return rows.select(*vertices.columns, lon.alias("lon"), lat.alias("lat"), F.col("z").alias("h_m"))


def to_ecef(vertices: DataFrame, systems: DataFrame, boxes: DataFrame | None, key: str = "file_id") -> DataFrame:
    """(key, vid, ex, ey, ez) of vertices in any of the three systems (``cs`` in ``systems``).

    Local metres need the tile's box; without one the query fails for that tile.  The three systems
    are three branches, so that none evaluates another's formulas.
    """
    rows = vertices.join(systems, key)
    degrees = rows.filter("cs = 'geodetic'").select(key, "vid", F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("z").alias("h_m"))
    straight = rows.filter("cs = 'ecef'").select(key, "vid", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"))
    local = rows.filter("cs = 'local_m'").select(key, "vid", "x", "y", "z")
    if boxes is None:
        missing = F.raise_error(F.lit("local metres need a tile box"))
        planar = local.select(key, "vid", missing.cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("h_m"))
    else:
        planar = local_degrees(local, planar_origin(local, key), boxes, key).select(key, "vid", "lon", "lat", "h_m")
    ex, ey, ez = geo.ecef(F.col("lat"), F.col("lon"), F.col("h_m"))
    return degrees.unionByName(planar).select(key, "vid", ex.alias("ex"), ey.alias("ey"), ez.alias("ez")).unionByName(straight)


def anchors(points: DataFrame, key: str, requested_upm: int = 1000, fitted: bool = True) -> DataFrame:
    """(key, n, cx, cy, cz, max_off, upm, ax, ay, az): centroid, reach, precision and anchor units.

    The precision is the finest that fits; where rounding still overflows 32 bits it is halved, up to
    HALVINGS times, as a choice among candidates instead of a loop.  Offsets that fit at no precision
    are an error.  Centroid and reach come from one aggregate; the reach from minima and maxima.  Without
    ``fitted`` the halving begins at the precision that is asked for.
    """
    ends = [f(c).alias(f"{n}_{c}") for c in ("ex", "ey", "ez") for n, f in (("lo", F.min), ("hi", F.max))]
    both = points.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(f"e{a}").alias(f"c{a}") for a in "xyz"], *ends)
    reach = F.greatest(*[F.greatest(F.col(f"hi_e{a}") - F.col(f"c{a}"), F.col(f"c{a}") - F.col(f"lo_e{a}")) for a in "xyz"])
    out = both.withColumn("max_off", reach).withColumn("_u", fixed.fitted_upm(reach, requested_upm) if fitted else F.lit(requested_upm).cast("bigint"))

    def fits(u: Column) -> Column:
        ok = F.lit(True)
        for a in "xyz":
            anchor = fixed.quantise(F.col(f"c{a}"), u)
            ok = ok & fixed.fits_i32(fixed.quantise(F.col(f"lo_e{a}"), u) - anchor, fixed.quantise(F.col(f"hi_e{a}"), u) - anchor)
        return ok

    # the fitted precision leaves 5 % to spare, so halvings are rare: they are looked at only where it fails
    halved = F.transform(F.sequence(F.lit(1), F.lit(HALVINGS)), lambda k: F.greatest(F.floor(F.col("_u") / F.pow(F.lit(2.0), k)), F.lit(1)).cast("bigint"))
    upm = F.when(fits(F.col("_u")), F.col("_u")).otherwise(F.try_element_at(F.filter(halved, fits), F.lit(1)))
    out = out.withColumn("upm", F.coalesce(upm, F.raise_error(F.lit("offsets beyond 32 bits at every precision")).cast("bigint")))
    return out.select(key, "n", "cx", "cy", "cz", "max_off", "upm", *[fixed.quantise(F.col(f"c{a}"), F.col("upm")).alias(f"a{a}") for a in "xyz"])


def offsets(points: DataFrame, anchored: DataFrame, key: str) -> DataFrame:
    """Points with dx, dy, dz, their whole-unit offsets from the anchor."""
    rows = points.join(anchored.select(key, "upm", "ax", "ay", "az"), key)
    return rows.withColumns({f"d{a}": (fixed.quantise(F.col(f"e{a}"), F.col("upm")) - F.col(f"a{a}")).cast("int") for a in "xyz"})


def extents(points: DataFrame, key: str) -> DataFrame:
    """Bounds in degree ticks of geodetic points."""
    return points.groupBy(key).agg(*[fixed.q7(f(c)).alias(f"{c}_{n}_q7") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])


def choose_extent(box: list[Column], found: list[Column]) -> Column:
    """The tile's box where there is one, else the points' bounds where they are finite, else null."""
    names = ("lon_min", "lon_max", "lat_min", "lat_max")

    def ticks(cols: list[Column]) -> Column:
        return F.struct(*[fixed.q7(c).alias(n) for c, n in zip(cols, names, strict=True)])

    return F.when(F.coalesce(*[F.when(c.isNull(), F.lit(1)) for c in box], F.lit(0)) == 0, ticks(box)).when(geo.finite(*found), ticks(found))
