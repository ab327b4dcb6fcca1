"""Loaded tiles: labels from masks, statistics of tiles and of the whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions import fixed, geo
from tesselon.sources import files

#: Keys that points without a pixel are spread over.
NOWHERE = 4096
#: Painted pixels, or rows and runs of masks, up to this count are sent to every task.
BROADCAST_PIXELS = 1 << 18


def sent(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """``rows`` computed once and counted (by ``weight``): few are sent to every task, so that what meets them needs
    no shuffle."""
    kept = files.checkpointed(rows)
    n = kept.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(kept) if n <= BROADCAST_PIXELS else kept


def sample_pixel(value: Column, low: Column, high: Column, size: int | Column, mode: str = "clamp") -> Column:
    """The mask index of a coordinate; outside the extent the border (clamp) or null (zero)."""
    u = (value - low) / (high - low + 1e-12)
    n = F.lit(size) if isinstance(size, int) else size
    inside = F.greatest(F.least(u, F.lit(1.0)), F.lit(0.0))
    at = F.round(inside * (n - 1).cast("double")).cast("int")
    return at if mode == "clamp" else F.when(u.between(0.0, 1.0), at)


def label_points(points: DataFrame, mask: DataFrame, extents: DataFrame, grid: int | Column, key: str = "tile_id", mode: str = "clamp", height: int | Column | None = None) -> DataFrame:
    """Points with ``label``: their own if the tile has labels, else the mask's class, else 0.

    ``points`` has key, ex, ey, ez and a nullable ``label``; ``extents`` has degree ticks for tiles with
    a usable mask.  ``mask`` has painted pixels (key, y, x, class), or rows of runs (key, y, runs) as
    ``raster.runs_by_row`` gives them.  Points are read once: the tile's extent is joined to them, and only
    where there is one and no label of their own do they get a pixel.  The lookup is an equi-join on tile
    and pixel, or on tile and row, in whose runs the last that begins at or before the pixel is taken.
    Points without a pixel are spread over keys that no mask has.  Pixels and runs are computed once and counted:
    few are sent to every task, so that points need no shuffle; beyond ``BROADCAST_PIXELS`` both sides are dealt out.
    """
    rows = points.join(extents.withColumn("_masked", F.lit(True)), key, "left")
    wanted = F.col("label").isNull() & F.col("_masked")
    lat, lon, _ = geo.geodetic(*[F.when(wanted, F.col(c)) for c in ("ex", "ey", "ez")])
    ends = [fixed.q7_degrees(F.col(c)) for c in ("lon_min_q7", "lon_max_q7", "lat_min_q7", "lat_max_q7")]
    # generated rows: else the join's null filters would each hold a copy of the geodesy
    rows = rows.select("*", F.explode(F.array(F.struct(lat.alias("lat"), lon.alias("lon")))).alias("_d"))
    nowhere = -1 - F.pmod(F.xxhash64("ex", "ey", "ez"), F.lit(NOWHERE)).cast("int")
    rows = rows.withColumns({"_x": sample_pixel(F.col("_d.lon"), ends[0], ends[1], grid, mode), "_y": F.coalesce(sample_pixel(F.col("_d.lat"), ends[2], ends[3], grid if height is None else height, mode), nowhere)})
    if "runs" in mask.columns:
        runs = sent(mask.select(key, F.col("y").alias("_y"), F.col("runs").alias("_runs")), 1 + F.size("_runs"))
        looked = rows.join(runs, [key, "_y"], "left")
        found = F.try_element_at(F.filter("_runs", lambda r: r["x"] <= F.col("_x")), F.lit(-1))["class"]
    else:
        rows = rows.withColumn("_x", F.coalesce("_x", nowhere))
        pixels = sent(mask.select(key, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("class").alias("_class")))
        looked, found = rows.join(pixels, [key, "_y", "_x"], "left"), F.col("_class")
    return looked.withColumn("label", F.coalesce("label", F.when(wanted, found), F.lit(0))).select(points.columns)


def dataset_stats(tiles: DataFrame) -> DataFrame:
    """One row over tiles (n, upm, ax, ay, az in units): counts, weighted centroid, spread, start orbit.

    The centroid is one row, so the cross join with it is bounded.
    """
    m = {a: fixed.dequantise(F.col(f"a{a}"), F.col("upm")) for a in "xyz"}
    rows = tiles.select("n", "upm", *[m[a].alias(f"m{a}") for a in "xyz"])
    centre = rows.agg(F.count("*").alias("tiles"), F.sum("n").alias("points"), F.min("upm").alias("upm_min"), F.max("upm").alias("upm_max"), *[F.try_divide(F.sum(F.col(f"m{a}") * F.col("n")), F.sum("n")).alias(f"c{a}") for a in "xyz"])
    d = [F.col(f"m{a}") - F.col(f"c{a}") for a in "xyz"]
    spread = rows.crossJoin(F.broadcast(centre)).agg(F.max(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("spread_m"))
    out = centre.crossJoin(F.broadcast(spread))
    return out.withColumn("orbit_m", fixed.clamp(2.0 * F.col("spread_m"), 100.0, 50000.0)).withColumn("plausible", geo.plausible_radius(F.col("cx"), F.col("cy"), F.col("cz")))


def orientation(points: DataFrame, tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, var_e, var_n, cov_en, angle_from_east): principal direction in the anchor's tangent plane."""
    lat, lon, _ = geo.geodetic(*[fixed.dequantise(F.col(f"a{a}"), F.col("upm")) for a in "xyz"])
    frames = tiles.select(key, "upm", lat.alias("lat"), lon.alias("lon"))
    rows = points.select(key, "dx", "dy", "dz").join(frames, key)
    e, n, _ = geo.rotate(geo.enu_basis(F.col("lat"), F.col("lon")), tuple(fixed.dequantise(F.col(f"d{a}"), F.col("upm")) for a in "xyz"))
    found = rows.select(key, e.alias("e"), n.alias("n")).groupBy(key).agg(F.var_pop("e").alias("var_e"), F.var_pop("n").alias("var_n"), F.covar_pop("e", "n").alias("cov_en"))
    return found.withColumn("angle_from_east", F.degrees(0.5 * F.atan2(2.0 * F.col("cov_en"), F.col("var_e") - F.col("var_n"))))


def offset_bounds(points: DataFrame, key: str = "tile_id") -> DataFrame:
    """The box of offsets of each tile."""
    return points.groupBy(key).agg(F.count("*").alias("n"), *[f(f"d{a}").alias(f"{n}_d{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
