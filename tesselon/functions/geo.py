"""Geodesy on the WGS-84 ellipsoid as column expressions (degrees and metres)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# The WGS-84 ellipsoid.
A = 6378137.0
FLATTENING = 1.0 / 298.257223563
E2 = FLATTENING * (2.0 - FLATTENING)
B = A * (1.0 - FLATTENING)
EP2 = (A * A - B * B) / (B * B)
# Metres of a degree, for margins and pixel sizes.
METRES_LAT = 110574.0
METRES_LON = 111320.0
# Distances from the Earth's centre that count as plausible.
EARTH_LOW, EARTH_HIGH = 6.2e6, 6.5e6


@F.arrow_udf(T.DoubleType())
def sine(x: pa.Array) -> pa.Array:
    """The sine of the system's library.

    The virtual machine's own differs from it in the last bit of one value in some hundreds, enough to move a
    coordinate over a rounding border in one of many millions of rows.
    """
    return pc.sin(x)


@F.arrow_udf(T.DoubleType())
def cosine(x: pa.Array) -> pa.Array:
    """The cosine of the system's library, as ``sine``."""
    return pc.cos(x)


def ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """Geodetic to Earth-centred coordinates."""
    phi, lam = F.radians(lat), F.radians(lon)
    sp, cp, sl, cl = sine(phi), cosine(phi), sine(lam), cosine(lam)
    n = F.lit(A) / F.sqrt(1.0 - E2 * sp * sp)
    return (n + h) * cp * cl, (n + h) * cp * sl, (n * (1.0 - E2) + h) * sp


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Earth-centred to geodetic (lat, lon, h) in closed form; undefined at the poles."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    st, ct = F.sin(theta), F.cos(theta)
    phi = F.atan2(z + EP2 * B * st * st * st, p - E2 * A * ct * ct * ct)
    n = F.lit(A) / F.sqrt(1.0 - E2 * F.sin(phi) * F.sin(phi))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), F.try_divide(p, F.cos(phi)) - n


def local_to_geodetic(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Planar offsets from a centre to (lat, lon), by the radii of curvature at the centre."""
    phi = F.radians(lat0)
    w = 1.0 - E2 * F.sin(phi) * F.sin(phi)
    meridian = A * (1.0 - E2) / (w * F.sqrt(w))
    normal = F.lit(A) / F.sqrt(w)
    return lat0 + F.degrees(north / meridian), lon0 + F.degrees(F.try_divide(east, normal * F.cos(phi)))


def pad_degrees(lat: Column, metres: float | Column) -> tuple[Column, Column]:
    """(lat, lon) degrees of a margin in metres at a latitude."""
    m = F.lit(metres) if isinstance(metres, (int, float)) else metres
    return m / METRES_LAT, m / (METRES_LON * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-6)))


def metres_per_pixel(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column, grid: int) -> Column:
    lat = 0.5 * (lat_min + lat_max)
    lon_m = F.greatest(lon_max - lon_min, F.lit(1e-12)) * METRES_LON * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-6)) / float(grid)
    lat_m = F.greatest(lat_max - lat_min, F.lit(1e-12)) * METRES_LAT / float(grid)
    return 0.5 * (lon_m + lat_m)


def utm_zone(lon: Column) -> Column:
    """Six-degree zones without the exceptions of the north."""
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_central_meridian(lon: Column) -> Column:
    return (utm_zone(lon) * 6 - 183).cast("double")


def meridian_convergence(lat: Column, lon: Column, lon0: Column) -> Column:
    """Degrees between grid north and true north."""
    return F.degrees(F.atan(F.tan(F.radians(lon - lon0)) * F.sin(F.radians(lat))))


def enu_basis(lat: Column, lon: Column) -> list[list[Column]]:
    """Rows east, north, up in Earth-centred components; its transpose leads back."""
    sp, cp = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    sl, cl = F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return [[-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]]


def rotate(rows: list[list[Column]], v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in rows)


def plausible_radius(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z).between(EARTH_LOW, EARTH_HIGH)


def finite(*columns: Column) -> Column:
    """True where no value is null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    return out
