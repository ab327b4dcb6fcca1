"""Views of a cloud: camera, visible points, depth, and passes over the pixel table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.functions import classify, fixed, geo

# The lens and the passes' defaults.
FIELD_OF_VIEW, NEAR, FAR = 60.0, 10.0, 2.0e7
EDL_STRENGTH, EDL_RADIUS, TINT, SHIFT, SHIFT_ANGLE, SCAN, VIGNETTE = 1.4, 1.0, 0.80, 0.0007, 1.4, 1.0, 0.8
BACKGROUND = 0.9999
_NEIGHBOURS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)]


@dataclass(frozen=True)
class Camera:
    """A camera that orbits a target; angles in radians, azimuth from north."""

    lat: float
    lon: float
    radius: float
    azimuth: float = math.pi
    elevation: float = math.pi / 6

    def target(self) -> tuple[float, float, float]:
        phi, lam = math.radians(self.lat), math.radians(self.lon)
        n = geo.A / math.sqrt(1 - geo.E2 * math.sin(phi) ** 2)
        return n * math.cos(phi) * math.cos(lam), n * math.cos(phi) * math.sin(lam), n * (1 - geo.E2) * math.sin(phi)

    def position(self) -> tuple[float, float, float]:
        phi, lam = math.radians(self.lat), math.radians(self.lon)
        sp, cp, sl, cl = math.sin(phi), math.cos(phi), math.sin(lam), math.cos(lam)
        flat = self.radius * math.cos(self.elevation)
        e, n, u = flat * math.sin(self.azimuth), flat * math.cos(self.azimuth), self.radius * math.sin(self.elevation)
        t = self.target()
        return t[0] - sl * e - sp * cl * n + cp * cl * u, t[1] + cl * e - sp * sl * n + cp * sl * u, t[2] + cp * n + sp * u

    def zoomed(self, steps: float) -> Camera:
        return Camera(self.lat, self.lon, min(max(self.radius * 1.1**-steps, 10.0), 1e6), self.azimuth, self.elevation)

    def dragged(self, dx: float, dy: float) -> Camera:
        up = min(max(self.elevation + dy * 0.005, math.radians(1)), math.radians(89))
        return Camera(self.lat, self.lon, self.radius, self.azimuth - dx * 0.005, up)

    def matrix(self, aspect: float) -> list[list[float]]:
        """Rows of the clip-space matrix for positions relative to the camera.

        The lens maps depth to 0..1 and a further step to half that range, so depths lie in 0.5..1.
        """
        p, t = self.position(), self.target()
        f = [a - b for a, b in zip(t, p, strict=True)]
        length = math.sqrt(sum(x * x for x in f))
        f = [x / length for x in f]
        flat = math.hypot(p[0], p[1])
        theta = math.atan2(p[2] * geo.A, flat * geo.B)
        phi = math.atan2(p[2] + geo.EP2 * geo.B * math.sin(theta) ** 3, flat - geo.E2 * geo.A * math.cos(theta) ** 3)
        lam = math.atan2(p[1], p[0])
        world = [math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)]
        s = _cross(f, world)
        length = math.sqrt(sum(x * x for x in s))
        s = [x / length for x in s]
        u = _cross(s, f)
        view = [[-x for x in s], [-x for x in u], [-x for x in f]]
        g = 1.0 / math.tan(math.radians(FIELD_OF_VIEW) / 2)
        zz, zw = FAR / (NEAR - FAR), NEAR * FAR / (NEAR - FAR)
        clip_z = [zz * x for x in view[2]]
        w = [-x for x in view[2]]
        return [[g / aspect * x for x in view[0]] + [0.0], [g * x for x in view[1]] + [0.0], [0.5 * a + 0.5 * b for a, b in zip(clip_z, w, strict=True)] + [0.5 * zw], w + [0.0]]


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def orbiting(cameras: DataFrame) -> DataFrame:
    """Rows (lat, lon, radius, azimuth, elevation; degrees, metres, radians) with ``eye`` and ``target``, Earth-centred.

    A row is a camera of its own, so that any number of views is one plan.
    """
    target = dict(zip("xyz", geo.ecef(F.col("lat"), F.col("lon"), F.lit(0.0)), strict=True))
    flat = F.col("radius") * F.cos("elevation")
    away = (flat * F.sin("azimuth"), flat * F.cos("azimuth"), F.col("radius") * F.sin("elevation"))
    east, north, up = geo.enu_basis(F.col("lat"), F.col("lon"))
    eye = {a: target[a] + east[i] * away[0] + north[i] * away[1] + up[i] * away[2] for i, a in enumerate("xyz")}
    return cameras.withColumns({n: F.struct(*[c.alias(a) for a, c in v.items()]) for n, v in (("target", target), ("eye", eye))})


def zoomed(radius: Column, steps: Column) -> Column:
    """A tenth nearer for each step, between 10 m and 1000 km."""
    return fixed.clamp(radius * F.pow(F.lit(1.1), -steps), 10.0, 1e6)


def dragged(azimuth: Column, elevation: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Azimuth and elevation after a drag in pixels; the elevation stays within 1 and 89 degrees."""
    return azimuth - dx * 0.005, fixed.clamp(elevation + dy * 0.005, math.radians(1), math.radians(89))


def looking(cameras: DataFrame, aspect: float) -> DataFrame:
    """Rows of ``orbiting`` with ``view``, the clip matrix's rows x, y, z, w for positions relative to the eye.

    The same matrix as :meth:`Camera.matrix`, by columns; steps are rows of their own so that none is
    computed twice.
    """

    def vector(names: str, values: list[Column]) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    def unit(v: list[Column]) -> list[Column]:
        length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [c / length for c in v]

    def parts(name: str) -> list[Column]:
        return [F.col(f"{name}.{a}") for a in "xyz"]

    lat, lon, _ = geo.geodetic(*parts("eye"))
    rows = cameras.withColumn("_w", vector("xyz", geo.enu_basis(lat, lon)[2])).withColumn("_f", vector("xyz", unit([t - e for t, e in zip(parts("target"), parts("eye"), strict=True)])))
    rows = rows.withColumn("_s", vector("xyz", unit(_cross(parts("_f"), parts("_w")))))
    rows = rows.withColumn("_u", vector("xyz", _cross(parts("_s"), parts("_f"))))
    g = 1.0 / math.tan(math.radians(FIELD_OF_VIEW) / 2)
    zz, zw = FAR / (NEAR - FAR), NEAR * FAR / (NEAR - FAR)
    zero = F.lit(0.0)
    clip = [[*(-c * (g / aspect) for c in parts("_s")), zero], [*(-c * g for c in parts("_u")), zero], [*(c * (0.5 - 0.5 * zz) for c in parts("_f")), F.lit(0.5 * zw)], [*parts("_f"), zero]]
    return rows.withColumn("view", F.struct(*[vector("xyzw", r).alias(n) for n, r in zip("xyzw", clip, strict=True)])).drop("_w", "_f", "_s", "_u")


def seen(points: DataFrame, cameras: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Points (key, ex, ey, ez) with pixel and depth in the view of their key's camera; what is behind it or
    off screen goes.  ``cameras`` has ``eye`` and ``view`` for each key."""
    rows = points.join(cameras.select(key, "eye", "view"), key)
    rel = [F.col(f"e{a}") - F.col(f"eye.{a}") for a in "xyz"]
    clip = [(rel[0] * F.col(f"view.{n}.x") + rel[1] * F.col(f"view.{n}.y") + rel[2] * F.col(f"view.{n}.z") + F.col(f"view.{n}.w")).alias(n) for n in "xyzw"]
    # generated rows keep the filters above the geometry, as in fragments
    rows = rows.select(*points.columns, F.explode(F.array(F.struct(*clip))).alias("_c")).filter("_c.w > 0")
    x = F.floor((F.col("_c.x") / F.col("_c.w") + 1.0) * 0.5 * width).cast("int")
    y = F.floor((1.0 - F.col("_c.y") / F.col("_c.w")) * 0.5 * height).cast("int")
    rows = rows.withColumns({"x": x, "y": y, "z": fixed.clamp(F.col("_c.z") / F.col("_c.w"), 0.0, 1.0)}).drop("_c")
    return rows.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def tile_deltas(anchored: DataFrame, camera: Camera, upm: str = "upm") -> DataFrame:
    """Tiles (ax, ay, az in units) with their anchors relative to the camera, each as two floats.

    What is drawn adds offsets to the high parts; the low parts keep what single precision would lose.
    """
    out = {}
    for a, p in zip("xyz", camera.position(), strict=True):
        out[f"high_{a}"], out[f"low_{a}"] = fixed.split_high_low(fixed.dequantise(F.col(f"a{a}"), F.col(upm)) - F.lit(p))
    return anchored.withColumns(out)


def fragments(points: DataFrame, camera: Camera, width: int, height: int) -> DataFrame:
    """Points (ex, ey, ez, label) with their pixel and depth; those behind the camera or off screen go."""
    p, m = camera.position(), camera.matrix(width / height)
    rel = [F.col(c) - F.lit(v) for c, v in zip(("ex", "ey", "ez"), p, strict=True)]

    def row(i: int) -> Column:
        r = m[i]
        return rel[0] * r[0] + rel[1] * r[1] + rel[2] * r[2] + r[3]

    # generated rows keep the filters above the geometry, which would else be copied into each of them
    clip = F.explode(F.array(F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"), row(3).alias("w"))))
    rows = points.select("*", clip.alias("_c")).filter("_c.w > 0")
    x = F.floor((F.col("_c.x") / F.col("_c.w") + 1.0) * 0.5 * width).cast("int")
    y = F.floor((1.0 - F.col("_c.y") / F.col("_c.w")) * 0.5 * height).cast("int")
    rows = rows.withColumns({"x": x, "y": y, "z": fixed.clamp(F.col("_c.z") / F.col("_c.w"), 0.0, 1.0)}).drop("_c")
    return rows.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def depth_resolve(frags: DataFrame, order: list[str]) -> DataFrame:
    """(y, x, z, label, tag): the nearest fragment of each pixel, of equals the last drawn."""
    rank = F.struct((-F.col("z")).alias("near"), *order)
    return frags.groupBy("y", "x").agg(F.max_by(F.struct("z", "label"), rank).alias("f")).select("y", "x", F.col("f.z").alias("z"), F.col("f.label").alias("label"), F.lit(1.0).alias("tag"))


def coloured(pixels: DataFrame, grey: float = 0.70) -> DataFrame:
    return pixels.withColumns({c: F.lit(grey) for c in "rgb"})


def billboard(points: DataFrame, size_px: Column, width: int, height: int) -> DataFrame:
    """Six corners of two triangles around each point (cx, cy, cw in clip space), with the disc's u, v."""
    corners = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, -1), (1, 1), (-1, 1))])
    rows = points.withColumn("s", size_px).select("*", F.posexplode(corners).alias("corner", "c"))
    return rows.withColumns({"vx": F.col("cx") + F.col("c.u") * F.col("s") / width * 2.0 * F.col("cw"), "vy": F.col("cy") + F.col("c.v") * F.col("s") / height * 2.0 * F.col("cw"), "u": F.col("c.u"), "v": F.col("c.v")}).drop("c", "s")


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = fixed.clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def disc(rows: DataFrame) -> DataFrame:
    """Fragments inside the unit disc of (u, v) with their coverage ``alpha``."""
    d = F.col("u") * F.col("u") + F.col("v") * F.col("v")
    return rows.filter(d <= 1.0).withColumn("alpha", 1.0 - smoothstep(0.8, 1.0, d))


def point_size(altitude: Column) -> Column:
    """3 pixels at a metre down to 0.6 at a kilometre and above, by the logarithm."""
    return 3.0 - fixed.clamp(F.log(fixed.clamp(altitude, 1.0, 1000.0)) / math.log(1000.0), 0.0, 1.0) * (3.0 - 0.6)


def edl(pixels: DataFrame, strength: float = EDL_STRENGTH, radius: int = int(EDL_RADIUS)) -> DataFrame:
    """Eye-dome lighting: pixels darkened by how far their neighbours lie behind."""
    solid = pixels.filter((F.col("tag") >= 0.5) & (F.col("z") < BACKGROUND))
    here = solid.select("y", "x", F.log(F.col("z") + 1e-6).alias("l0"), F.explode(F.array(*[F.struct(F.lit(b * radius).alias("dy"), F.lit(a * radius).alias("dx")) for a, b in _NEIGHBOURS])).alias("o"))
    there = solid.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.log(F.col("z") + 1e-6).alias("l"))
    pairs = here.join(there, (F.col("y") + F.col("o.dy") == F.col("ny")) & (F.col("x") + F.col("o.dx") == F.col("nx")))
    dark = pairs.groupBy("y", "x").agg(F.sum(F.greatest(F.col("l") - F.col("l0"), F.lit(0.0))).alias("s"))
    shade = F.when((F.col("tag") >= 0.5) & (F.col("z") < BACKGROUND), F.exp(-strength * F.coalesce("s", F.lit(0.0)))).otherwise(1.0)
    return pixels.join(dark, ["y", "x"], "left").withColumn("shade", shade).withColumns({c: F.col(c) * F.col("shade") for c in "rgb"}).drop("s", "shade")


def tint(pixels: DataFrame, amount: float = TINT) -> DataFrame:
    """Colours mixed with those of the classes, except far pixels and class 0."""
    amount = min(max(amount, 0.0), 1.0)
    on = (F.col("z") < BACKGROUND) & (F.col("label") != 0)
    return pixels.withColumns({c: F.when(on, F.col(c) * (1.0 - amount) + k * amount).otherwise(F.col(c)) for c, k in zip("rgb", classify.colour(F.col("label")), strict=True)})


def rgb_shift(pixels: DataFrame, width: int, height: int, amount: float = SHIFT, angle: float = SHIFT_ANGLE) -> DataFrame:
    """Red from one side, green and blue from the other; borders repeat, empty pixels are black."""
    ox, oy = amount * math.cos(angle), amount * math.sin(angle)

    def at(c: str, size: int, by: float) -> Column:
        return F.greatest(F.least(F.floor((F.col(c) + 0.5) + by * size).cast("int"), F.lit(size - 1)), F.lit(0))

    rows = pixels.withColumns({"rx": at("x", width, ox), "ry": at("y", height, oy), "gx": at("x", width, -ox), "gy": at("y", height, -oy)})
    red = pixels.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("r").alias("r1"))
    rest = pixels.select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("g").alias("g1"), F.col("b").alias("b1"))
    out = rows.join(red, ["rx", "ry"], "left").join(rest, ["gx", "gy"], "left")
    on = (F.col("tag") >= 0.5) & (F.col("z") < BACKGROUND)
    return out.withColumns({c: F.when(on, F.coalesce(c + "1", F.lit(0.0))).otherwise(F.col(c)) for c in "rgb"}).select(*pixels.columns)


def crt(pixels: DataFrame, width: int, height: int, time: float = 0.0, intensity: float = SCAN, vignette: float = VIGNETTE) -> DataFrame:
    """Scan lines, grain and a darker border."""
    u, v = (F.col("x") + 0.5) / width, (F.col("y") + 0.5) / height
    scan = 0.5 + 0.5 * F.sin(6.28318 * (v * height * 0.5 + time * 12.0))
    dot = (u * 2048.0 + time) * 12.9898 + (v * 2048.0 - time) * 78.233
    raw = F.sin(dot) * 43758.5453
    grain = (raw - F.floor(raw) - 0.5) * 0.02
    dx, dy = (u - 0.5) / 1.1, (v - 0.5) / 0.95
    border = 1.0 - vignette * smoothstep(0.6, 1.0, F.sqrt(dx * dx + dy * dy))
    back = (F.col("z") >= BACKGROUND) | (F.col("tag") < 0.5)
    far = (0.01 * 0.85 + grain) * (1.0 - intensity * scan)
    return pixels.withColumns({c: F.when(back, far).otherwise((F.col(c) + grain * 0.4) * (1.0 - intensity * 0.25 * scan)) * border for c in "rgb"})


def debug_view(pixels: DataFrame, mode: int) -> DataFrame:
    """1: depth, near is white; 2: class colours, the far ones dim; 3: the tag; else unchanged."""
    if mode == 1:
        return pixels.withColumns({c: 1.0 - fixed.clamp(F.col("z"), 0.0, 1.0) for c in "rgb"})
    if mode == 2:
        return pixels.withColumns({c: F.when(F.col("z") >= BACKGROUND, 0.05).otherwise(k) for c, k in zip("rgb", classify.colour(F.col("label")), strict=True)})
    if mode == 3:
        return pixels.withColumns({c: F.when(F.col("tag") >= 0.5, 1.0).otherwise(0.0) for c in "rgb"})
    return pixels


def post_chain(pixels: DataFrame, width: int, height: int, use_edl: bool = True, use_tint: bool = True, use_shift: bool = True, use_crt: bool = True, debug: int = 0, shift: float = SHIFT, time: float = 0.0) -> DataFrame:
    """The passes in their order; a debug view takes the place of the last."""
    out = edl(pixels) if use_edl else pixels
    out = tint(out) if use_tint else out
    out = rgb_shift(out, width, height, shift) if use_shift else out
    return debug_view(out, debug) if debug else crt(out, width, height, time) if use_crt else out


def footprints(pixels: DataFrame, **names: str) -> DataFrame:
    """Pixels (y, x) with how far each of ``names``' columns moves over a pixel, under the name given.

    Values are compared within quads of two by two pixels, across and down, as a screen's derivatives
    are; a pixel whose neighbour is missing does not move that way.
    """
    quad = Window.partitionBy(F.expr("y div 2"), F.expr("x div 2"))

    def of(column: str) -> Column:
        def at(y: Column | int, x: Column | int) -> Column:
            return F.max(F.when((F.pmod("y", F.lit(2)) == y) & (F.pmod("x", F.lit(2)) == x), F.col(column))).over(quad)

        own_y, own_x = F.pmod("y", F.lit(2)), F.pmod("x", F.lit(2))
        across = F.when(own_y == 0, at(0, 1) - at(0, 0)).otherwise(at(1, 1) - at(1, 0))
        down = F.when(own_x == 0, at(1, 0) - at(0, 0)).otherwise(at(1, 1) - at(0, 1))
        return F.coalesce(F.abs(across), F.lit(0.0)) + F.coalesce(F.abs(down), F.lit(0.0))

    return pixels.withColumns({new: of(column) for column, new in names.items()})


def ground_grid(rows: DataFrame, camera_height: float) -> DataFrame:
    """Opacity of the ground grid at (px, py) metres, with pixel footprints (fx, fy) in metres.

    Lines stand at decades of metres, blended between the two decades next to the camera's height;
    outside 50 m to 200 km there is no grid.
    """
    if not 50.0 <= camera_height <= 200000.0:
        return rows.filter(F.lit(False)).withColumn("opacity", F.lit(0.0))
    level = math.log10(camera_height)
    step = max(10.0 ** math.floor(level), 1.0)

    def line(c: str, f: str, s: float) -> Column:
        t = F.col(c) / s
        part = t - F.floor(t)
        width = F.least(F.col(f) / s * 1.5, F.lit(0.5))
        x = F.greatest(F.least(F.try_divide(F.least(part, 1.0 - part), width), F.lit(1.0)), F.lit(0.0))
        return 1.0 - x * x * (3.0 - 2.0 * x)

    def grid(s: float) -> Column:
        return F.greatest(line("px", "fx", s), line("py", "fy", s)) * 0.5 + F.greatest(line("px", "fx", s * 10), line("py", "fy", s * 10)) * 0.5

    blend = level - math.floor(level)
    fade = min(max((camera_height - 20000.0) / 180000.0, 0.0), 1.0)
    fade = 1.0 - fade * fade * (3.0 - 2.0 * fade)
    return rows.withColumn("opacity", (grid(step) * (1.0 - blend) + grid(step * 10) * blend) * fade * 0.10)
