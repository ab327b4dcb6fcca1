"""Semantic classes of map features: the class dimension and the ordered tag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Class, name, precedence, colour (red, green, blue).
CLASSES = [
    (0, "Unknown", 0, 0.85, 0.85, 0.85),
    (1, "Building", 200, 1.00, 0.82, 0.40),
    (2, "RoadMajor", 150, 1.00, 0.92, 0.20),
    (3, "RoadMinor", 140, 0.80, 0.80, 0.80),
    (4, "Path", 130, 0.70, 0.70, 0.70),
    (5, "Water", 200, 0.20, 0.55, 0.95),
    (6, "Park", 100, 0.40, 0.85, 0.40),
    (7, "Woodland", 90, 0.17, 0.55, 0.30),
    (8, "Railway", 160, 0.85, 0.30, 0.55),
    (9, "Parking", 80, 0.55, 0.55, 0.95),
]
# Highway kinds with their classes and widths in metres.
HIGHWAYS = {"motorway": (2, 12.0), "trunk": (2, 10.0), "primary": (2, 8.0), "secondary": (3, 7.0), "tertiary": (3, 6.0), "residential": (3, 5.0), "service": (3, 5.0)}
OTHER_HIGHWAY = (4, 2.0)
LANE_M, FOOT_M, RAIL_M = 3.2, 0.3048, 4.0

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def dimension(spark: SparkSession) -> DataFrame:
    """The ten classes: a table of fixed size, safe to broadcast."""
    return spark.createDataFrame(CLASSES, "class int, name string, precedence int, red double, green double, blue double")


def _lookup(key: Column, pairs: dict, default) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def precedence(cls: Column) -> Column:
    return _lookup(cls, {c[0]: c[2] for c in CLASSES}, 0)


def colour(cls: Column) -> tuple[Column, Column, Column]:
    return tuple(_lookup(cls, {c[0]: c[i] for c in CLASSES}, CLASSES[0][i]) for i in (3, 4, 5))


def number(text: Column, kind: str = "float") -> Column:
    """A plain decimal number, else null; signs and exponents are allowed, blanks and suffixes not."""
    return F.when(text.rlike(_NUMBER), text.try_cast(kind))


def _without_end(s: Column, n: int) -> Column:
    return s.substr(F.lit(1), F.length(s) - n)


def width_m(text: Column) -> Column:
    """Metres from ``3.5``, ``3.5m`` or ``12 ft``; a suffix whose number is no number gives null."""
    s = F.lower(F.trim(text))
    feet = number(F.trim(_without_end(s, 2)))
    metres = number(F.trim(_without_end(s, 1)))
    return F.when(s.endswith("m"), metres).when(s.endswith("ft"), (feet * F.lit(FOOT_M).cast("float")).cast("float")).otherwise(number(s))


def lanes(text: Column) -> Column:
    value = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    return F.when(value <= 4294967295, value)


def highway(kind: Column, lane_count: Column, width: Column) -> tuple[Column, Column]:
    """(class, width in metres as float) of a highway."""
    cls = _lookup(kind, {k: v[0] for k, v in HIGHWAYS.items()}, OTHER_HIGHWAY[0])
    base = _lookup(kind, {k: v[1] for k, v in HIGHWAYS.items()}, OTHER_HIGHWAY[1]).cast("float")
    by_lanes = (lane_count.cast("float") * F.lit(LANE_M).cast("float")).cast("float")
    wide = F.when(width.isNotNull(), F.greatest(width, F.lit(1.0).cast("float"))).when(F.coalesce(lane_count, F.lit(0)) >= 2, F.greatest(by_lanes, base)).otherwise(base)
    return cls, wide.cast("float")


#: A way without any of these tags has no class.
KEYS = ("building", "highway", "natural", "waterway", "landuse", "leisure", "railway", "amenity")


def way_class(tag) -> Column:
    """struct(class, width_m, is_area) by the first rule that holds, null if none does.

    ``tag`` maps a key to the column of its value (null where the way lacks it).
    """
    cls, wide = highway(tag("highway"), lanes(tag("lanes")), width_m(tag("width")))

    def made(c, w, area: bool) -> Column:
        return F.struct((c if isinstance(c, Column) else F.lit(c)).cast("int").alias("class"), (w if isinstance(w, Column) else F.lit(w)).cast("float").alias("width_m"), F.lit(area).alias("is_area"))

    rules = [
        (tag("building") != "", made(1, 0.0, True)),
        (tag("highway").isNotNull(), made(cls, wide, False)),
        (tag("natural") == "water", made(5, 0.0, True)),
        (tag("waterway") == "riverbank", made(5, 0.0, True)),
        (tag("landuse") == "forest", made(7, 0.0, True)),
        (tag("landuse").isin("grass", "meadow", "reservoir"), made(6, 0.0, True)),
        (tag("leisure").isin("park", "pitch"), made(6, 0.0, True)),
        (tag("railway") != "", made(8, RAIL_M, False)),
        (tag("amenity") == "parking", made(9, 0.0, True)),
    ]
    out = None
    for when, then in rules:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out
