"""Semantic grids: filling areas, buffering lines, resolving overlaps, run lengths.

Pixel arithmetic is in single precision, with a cast after every division and root, so that borders
fall on the same pixels as in single-precision code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.functions import classify, geo
from tesselon.operators import spans

LONGEST_RUN = 65535
#: Bits of a way's place in the painting order.
ORDER_BITS = 50
#: Parts of a tile's ways that are painted apart.
PORTIONS = 16


def f32(c: Column | float) -> Column:
    return (F.lit(c) if isinstance(c, (int, float)) else c).cast("float")


def to_pixel(value: Column, low: Column, high: Column, grid: int) -> Column:
    """Degrees to a pixel index: clamped, rounded half away from zero."""
    u = f32((value - low) / F.greatest(high - low, F.lit(1e-12)))
    at = f32(F.greatest(F.least(u, f32(1.0)), f32(0.0)) * f32(float(grid - 1)))
    # not negative, and a double holds the sum exactly: as round, which goes through decimal numbers
    return F.floor(at.cast("double") + 0.5).cast("int")


def pixelised(overlay: DataFrame, tiles: DataFrame, grid: int) -> DataFrame:
    """Overlay rows with ``px``, their vertices as pixels of the tile's grid, and ``radius`` of lines."""
    t = tiles.select("tile_id", "lon_min", "lat_min", "lon_max", "lat_max")
    rows = overlay.join(t, "tile_id")
    px = F.transform("verts", lambda v: F.struct(to_pixel(v["lon"], F.col("lon_min"), F.col("lon_max"), grid).alias("x"), to_pixel(v["lat"], F.col("lat_min"), F.col("lat_max"), grid).alias("y")))
    mpp = geo.metres_per_pixel(F.col("lon_min"), F.col("lat_min"), F.col("lon_max"), F.col("lat_max"), grid)
    radius = F.greatest(f32(F.col("width_m").cast("double") * 0.5 / mpp), f32(0.5))
    return rows.select("tile_id", "way_id", "class", "is_area", px.alias("px"), radius.alias("radius"))


def area_spans(areas: DataFrame, grid: int) -> DataFrame:
    """(tile_id, way_id, class, y, a, b): pixels inside, by the even-odd rule, from a to b in row y."""
    return _spans(areas, grid, True)


def line_spans(lines: DataFrame, grid: int) -> DataFrame:
    """(tile_id, way_id, class, y, a, b): pixels whose centre lies within the radius of a segment.

    Spans of a way are disjoint, so pixels near several of its segments appear once.
    """
    return _spans(lines, grid, False)


def _spans(ways: DataFrame, grid: int, areas: bool) -> DataFrame:
    columns = ["tile_id", "way_id", "class", "px"] + ([] if areas else ["radius"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ways.select(columns[:3]).schema)
    return ways.select(columns).mapInArrow(spans.spans(grid, areas), f"{kept}, y int, a int, b int")


def _pixels(found: DataFrame) -> DataFrame:
    return found.select("tile_id", "way_id", "class", "y", F.explode(F.sequence("a", "b")).alias("x"))


def span_sums(found: DataFrame) -> DataFrame:
    """(tile_id, way_id, n, sum_x, sum_y) over the pixels of spans."""
    a, b = F.col("a").cast("bigint"), F.col("b").cast("bigint")
    n = b - a + 1
    rows = found.select("tile_id", "way_id", n.alias("n"), F.expr("(cast(a as bigint) + b) * (cast(b as bigint) - a + 1) div 2").alias("x"), (n * F.col("y")).alias("y"))
    return rows.groupBy("tile_id", "way_id").agg(F.sum("n").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def fill_areas(areas: DataFrame, grid: int) -> DataFrame:
    """(tile_id, way_id, class, y, x) of pixels inside, by the even-odd rule in span form."""
    return _pixels(area_spans(areas, grid))


def _capsule_row(grid: int) -> tuple[Column, Column]:
    """First and last pixel of row ``y`` that may lie within ``radius`` of the segment x0, y0 to x1, y1.

    The outline of all that is within the radius is two arcs and two parallels of the segment, and
    convex, so its outermost crossings with the row bound one interval.  The radius is widened by more
    than single precision can lose; the pixels at the ends are left to the exact test.
    """
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    wide = F.col("radius").cast("double") * 1.001 + 0.01
    row = F.col("y") + 0.5
    dx, dy = x1 - x0, y1 - y0
    length = F.sqrt(dx * dx + dy * dy)
    lefts, rights = [], []
    for x, y in ((x0, y0), (x1, y1)):
        h = wide * wide - (row - y) * (row - y)
        half = F.when(h >= 0, F.sqrt(h))
        lefts.append(x - half)
        rights.append(x + half)
    for side in (-1.0, 1.0):
        nx, ny = F.try_divide(-dy * wide * side, length), F.try_divide(dx * wide * side, length)
        along = F.try_divide(row - (y0 + ny), dy)
        crossing = F.when(along.between(0.0, 1.0), x0 + nx + along * dx)
        lefts.append(crossing)
        rights.append(crossing)
    first, last = F.ceil(F.least(*lefts) - 0.5).cast("int"), F.floor(F.greatest(*rights) - 0.5).cast("int")
    # a row beyond the outline has no crossing, and no pixel
    return F.when(first.isNotNull(), F.greatest(first, F.lit(0))), F.when(last.isNotNull(), F.least(last, F.lit(grid - 1)))


def buffer_lines(lines: DataFrame, grid: int) -> DataFrame:
    """(tile_id, way_id, class, y, x) of pixels whose centre lies within the radius of a segment, each once."""
    return _pixels(line_spans(lines, grid))


def paint_rank(line: Column) -> Column:
    """A way's place among what may be painted over a pixel: precedence, lines after areas, order; and its class.

    They are packed into one number, which is never 0.
    """
    order = F.col("way_id").cast("bigint")
    order = F.when(order.between(0, (1 << ORDER_BITS) - 1), order).otherwise(F.raise_error(F.lit("a way's order is out of range")).cast("bigint"))
    return F.shiftleft(F.shiftleft((classify.precedence(F.col("class")) * 2 + line).cast("bigint"), ORDER_BITS).bitwiseOR(order), 4).bitwiseOR(F.col("class").cast("bigint"))


def _class_of(rank: str) -> Column:
    return F.col(rank).bitwiseAND(15).cast("int")


def paint(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """(tile_id, y, x, class) after painting areas, then lines, in way order.

    A class replaces one of the same or less precedence, so the last of the highest precedence stays: the
    pixel's highest rank, in a hash aggregate that combines before the shuffle.
    """
    both = areas.withColumn("line", F.lit(0)).unionByName(lines.withColumn("line", F.lit(1)))
    best = both.select("tile_id", "y", "x", paint_rank(F.col("line")).alias("rank")).groupBy("tile_id", "y", "x").agg(F.max("rank").alias("rank"))
    return best.select("tile_id", "y", "x", _class_of("rank").alias("class"))


def painted_rows(overlay: DataFrame, tiles: DataFrame, grid: int) -> DataFrame:
    """(tile_id, y, classes): a grid's painted rows as bytes, and one row at least of every tile that has an overlay.

    As ``paint`` of ``fill_areas`` and ``buffer_lines``, without a row for each pixel of each way: a tile's ways
    are dealt into ``PORTIONS``, which tasks paint into a grid each, from the highest rank down until no way can
    change a pixel any more, and of its portions' grids a pixel takes the highest rank.  What is shuffled is the
    ways, and then at most the portions' grids.
    """
    px = pixelised(overlay, tiles, grid)
    kind = px.schema["tile_id"].dataType.simpleString()
    portion = F.pmod(F.xxhash64("way_id"), F.lit(PORTIONS))
    dealt = px.select("tile_id", portion.alias("portion"), "is_area", paint_rank(F.when(F.col("is_area"), 0).otherwise(1)).alias("rank"), "px", "radius")
    dealt = dealt.repartition("tile_id", "portion").sortWithinPartitions("tile_id", F.desc("rank")).drop("portion")
    rows = dealt.mapInArrow(spans.painted(grid), f"tile_id {kind}, y int, ranks binary")
    return rows.repartition("tile_id", "y").sortWithinPartitions("tile_id", "y").mapInArrow(spans.highest, f"tile_id {kind}, y int, classes binary")


def painted_pixels(rows: DataFrame) -> DataFrame:
    """(tile_id, y, x, class) of ``painted_rows`` (sparse: what is not painted is left out)."""
    return rows.mapInArrow(spans.pixels, f"tile_id {rows.schema['tile_id'].dataType.simpleString()}, y int, x int, class int")


def build_mask(overlay: DataFrame, tiles: DataFrame, grid: int) -> DataFrame:
    """Painted pixels of every tile that has an overlay (sparse: class 0 is left out)."""
    return painted_pixels(painted_rows(overlay, tiles, grid))


def dense(mask: DataFrame, tiles: DataFrame, grid: int) -> DataFrame:
    """Every pixel of the given tiles, 0 where nothing was painted."""
    full = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return full.join(mask, ["tile_id", "y", "x"], "left").select("tile_id", "y", "x", F.coalesce("class", F.lit(0)).alias("class"))


def run_lengths(pixels: DataFrame, grid: int, key: str = "tile_id", most: int = LONGEST_RUN) -> DataFrame:
    """(key, start, len, class): maximal runs in row-major order, cut at ``most``."""
    at = (F.col("y") * grid + F.col("x")).cast("bigint")
    rows = pixels.select(key, at.alias("i"), "class")
    island = F.col("i") - F.row_number().over(Window.partitionBy(key, "class").orderBy("i"))
    runs = rows.withColumn("island", island).groupBy(key, "class", "island").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    cut = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / most))))
    return cut.select(key, (F.col("first") + F.col("k") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("k") * most).cast("bigint").alias("len"), "class")


def painted_runs(mask: DataFrame, tiles: DataFrame, grid: int, key: str = "tile_id", most: int = LONGEST_RUN) -> DataFrame:
    """``run_lengths`` of the given tiles' grids from their painted pixels alone: what lies between is 0.

    A tile gives a bound before and after its grid, so that every gap has a painted pixel or a bound at
    its end.  The cost follows what is painted, not the grid.
    """
    cells = grid * grid
    painted = mask.join(tiles.select(key), key, "left_semi").select(key, (F.col("y") * grid + F.col("x")).cast("bigint").alias("i"), "class")
    ends = tiles.select(key, F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(cells).cast("bigint"))).alias("i"), F.lit(-1).alias("class"))
    turn = Window.partitionBy(key).orderBy("i")
    rows = painted.unionByName(ends).withColumns({"before": F.lag("i").over(turn), "kind": F.lag("class").over(turn)}).filter("before is not null")
    gap = F.when(F.col("i") > F.col("before") + 1, F.struct((F.col("before") + 1).alias("first"), F.lit(0).alias("class")))
    fresh = F.when((F.col("i") > F.col("before") + 1) | (F.col("class") != F.col("kind")), F.struct(F.col("i").alias("first"), "class"))
    starts = rows.select(key, F.explode(F.array_compact(F.array(gap, fresh))).alias("s")).select(key, "s.*")
    # runs of class 0 that were painted so join the gaps beside them
    at = Window.partitionBy(key).orderBy("first")
    starts = starts.withColumn("kind", F.lag("class").over(at)).filter("kind is null or kind <> class").drop("kind")
    runs = starts.withColumn("n", F.lead("first").over(at) - F.col("first")).filter("class >= 0")
    cut = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / most))))
    return cut.select(key, (F.col("first") + F.col("k") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("k") * most).cast("bigint").alias("len"), "class")


def runs_by_row(runs: DataFrame, grid: int, key: str = "tile_id") -> DataFrame:
    """(key, y, runs): for each row of a grid its runs as (x where it begins, class), in order.

    ``runs`` are those of ``run_lengths``; a row has as many entries as classes change in it, and one.
    """
    last = F.col("start") + F.col("len") - 1
    rows = runs.select(key, "start", "class", F.explode(F.sequence(F.expr(f"start div {grid}"), F.floor(last / grid))).alias("y"))
    x = F.greatest(F.col("start") - F.col("y") * grid, F.lit(0))
    return rows.groupBy(key, F.col("y").cast("int").alias("y")).agg(F.array_sort(F.collect_list(F.struct(x.cast("int").alias("x"), "class"))).alias("runs"))


def expand_runs(runs: DataFrame, grid: int, key: str = "tile_id") -> DataFrame:
    """Pixels from runs in their order; a run's place is the sum of those before it."""
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("at", F.coalesce(F.sum("len").over(before), F.lit(0).cast("bigint"))).filter("len > 0")
    cells = placed.select(key, "class", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("i"))
    return cells.select(key, F.expr(f"cast(i div {grid} as int)").alias("y"), F.expr(f"cast(i % {grid} as int)").alias("x"), "class")
