"""Points in boxes, way geometry, and the features that touch each tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions import classify, geo
from tesselon.operators import ordered

#: Boxes up to this count may be compared with every point.
BROADCAST_TILES = 2000


def pad_tiles(tiles: DataFrame, margin_m: float = 50.0) -> DataFrame:
    """Tiles with boxes widened by a margin at their centre's latitude."""
    lat, lon = geo.pad_degrees(0.5 * (F.col("lat_min") + F.col("lat_max")), margin_m)
    return tiles.withColumns({"lon_min": F.col("lon_min") - lon, "lon_max": F.col("lon_max") + lon, "lat_min": F.col("lat_min") - lat, "lat_max": F.col("lat_max") + lat})


def _inside() -> Column:
    return F.col("lon").between(F.col("t.lon_min"), F.col("t.lon_max")) & F.col("lat").between(F.col("t.lat_min"), F.col("t.lat_max"))


def in_boxes_broadcast(points: DataFrame, tiles: DataFrame, most: int = BROADCAST_TILES) -> DataFrame:
    """Each point with each box that holds it, borders included, by comparing it with all boxes.

    For few boxes, whose count is looked at; beyond ``most`` the join on cells takes over.
    """
    if len(tiles.select("tile_id").take(most + 1)) > most:
        return in_boxes_cells(points, tiles)
    few = F.broadcast(tiles.select("tile_id", "lon_min", "lat_min", "lon_max", "lat_max").alias("t"))
    return points.join(few, _inside()).select(*points.columns, F.col("t.tile_id").alias("tile_id"))


def in_boxes_cells(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """The same through an equi-join on grid cells, for any number of boxes.

    A box is listed under the cells it overlaps in a grid whose cells are as wide as the box or less
    than twice that, so under nine at most, whatever its size; points are placed in each such grid,
    of which there are as many as powers of two among the sizes.  Nothing is broadcast by force: a small
    table of cells becomes a hash table by itself, and a crowded cell is one join key, which adaptive
    execution splits.
    """
    size = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"), F.lit(2.0**-20))
    boxes = tiles.select("tile_id", "lon_min", "lat_min", "lon_max", "lat_max", F.ceil(F.log2(size)).cast("int").alias("level")).filter("lon_min <= lon_max and lat_min <= lat_max")
    levels = sorted(r.level for r in boxes.select("level").distinct().collect())

    def at(c: Column, level: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), level)).cast("bigint")

    level = F.col("level")
    cells = boxes.withColumn("cx", F.explode(F.sequence(at(F.col("lon_min"), level), at(F.col("lon_max"), level))))
    cells = cells.withColumn("cy", F.explode(F.sequence(at(F.col("lat_min"), level), at(F.col("lat_max"), level)))).alias("t")
    if len(levels) == 1:
        placed = points.withColumn("_level", F.lit(levels[0]))
    else:
        placed = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    placed = placed.withColumns({"_cx": at(F.col("lon"), F.col("_level")), "_cy": at(F.col("lat"), F.col("_level"))})
    same = (F.col("_level") == F.col("t.level")) & (F.col("_cx") == F.col("t.cx")) & (F.col("_cy") == F.col("t.cy"))
    return placed.join(cells, same & _inside()).select(*points.columns, F.col("t.tile_id").alias("tile_id"))


def in_boxes(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each point with each box that holds it, borders included."""
    return in_boxes_cells(points, tiles)


def keep_nodes(nodes: DataFrame, padded: DataFrame) -> DataFrame:
    """(node_id, lon, lat, tile_id) of nodes in at least one padded tile, a row for each."""
    return in_boxes(nodes.select("node_id", "lon", "lat"), padded)


def resolve_ways(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """(way_id, verts) with verts the kept nodes in reference order; missing nodes close the gap.

    Repeated references stay.  A way's vertices form one row, as a way is one feature.
    """
    nodes = kept.select("node_id", "lon", "lat").dropDuplicates(["node_id"])
    found = refs.select("way_id", "seq", "node_id").join(nodes, "node_id")
    return found.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "node_id"))).alias("verts"))


def way_tiles(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct (way_id, tile_id): the tiles that any of a way's nodes touches."""
    return refs.select("way_id", "node_id").join(kept.select("node_id", "tile_id"), "node_id").select("way_id", "tile_id").distinct()


def placed_ways(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """(way_id, verts, tiles): ``resolve_ways`` and ``way_tiles`` from one join and one grouping.

    A node in several tiles meets its way once for each, so both are sets.
    """
    found = refs.select("way_id", "seq", "node_id").join(kept.select("node_id", "lon", "lat", "tile_id"), "node_id")
    return found.groupBy("way_id").agg(F.array_sort(F.collect_set(F.struct("seq", "lon", "lat", "node_id"))).alias("verts"), F.collect_set("tile_id").alias("tiles"))


def classified(ways: DataFrame) -> DataFrame:
    """Ways with class, width_m and is_area; unmatched ways go.  ``natural`` is column natural_tag."""
    names = {"natural": "natural_tag"}
    found = ways.withColumn("_c", classify.way_class(lambda k: F.col(names.get(k, k)))).filter("_c is not null")
    return found.select("way_id", F.col("_c.class").alias("class"), F.col("_c.width_m").alias("width_m"), F.col("_c.is_area").alias("is_area"))


def overlay(ways: DataFrame, refs: DataFrame, kept: DataFrame) -> DataFrame:
    """(tile_id, way_id, class, width_m, is_area, verts): whole geometries, once for each tile touched.

    Areas need three vertices, lines two.  Geometry is attached before the fan-out to tiles.
    """
    return features(classified(ways), refs, kept).select("tile_id", "way_id", "class", "width_m", "is_area", "verts")


def features(kinds: DataFrame, refs: DataFrame, kept: DataFrame) -> DataFrame:
    """``kinds`` (way_id, is_area, ...) with ``verts``, a row for each tile that a way of enough vertices touches."""
    geometry = placed_ways(refs, kept).join(kinds, "way_id").filter(F.size("verts") >= F.when(F.col("is_area"), 3).otherwise(2))
    return geometry.withColumn("tile_id", F.explode("tiles")).drop("tiles")


def resolve_prefixes(wanted: DataFrame, files: DataFrame, prefer_zip: bool = True) -> DataFrame:
    """(prefix, path, exact): the file of each prefix, null where none matches.

    An equal stem wins, a zip before others.  Else the smallest stem that begins with the prefix, and
    of its files the first zip (with ``prefer_zip``) or the first; files count in path order.  A null prefix
    has no file.
    """
    zip_last = F.when(F.lower("ext") == "zip", 0).otherwise(1)
    zip_first, path = F.struct(zip_last.alias("z"), F.col("path")), F.col("path")
    # a row for each stem: its file where it is equal, and where it only begins with a prefix
    stems = files.groupBy("stem").agg(F.min(zip_first)["path"].alias("equal"), (F.min(zip_first)["path"] if prefer_zip else F.min(path)).alias("other"))
    stems = stems.select(F.col("stem").alias("prefix"), F.struct("equal", "other").alias("file"))
    # what begins with a prefix stands right after it in order, so the first of it is the next stem, or there is none
    found = ordered.next_in_order(wanted, stems, "prefix", "file")
    equal = F.col("next") == F.col("prefix")
    match = F.when(equal, F.col("file.equal")).when(F.col("next").startswith(F.col("prefix")), F.col("file.other"))
    found = found.select("prefix", match.alias("path"), F.coalesce(equal, F.lit(False)).alias("exact"))
    return wanted.join(found, "prefix", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
