"""The batch conversion as one plan: meshes, footprints and a map to quantised, masked tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions import classify, names
from tesselon.operators import raster, spatial, tiles as tiling
from tesselon.sources import codec, features, files, obj, pbf, sinks


@dataclass(frozen=True)
class Options:
    """Parameters of a conversion, with the defaults of the command line they stand for."""

    units_per_metre: int = 1000
    system: str | None = None  # geodetic, ecef, local_m; None: detected for each file
    prefer_zip: bool = True
    overwrite: bool = False
    write_extent: bool = True
    write_mask: bool = True
    compress_mask: bool = True
    grid: int = 512
    margin_m: float = 50.0


def plan_work(spark: SparkSession, folder: str, index: str | None, options: Options) -> DataFrame:
    """(tile_id, prefix, path, box columns): what can be converted.

    With an index its features that resolve to a file; without, every stem, with no box.
    """
    files = obj.read_files(spark, folder)
    if index is None:
        best = files.groupBy("stem").agg(F.min(F.struct(F.when(F.col("ext") == "zip", 0).otherwise(1), F.col("path"))).alias("m"))
        none = F.lit(None).cast("double")
        work = best.select(F.col("stem").alias("prefix"), F.col("m.path").alias("path"), *[none.alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])
    else:
        work = spatial.resolve_prefixes(features.read_index(spark, index), files, options.prefer_zip).filter("path is not null").drop("exact")
    return work.withColumn("tile_id", F.col("prefix"))


def overlays(spark: SparkSession, work: DataFrame, osm: str, options: Options, scratch: files.Scratch) -> DataFrame:
    """Features that touch each padded tile; every tile needs a box.  What is returned is not stored."""
    boxed = work.filter(F.coalesce("lon_min", F.raise_error(F.lit("a map overlay needs a box for every tile")).cast("double")).isNotNull())
    padded = spatial.pad_tiles(boxed, options.margin_m)
    # nodes outside all boxes together cannot be kept: one row of bounds sifts them before the join
    bounds = padded.agg(*[f(c).alias(c) for c, f in (("lon_min", F.min), ("lat_min", F.min), ("lon_max", F.max), ("lat_max", F.max))]).first()
    nodes = pbf.read_nodes(spark, osm, (bounds.lon_min, bounds.lat_min, bounds.lon_max, bounds.lat_max))
    kept = scratch.stored(spatial.keep_nodes(nodes, padded), "nodes")
    ways = pbf.read_ways(spark, osm, classify.KEYS)
    kind = classify.way_class(lambda k: F.try_element_at("tags", F.lit(k)))
    # and ways of no class need no vertices
    classed = scratch.stored(ways.withColumn("c", kind).filter("c is not null").select("way_id", "seq", "refs", "c"), "ways")
    kinds = classed.select("way_id", "seq", "c.*")
    refs = classed.select("way_id", F.posexplode("refs").alias("seq", "node_id"))
    placed = spatial.features(kinds.withColumnRenamed("seq", "place"), refs, kept)
    # paint order is file order
    return placed.select("tile_id", F.col("place").alias("way_id"), "class", "width_m", "is_area", "verts")


def convert(spark: SparkSession, folder: str, output: str, index: str | None = None, osm: str | None = None, options: Options | None = None) -> DataFrame:
    """Convert and write; returns (prefix, file, bytes) of what was written, once all of it is.

    Tiles are the unit of a file, into which one task writes a tile's points as a stream of pieces; no row
    and no task holds them.  Points keep the order in which they were parsed, and are not shuffled before that.
    """
    with files.Scratch(spark) as scratch:
        return _converted(spark, folder, output, index, osm, options or Options(), scratch)


def _converted(spark: SparkSession, folder: str, output: str, index: str | None, osm: str | None, o: Options, scratch: files.Scratch) -> DataFrame:
    work = plan_work(spark, folder, index, o)
    # written, as what is left to do must not change while tiles appear
    work = scratch.stored(work if o.overwrite else sinks.skip_existing(work, output), "work")
    if work.isEmpty():
        return spark.createDataFrame([], "prefix string, file string, bytes long")
    # written, so that what needs all vertices of a tile before the next step does not parse files again; and what has a
    # row for each tile, so that its size is known and points need no shuffle to meet it
    vertices = obj.read_vertices(spark, work, keep=lambda rows: scratch.stored(rows, "parsed")).join(work.select("path", "prefix"), "path").select("prefix", "vid", "x", "y", "z")
    systems = vertices.select("prefix").distinct().withColumn("cs", F.lit(o.system)) if o.system else tiling.detect_system(vertices, "prefix")
    systems = scratch.stored(systems, "systems")
    boxes = work.select("prefix", "lon_min", "lat_min", "lon_max", "lat_max")
    points = scratch.stored(tiling.to_ecef(vertices, systems, boxes, "prefix"), "points")
    anchored = scratch.stored(tiling.anchors(points, "prefix", o.units_per_metre), "anchors")
    offs = tiling.offsets(points, anchored, "prefix").select("prefix", F.lit(False).alias("labelled"), "vid", "dx", "dy", "dz", F.lit(None).cast("smallint").alias("label"))
    # the points' own bounds stand in for a box; with an index every tile has one
    unboxed = vertices.join(systems.filter("cs = 'geodetic'"), "prefix") if index is None else vertices.limit(0)
    degrees = unboxed.groupBy("prefix").agg(*[f(c).alias(n) for c, f, n in (("x", F.min, "g0"), ("x", F.max, "g1"), ("y", F.min, "g2"), ("y", F.max, "g3"))])
    box = [F.col(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")]
    extent = tiling.choose_extent(box, [F.col(f"g{i}") for i in range(4)]) if o.write_extent else F.lit(None).cast("struct<lon_min:int,lon_max:int,lat_min:int,lat_max:int>")
    out = anchored.join(boxes, "prefix").join(degrees, "prefix", "left").withColumn("extent", extent)
    if osm is not None and o.write_mask:
        out = out.join(mask_column(overlays(spark, work, osm, o, scratch), work, o, scratch), "prefix", "left")
    else:
        out = out.withColumn("mask", F.lit(None).cast("struct<width:int,height:int,coord_space:smallint,encoding:smallint,palette:array<struct<class:smallint,precedence:smallint>>,data:binary>"))
    tiles = out.select("prefix", "n", F.col("upm").alias("units_per_metre"), "ax", "ay", "az", names.tile_key(F.col("prefix")).alias("tile_key"), F.lit(False).alias("labelled"), "extent", "mask")
    return sinks.write_points(tiles, offs, output, overwrite=True, order="vid")


def mask_column(overlay: DataFrame, work: DataFrame, options: Options, scratch: files.Scratch) -> DataFrame:
    """(prefix, mask): a tile's runs as the bytes of its mask; at most grid x grid of them."""
    g = options.grid
    # painted rows are stored, not the ways, which take more; every tile that has an overlay has a row
    rows = scratch.stored(raster.painted_rows(overlay, work, g), "painted")
    runs = raster.painted_runs(raster.painted_pixels(rows), rows.select("tile_id").distinct(), g)
    ordered = F.array_sort(F.collect_list(F.struct("start", "len", "class")))
    code = F.when(F.lit(options.compress_mask), F.lit(codec.RUNS)).otherwise(F.lit(codec.RAW))

    def run_bytes(r):
        byte = lambda v: F.lpad(F.hex(v), 2, "0")
        if options.compress_mask:
            return F.concat(byte(r.len.bitwiseAND(255)), byte(F.shiftright(r.len, 8)), byte(r["class"].cast("bigint")))
        return F.repeat(byte(r["class"].cast("bigint")), r.len.cast("int"))

    palette = F.array(*[F.struct(F.lit(c[0]).cast("smallint").alias("class"), F.lit(c[2]).cast("smallint").alias("precedence")) for c in classify.CLASSES])
    data = F.unhex(F.array_join(F.transform("runs", run_bytes), ""))
    mask = F.struct(F.lit(g).alias("width"), F.lit(g).alias("height"), F.lit(codec.SPACE_BOX).cast("smallint").alias("coord_space"), code.cast("smallint").alias("encoding"), palette.alias("palette"), data.alias("data"))
    return runs.groupBy("tile_id").agg(ordered.alias("runs")).select(F.col("tile_id").alias("prefix"), mask.alias("mask"))
