"""Loading tiles: labelled points in metres, and statistics of the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions import fixed
from tesselon.operators import cloud
from tesselon.sources import codec


def _rows_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks (path, width, encoding, data) -> (path, y, runs): where classes change in each row."""
    for batch in batches:
        for path, width, encoding, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start, value, cells = codec.runs_of(data, encoding)
            # a run begins where the class changes, and at every row's first pixel
            height = cells // width
            begins = np.union1d(start, np.arange(height) * width)
            begins = begins[begins < height * width]
            value = value[np.searchsorted(start, begins, "right") - 1]
            ends = np.searchsorted(begins, np.arange(height + 1) * width).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array((begins % width).astype(np.int32)), pa.array(value.astype(np.int32))], names=["x", "class"])
            yield pa.RecordBatch.from_arrays([pa.array([path] * height, pa.string()), pa.array(np.arange(height, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), runs)], names=list("abc"))


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(points, tiles): labelled points with Earth-centred metres and offsets, and one row for each tile.

    Files that are no tiles are left out.  Points take their own labels if the tile has them, else the
    class of the mask where the tile has an extent and a mask over its box, else 0.  Points are read where
    points are asked for; masks and statistics come from the files' other parts.
    """
    flat = codec.read_points(spark, folder)
    tiles = codec.read_headers(spark, folder, masks=True).filter("error is null")
    metres = flat.withColumns({f"e{a}": fixed.dequantise(F.col(f"a{a}") + F.col(f"d{a}"), F.col("units_per_metre")) for a in "xyz"})
    masked = tiles.filter((F.col("mask.coord_space") == codec.SPACE_BOX) & F.col("extent").isNotNull())
    sizes = masked.select("path", F.col("mask.width").alias("width"), F.col("mask.height").alias("height"), *[F.col(f"extent.{c}").alias(f"{c}_q7") for c in ("lon_min", "lon_max", "lat_min", "lat_max")])
    grid = masked.select("path", F.col("mask.width").alias("width"), F.col("mask.encoding").cast("int").alias("encoding"), F.col("mask.data").alias("data")).mapInArrow(_rows_of_runs, "path string, y int, runs array<struct<x:int,class:int>>")
    columns = ["path", "pid", "dx", "dy", "dz", "units_per_metre", "ax", "ay", "az", "ex", "ey", "ez", "label"]
    points = cloud.label_points(metres.select(*columns).withColumn("label", F.col("label").cast("int")), grid, cloud.sent(sizes), F.col("width"), "path", height=F.col("height"))
    return points, summary(spark, folder)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n, upm, ax, ay, az, tile_key) of the tiles below a folder, from their headers alone."""
    tiles = codec.read_headers(spark, folder).filter("error is null")
    return tiles.select("path", "n", F.col("units_per_metre").alias("upm"), "ax", "ay", "az", "tile_key")


def stats(tiles: DataFrame) -> DataFrame:
    return cloud.dataset_stats(tiles)
