"""Streams of tile files: each micro-batch parses what is new and adds to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselon.operators import cloud
from tesselon.sources import codec


def _new_files(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*.{codec.EXTENSION}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)


def tile_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """New tile files below a folder, as a streaming table of tiles (errors in a column)."""
    return codec.parse_tiles(_new_files(spark, folder, files_per_batch))


def ingest_points(spark: SparkSession, folder: str, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the points of new tiles to a Parquet table; the checkpoint makes each file count once."""
    points = codec.points_of(tile_stream(spark, folder).filter("error is null"))
    writer = points.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def keep_headers(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = True, files_per_batch: int = 64) -> StreamingQuery:
    """Keep a row for each tile file in a table as files come; of new files the headers alone are read.

    A micro-batch writes a folder of its own, named by its number, so that one that is run again takes the
    place of its first run.
    """
    headers = codec.parse_headers(_new_files(spark, folder, files_per_batch)).filter("error is null").select("path", "n", F.col("units_per_metre").alias("upm"), "ax", "ay", "az")

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = headers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_stats(spark: SparkSession, table: str) -> DataFrame:
    """Statistics of all tiles seen so far, from the rows that :func:`keep_headers` keeps.

    The spread is measured from a centre that moves with every tile, so it is taken over the tiles' rows,
    which are few beside their points.
    """
    return cloud.dataset_stats(spark.read.schema("path string, n long, upm long, ax long, ay long, az long, batch long").parquet(table))
