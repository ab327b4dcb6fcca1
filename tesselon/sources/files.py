"""Files in any of the cluster's stores, through Arrow's file systems."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below ``spark.checkpoint.dir``; a local session without that (tests) gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tesselon-')}"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the checkpoint folder, which Spark clears as it is told to."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(fresh_folder(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()


class Scratch:
    """Tables of a job that go when its block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, rows: DataFrame, kind: str) -> DataFrame:
        """``rows`` written as Parquet in a fresh shared folder and read again: computed once, and kept
        when executors go."""
        self.paths.append(fresh_folder(self.spark, kind))
        rows.write.parquet(self.paths[-1])
        return self.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for path in self.paths:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(fs: pafs.FileSystem, path: str, data: bytes, attempt: str) -> None:
    """Write under a temporary name, then move: a reader never sees half a file."""
    with appearing(fs, path, attempt) as out:
        out.write(data)


@contextlib.contextmanager
def appearing(fs: pafs.FileSystem, path: str, attempt: str) -> Iterator[pa.NativeFile]:
    """A stream into a temporary name, which is moved once all is written."""
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.{name}.{attempt}"
    with fs.open_output_stream(temporary, compression=None) as out:
        yield out
    move(fs, temporary, path)


def move(fs: pafs.FileSystem, temporary: str, path: str) -> None:
    """Give a finished file its final name; one of that name goes."""
    if isinstance(fs, pafs.LocalFileSystem):
        os.replace(temporary, path)
    else:
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_file(path)
        fs.move(temporary, path)
