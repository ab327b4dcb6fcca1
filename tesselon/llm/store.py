"""Shared storage for files that operators write and read back.

Executors and the driver share only the folder that ``spark.checkpoint.dir`` names.  Everything an
operator materialises (archives, shards, intermediate tables) goes below it, under a fresh name.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local session (tests) gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own.get(context.applicationId)
        if root is None:
            root = _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tesselon-')}"
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, uri: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = uri or fresh_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of a table that are broadcast at once, of about 100 bytes each, and how many such parts at most.
LOOKUP, PARTS = 1 << 19, 8


def lookups(table: DataFrame, key: Column) -> list[Callable[[DataFrame], DataFrame]]:
    """Ways to take the rows of wide tables whose ``key`` may be in ``table`` without moving them.

    Each is to be applied to the wide table and to ``table``, and the results to be joined, with a
    broadcast of the second: a part of the keys, by hash.  The table's size is looked at; beyond
    PARTS * LOOKUP keys the list is empty, and a plain join is the way.
    """
    parts = max(1, -(-table.count() // LOOKUP))
    if parts > PARTS:
        return []
    return [lambda d, p=p: d if parts == 1 else d.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p) for p in range(parts)]


class Scratch:
    """Intermediate tables of an operator, which go when its block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, kind: str) -> DataFrame:
        self.paths.append(fresh_dir(self.spark, kind))
        return written(df, kind, self.paths[-1])

    def drop(self, keep: int) -> None:
        """Delete all tables but the ``keep`` latest."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        delete(self.spark, *gone)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop(0)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder and the folder's path there (local, HDFS, S3, GCS)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


#: Rows that a Python function turns into Python objects at once.
SLICE = 1000


def by_slices(run: Callable, rows: int = SLICE) -> Callable:
    """A function over Arrow batches that sees a few rows at a time and hands back its memory.

    Workers live on between tasks and stages; what one leaves unused would add to what the next needs.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            release()

    return wrapped


def small_batches(spark: SparkSession, rows: int = SLICE, size: int = 16 << 20) -> None:
    """Ask a session for small Arrow batches: executors keep buffers as large as the largest.

    For jobs whose executors are small; the corpus queries call it, the operators do not.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def commit(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Move a finished file to its final name; a second attempt's equal file replaces the first."""
    if isinstance(fs, pafs.LocalFileSystem):
        os.replace(temporary, final)
    else:
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            fs.delete_file(final)
        fs.move(temporary, final)
