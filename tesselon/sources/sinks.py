"""The sink of binary tile files, one for each row, which appear when the whole job is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tesselon.functions import names
from tesselon.sources import codec, files

#: The beginning of the name of a list of written files.
MANIFEST = "written"


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the tile files below a folder; contents are not read, a missing folder has none."""
    fs, root = files.filesystem(folder)
    if fs.get_file_info(root).type.name == "NotFound":
        return spark.createDataFrame([], "out_stem string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{codec.EXTENSION}").load(folder)
    return found.select(names.stem(F.col("path")).alias("out_stem"))


def skip_existing(work: DataFrame, folder: str, prefix: str = "prefix") -> DataFrame:
    """Work whose output file is not there yet."""
    return work.withColumn("out_stem", names.stem(F.col(prefix))).join(existing(work.sparkSession, folder), "out_stem", "left_anti").drop("out_stem")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # prefix, name, bytes


class _TileWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job; the driver moves all files when every task is done."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = files.filesystem(self.folder)
        return fs, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, _, temporary = self._place()
        own = f"{temporary}/{TaskContext.get().taskAttemptId()}"
        fs.create_dir(own, recursive=True)
        out, f = [], None
        try:
            for batch in iterator:
                for prefix, part, content, name in zip(*(batch.column(c) for c in ("prefix", "part", "content", "name")), strict=True):
                    if part.as_py() == 0:
                        if f is not None:
                            f.close()
                        f = fs.open_output_stream(f"{own}/{name.as_py()}", compression=None)
                        out.append((prefix.as_py(), f"{TaskContext.get().taskAttemptId()}/{name.as_py()}", 0))
                    elif not out or out[-1][0] != prefix.as_py():
                        raise ValueError(f"points of {prefix.as_py()}, which has no tile")
                    f.write(content.as_buffer())
                    out[-1] = (*out[-1][:2], out[-1][2] + len(content.as_buffer()))
        finally:
            if f is not None:
                f.close()
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root, temporary = self._place()
        rows = sorted(r for m in messages if m for r in m.files)
        named: dict[str, str] = {}
        for prefix, place, _ in rows:
            other = named.setdefault(place.partition("/")[2], prefix)
            if other != prefix:
                raise ValueError(f"{other} and {prefix} would be the same file")
        if len(named) < len(rows):
            raise ValueError("a prefix has several tiles")
        for _, place, _ in rows:
            files.move(fs, f"{temporary}/{place}", f"{root}/{place.partition('/')[2]}")
        fs.create_dir(root, recursive=True)
        table = pa.table({"prefix": pa.array([r[0] for r in rows], pa.string()), "file": pa.array([r[1].partition("/")[2] for r in rows], pa.string()), "bytes": pa.array([r[2] for r in rows], pa.int64())})
        with fs.open_output_stream(f"{root}/{MANIFEST}-{self.job}.parquet", compression=None) as f:
            pq.write_table(table, f)
        self._clear(fs, temporary)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _, temporary = self._place()
        self._clear(fs, temporary)

    @staticmethod
    def _clear(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class TileFiles(DataSource):
    """The sink of tile files: rows (prefix, part, content, name), option ``path``; part 0 begins a file, and the
    parts after it follow in order in the same partition."""

    @classmethod
    def name(cls) -> str:
        return "tesselon_tiles"

    def writer(self, schema: T.StructType, overwrite: bool) -> _TileWriter:
        return _TileWriter(self.options["path"])


def write_tiles(tiles: DataFrame, folder: str, prefix: str = "prefix", overwrite: bool = False) -> DataFrame:
    """Write a file for each row (``prefix`` and the columns of a tile); returns (prefix, file, bytes).

    The name is the prefix's stem.  Without ``overwrite`` existing files stay and their rows are skipped.
    Files appear when the whole job is done: one that fails leaves none.  Prefixes that differ after
    their last dot only would share a file, which is an error, as are several tiles of one prefix.  What
    was written is listed in a manifest beside the files, of which the returned table reads.
    """
    work = tiles if overwrite else skip_existing(tiles, folder, prefix)
    return _write(codec.encode_tiles(work, prefix).withColumn("part", F.lit(0)), folder, prefix)


def write_points(tiles: DataFrame, points: DataFrame, folder: str, prefix: str = "prefix", overwrite: bool = False, order: str | None = None) -> DataFrame:
    """``write_tiles`` of tiles whose points are rows of their own, as for ``codec.encode_pieces``.

    A tile's points stream by in pieces and are never held together; their order in the file is that of the column
    ``order``, or open.  Points without a tile are an error, but without ``overwrite`` those of files that stay are passed over.
    """
    work = tiles
    if not overwrite:
        work = skip_existing(tiles, folder, prefix)
        points = points.join(work.select(prefix), prefix, "left_semi")
    pieces = codec.encode_pieces(work, points, prefix, order)
    return _write(pieces.repartition(prefix).sortWithinPartitions(prefix, "part"), folder, prefix)


def _write(coded: DataFrame, folder: str, prefix: str) -> DataFrame:
    spark = coded.sparkSession
    named = coded.withColumn("name", F.concat(names.stem(F.col(prefix)), F.lit(f".{codec.EXTENSION}")))
    before = _manifests(folder)
    spark.dataSource.register(TileFiles)
    named.select(F.col(prefix).alias("prefix"), "part", "content", "name").write.format(TileFiles.name()).option("path", folder).mode("append").save()
    made = sorted(_manifests(folder) - before)
    out = spark.read.schema("prefix string, file string, bytes long").parquet(*made)
    return out.withColumnRenamed("prefix", prefix)


def _manifests(folder: str) -> set[str]:
    fs, root = files.filesystem(folder)
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return set()
    own = (f.base_name for f in fs.get_file_info(pafs.FileSelector(root)))
    return {f"{folder.rstrip('/')}/{name}" for name in own if name.startswith(f"{MANIFEST}-")}
