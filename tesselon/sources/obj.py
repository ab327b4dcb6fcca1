"""Vertex scans of mesh text: from lines, from files, and from archives."""

from __future__ import annotations

import contextlib
import io
import itertools
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tesselon.functions import geo, names
from tesselon.sources import files

# What the text format takes as a number; more than a plain decimal, less than the engine's casts.
_PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_OTHER = r"^[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_BLANKS = " \t\n\x0b\f\r"


def vertices(lines: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """Rows of ``lines`` that are vertices, with x, y, z.

    A record is ``v``, a blank and three numbers; what follows is ignored.  Non-finite vertices go.
    A record without three numbers fails the query (``strict``) or is dropped.
    """
    text = F.trim(F.col(line), F.lit(_BLANKS))

    def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
        # a generated row: else each use of the value would parse the line again
        return rows.select("*", F.explode(F.array(value)).alias(name))

    rows = once(lines.withColumn("_t", text).filter(F.col("_t").startswith("v ")), F.split("_t", r"\s+", 5), "_p")

    def value(i: int) -> Column:
        raw = F.get(F.col("_p"), F.lit(i))
        other = F.when(F.lower(raw).contains("nan"), F.lit(float("nan"))).when(raw.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        bad = F.raise_error(F.concat(F.lit("not a vertex: "), F.col("_t"))).cast("double") if strict else F.lit(None).cast("double")
        # other records never get here, whatever order the optimiser gives the filters
        return F.when(~F.col("_t").startswith("v "), F.lit(None).cast("double")).when(F.coalesce(raw.rlike(_PLAIN), F.lit(False)), raw.try_cast("double")).when(F.coalesce(raw.rlike(_OTHER), F.lit(False)), other).otherwise(bad)

    rows = once(rows, F.struct(*[value(i).alias(c) for i, c in enumerate("xyz", 1)]), "_d")
    out = rows.select(*lines.columns, "_d.x", "_d.y", "_d.z")
    return out.filter(geo.finite(F.col("x"), F.col("y"), F.col("z")))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, ext) of meshes and archives below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    ext = F.lower(names.extension(F.col("path")))
    return found.select("path", names.stem(F.col("path")).alias("stem"), ext.alias("ext")).filter(F.col("ext").isin("obj", "zip"))


#: Bytes of a mesh text that one task reads.
SPLIT = 32 << 20
#: Lines handled at once.
LINES = 50_000


def _splits(split: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (path) -> (path, part, first byte, byte after the last); an archive is one part."""
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            fs, name = files.filesystem(path)
            size = fs.get_file_info(name).size
            if size is None:
                raise FileNotFoundError(path)
            step = max(1, size) if path.endswith(".zip") else split
            first = list(range(0, max(1, size), step))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(first)), *(pa.array(x, pa.int64()) for x in (range(len(first)), first, [min(size, x + step) for x in first]))], names=["path", "part", "first", "end"])

    return run


def _text_of(f: pa.NativeFile, first: int, end: int) -> io.BytesIO:
    """The lines that begin from byte ``first`` on, before byte ``end``."""
    at = max(0, first - 1)  # a line begins where the byte before it ends another
    f.seek(at)
    data = bytearray(f.read(end - at))
    while len(data) == end - at and not data.endswith(b"\n") or len(data) > end - at and b"\n" not in data[end - at - 1 :]:
        more = f.read(1 << 16)
        if not more:
            break
        data += more
    begin = data.find(b"\n") + 1 if first else 0
    if first and not 0 < begin <= end - at:
        return io.BytesIO()  # the range lies within a line that began before it
    stop = data.find(b"\n", max(0, end - at - 1))
    return io.BytesIO(bytes(data[begin : len(data) if stop < 0 else stop + 1]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, part, first, end in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        with contextlib.ExitStack() as open_:
            fs, name = files.filesystem(path)
            f = open_.enter_context(fs.open_input_file(name))
            if path.endswith(".zip"):
                z = open_.enter_context(zipfile.ZipFile(f))
                inner = next((n for n in z.namelist() if n.lower().endswith(".obj")), None)
                if inner is None:
                    raise ValueError(f"no mesh in {path}")
                f = open_.enter_context(z.open(inner))
            else:
                f = _text_of(f, first, end)
            at = 0
            for some in itertools.batched(io.TextIOWrapper(f, "utf-8", newline="\n"), LINES):
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([x.removesuffix("\n") for x in some], pa.string())], names=["path", "part", "line_no", "line"])
                at += n


def read_lines(spark: SparkSession, paths: str | DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, part, line_no, line) of mesh files; of an archive, its first member that is a mesh.

    ``paths`` is a folder, or a table with a column ``path``.  A text is cut into parts of ``split`` bytes, at
    line ends, which tasks read apart; ``line_no`` counts within a part.  An archive is read as a stream, so
    that one of any size takes little memory.
    """
    found = read_files(spark, paths) if isinstance(paths, str) else paths
    found = found.select("path").distinct()
    parts = files.checkpointed(found.repartition(max(1, min(found.count(), 4096))).mapInArrow(_splits(split), "path string, part long, first long, end long"))
    return parts.repartition(max(1, min(parts.count(), 1 << 16))).mapInArrow(_lines, "path string, part long, line_no long, line string")


def numbered(rows: DataFrame, group: str = "path", part: str = "part", order: str = "place", keep: Callable[[DataFrame], DataFrame] = files.checkpointed) -> DataFrame:
    """``rows`` with ``vid``, their place in the group: places within parts, and the counts of the parts before.

    ``order`` counts a part's rows from any number on, without a gap, so a part gathers no rows and none is sorted.
    ``rows`` is read twice, and must give the same both times; ``keep`` holds a row for each part.
    """
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(group, part).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    shift = parts.select(group, part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(keep(shift), [group, part]).withColumn("vid", F.col(order) + F.col("_shift")).drop("_shift")


def read_vertices(spark: SparkSession, paths: str | DataFrame, strict: bool = True, keep: Callable[[DataFrame], DataFrame] = files.checkpointed, split: int = SPLIT) -> DataFrame:
    """(path, vid, x, y, z), ``vid`` counting a file's finite vertices in order.

    Files are parsed once: ``keep`` holds what was parsed until it is numbered.  Rows come in the order in which
    they were parsed.
    """
    rows = vertices(read_lines(spark, paths, split), strict=strict)
    # a part is read by one task, line by line, so the numbers of its vertices there have no gap
    rows = rows.select("path", "part", F.monotonically_increasing_id().alias("place"), "x", "y", "z")
    return numbered(keep(rows), keep=keep).select("path", "vid", "x", "y", "z")
