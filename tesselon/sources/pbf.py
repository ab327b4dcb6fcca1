"""Map extracts in the public protocol-buffer format: nodes, dense nodes, ways with tags and references.

Tasks list the blocks of a file's ranges by their headers, and then read and decode a block each.
Relations are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tesselon.sources import files

#: Bytes of a file whose blocks one task lists.
SPLIT = 64 << 20
#: Blocks that a task reads one each, and how many a task reads where there are more.
APART, TOGETHER = 256, 16
#: The longest header that the format allows (fixed value), and how a header names its type.
LONGEST_HEAD = 64 << 10
_TYPE = re.compile(rb"\x0a\x07OSMData|\x0a\x09OSMHeader")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; whole numbers or byte strings."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def packed(data: bytes) -> np.ndarray:
    """All whole numbers of a packed field at once."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    if not len(last) or last[-1] != len(b) - 1:
        raise ValueError("a packed field ends within a number")
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def zigzag(v):
    return (v >> 1) ^ -(v & 1)


def running(data: bytes) -> np.ndarray:
    """The running sums of a packed field of signed differences."""
    v = packed(data)
    return np.cumsum((v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64))


def _head(f: pa.NativeFile, at: int, size: int) -> tuple[bytes, int, int] | None:
    """(type, where the body begins, where it ends) of the block header at ``at``; None if there is none."""
    f.seek(at)
    start = f.read(4)
    if len(start) < 4:
        return None
    (n,) = struct.unpack(">I", start)
    if not 0 < n <= LONGEST_HEAD:
        return None
    try:
        head = dict(fields(f.read(n)))
        kind, body = head[1], head[3]
    except (IndexError, KeyError, ValueError):
        return None
    begin = at + 4 + n
    if not (isinstance(kind, bytes) and kind.isalnum() and isinstance(body, int) and begin + body <= size):
        return None
    return kind, begin, begin + body


def _first_block(f: pa.NativeFile, first: int, end: int, size: int) -> int | None:
    """Where the first block header from ``first`` on begins, before ``end``.

    A header names its type behind four bytes of length.  What looks like one counts if it reads as a
    header whose body ends where the file does or another header begins.
    """
    if not first:
        return 0
    at, tail = first, b""
    while at < min(size, end + LONGEST_HEAD):
        f.seek(at)
        data = tail + f.read(1 << 20)
        base = at - len(tail)
        for m in _TYPE.finditer(data):
            start = base + m.start() - 4
            if first <= start < end and (head := _head(f, start, size)) and (head[2] == size or _head(f, head[2], size)):
                return start
        at += 1 << 20
        tail = data[-16:]
    return None


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, part, first byte, byte after the last, size) -> (path, part, place, offset, bytes) of data blocks."""
    for path, part, first, end, size in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        fs, name = files.filesystem(path)
        rows = []
        with fs.open_input_file(name) as f:
            at = _first_block(f, first, end, size)
            while at is not None and at < end:
                head = _head(f, at, size)
                if head is None:
                    raise ValueError(f"no block at byte {at} of {path}")
                kind, begin, at = head
                if kind == b"OSMData":
                    rows.append((begin, at - begin))
            if at is not None and at < size and _head(f, at, size) is None:  # the range after would not find it
                raise ValueError(f"no block at byte {at} of {path}")
        n = len(rows)
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), ()))]
        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()), *columns], names=["path", "part", "place", "offset", "size"])


def blocks(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, block, offset, size) of the data blocks of a file, or of a folder's files by name.

    Files are cut into ranges of ``split`` bytes.  A task finds the first block that begins in its range
    and goes from header to header; bodies are not read.  Blocks are numbered by the counts of the ranges.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pbf").load(path).select("path", "length").filter("length > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long")))
    ranges = found.select("path", cut.alias("first"), "length").select("path", F.expr(f"first div {split}").alias("part"), "first", F.least(F.col("first") + split, F.col("length")).alias("end"), "length")
    listed = files.checkpointed(ranges.repartition(max(1, min(ranges.count(), 1 << 16))).mapInArrow(_listed, "path string, part long, place long, offset long, size long"))
    before = Window.partitionBy(F.lit(0)).orderBy("path", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = listed.groupBy("path", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))  # a row for each range
    numbered = listed.join(counts, ["path", "part"]).select("path", (F.col("before") + F.col("place")).alias("block"), "offset", "size")
    return numbered.repartition(_tasks(listed.count()), "block")


def _tasks(n: int) -> int:
    """Tasks for ``n`` blocks, which are small: one each for few, several for many."""
    return max(1, min(n, APART), min(n // TOGETHER, 4096))


def decode(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("a blob in an unknown compression")


def read_block(data: bytes, want_nodes: bool = True, want_ways: bool = True, keys: frozenset[str] | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[tuple]]:
    """((ids, lon, lat), [(id, tags, refs, place)]) of a primitive block; ``place`` counts its ways.

    What is not wanted is passed over.  With ``keys``, so are ways that have none of them; a block whose
    strings hold none gives no way.
    """
    strings: list[str] = []
    groups: list[bytes] = []
    grain, lat0, lon0 = 100, 0, 0
    for n, v in fields(data):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif n == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    wanted = None if keys is None else {i for i, x in enumerate(strings) if x in keys}
    want_ways = want_ways and (wanted is None or bool(wanted))
    place = -1
    single: list[tuple[int, int, int]] = []
    nodes = [np.zeros((3, 0), np.int64)]
    ways = []
    for group in groups:
        for n, v in fields(group):
            if n == 1 and want_nodes:
                f = dict(fields(v))
                single.append((zigzag(f[1]), zigzag(f[9]), zigzag(f[8])))
            elif n == 2 and want_nodes:
                f = dict(fields(v))
                nodes.append(np.stack([running(f[k]) for k in (1, 9, 8)]))
            elif n == 3 and want_ways:
                place += 1
                f = dict(fields(v))
                named = packed(f.get(2, b"")).tolist()
                if wanted is not None and wanted.isdisjoint(named):
                    continue
                tags: dict[str, str] = {}
                for a, b in zip(named, packed(f.get(3, b"")).tolist(), strict=True):
                    tags.setdefault(strings[a], strings[b])
                ways.append((f[1] - (1 << 64) if f[1] >> 63 else f[1], tags, running(f.get(8, b"")), place))
    ids, lon, lat = np.concatenate([np.array(single, np.int64).reshape(-1, 3).T, *nodes], axis=1)
    return (ids, 1e-9 * (lon0 + grain * lon), 1e-9 * (lat0 + grain * lat)), ways


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for path, block, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = files.filesystem(path)
            with fs.open_input_file(name) as f:
                f.seek(offset)
                yield block, decode(f.read(size))


def read_nodes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, split: int = SPLIT) -> DataFrame:
    """(node_id, lon, lat); with ``box`` (west, south, east, north) those inside or on its border, sifted where
    they are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _bodies(batches):
            ids, lon, lat = read_block(data, want_ways=False)[0]
            if box is not None:
                inside = (lon >= box[0]) & (lon <= box[2]) & (lat >= box[1]) & (lat <= box[3])
                ids, lon, lat = ids[inside], lon[inside], lat[inside]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, lon, lat)], names=list("abc"))

    return blocks(spark, path, split).mapInArrow(run, "node_id long, lon double, lat double")


def read_ways(spark: SparkSession, path: str, keys: Iterable[str] | None = None, split: int = SPLIT) -> DataFrame:
    """(way_id, seq, tags, refs); ``seq`` is the way's place in the file.  With ``keys``, ways with any of these
    tags; blocks that name none are not decoded further."""
    wanted = None if keys is None else frozenset(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in _bodies(batches):
            ways = read_block(data, want_nodes=False, keys=wanted)[1]
            if not ways:
                continue
            ids, tags, refs, places = zip(*ways, strict=True)
            order = [(block << 24) | i for i in places]
            ends = np.cumsum([0, *map(len, refs)])
            refs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *refs])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(order, pa.int64()), pa.array([list(t.items()) for t in tags], pa.map_(pa.string(), pa.string())), refs], names=list("abcd"))

    return blocks(spark, path, split).mapInArrow(run, "way_id long, seq long, tags map<string,string>, refs array<long>")
