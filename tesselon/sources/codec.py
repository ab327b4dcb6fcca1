"""The binary tile format: parsing, writing, run lengths, and their DataFrame source and sink.

A file is one tile: a header, an optional key, points as offsets from an anchor with optional labels,
an optional extent, an optional semantic mask.  All numbers are little-endian.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.sources.files import filesystem

# Tags, version, flags and codes of the format.
MAGIC = b"HYPC"
OLD_MAGIC = b"HPC1"
VERSION = 2
EXTENT_TAG = b"GEOT"
MASK_TAG = b"SMC1"
FLAG_KEY, FLAG_LABELS, FLAG_EXTENT, FLAG_MASK = 1, 2, 4, 8
SPACE_DECODED, SPACE_BOX = 0, 1
RAW, RUNS = 0, 1
HEADER_BYTES, KEY_BYTES = 44, 32
EXTENSION = "hypc"
EXTENT = ("lon_min", "lon_max", "lat_min", "lat_max")

TILE_SCHEMA = """units_per_metre long, ax long, ay long, az long, tile_key binary, labelled boolean,
points array<struct<dx:int,dy:int,dz:int,label:smallint>>,
extent struct<lon_min:int,lon_max:int,lat_min:int,lat_max:int>,
mask struct<width:int,height:int,coord_space:smallint,encoding:smallint,palette:array<struct<class:smallint,precedence:smallint>>,data:binary>"""


class TileError(ValueError):
    """The bytes are no valid tile."""


@dataclass
class Mask:
    width: int
    height: int
    coord_space: int
    encoding: int
    palette: list[tuple[int, int]]
    data: bytes

    def grid(self) -> bytes:
        """The classes, row by row."""
        return decode_runs(self.data) if self.encoding == RUNS else self.data


@dataclass
class Tile:
    units_per_metre: int
    anchor: tuple[int, int, int]
    points: np.ndarray  # (n, 3) of 32-bit offsets
    labels: np.ndarray | None = None
    key: bytes | None = None
    extent: tuple[int, int, int, int] | None = None
    mask: Mask | None = None


def encode_runs(data: bytes) -> bytes:
    """Runs as a 16-bit length and a value; longer runs are cut at 65535."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    length = np.diff(np.append(first, len(a)))
    parts = -(-length // 65535)
    out = np.empty(int(parts.sum()), np.dtype([("n", "<u2"), ("v", "u1")]))
    out["v"] = np.repeat(a[first], parts)
    out["n"] = 65535
    out["n"][np.cumsum(parts) - 1] = length - (parts - 1) * 65535
    return out.tobytes()


def decode_runs(data: bytes) -> bytes:
    if len(data) % 3:
        raise TileError("run lengths end within a run")
    runs = np.frombuffer(data, np.dtype([("n", "<u2"), ("v", "u1")]))
    return np.repeat(runs["v"], runs["n"]).tobytes()


def runs_of(data: bytes, encoding: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(where each run begins, its value, number of cells) of a mask's data, which is not expanded."""
    if encoding == RUNS:
        if len(data) % 3:
            raise TileError("run lengths end within a run")
        runs = np.frombuffer(data, np.dtype([("n", "<u2"), ("v", "u1")]))
        runs = runs[runs["n"] > 0]
        ends = np.cumsum(runs["n"].astype(np.int64))
        return ends - runs["n"], runs["v"], int(ends[-1]) if len(ends) else 0
    a = np.frombuffer(data, np.uint8)
    start = np.flatnonzero(np.concatenate([[len(a) > 0], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return start, a[start], len(a)


class _Reader:
    """Reads bytes in order."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at = data, len(data), 0

    def _next(self, n: int) -> bytes:
        return self.data[self.at : self.at + n]

    def take(self, n: int, what: str) -> bytes:
        out = self._next(n)
        self.skip(n, what)
        return out

    def skip(self, n: int, what: str) -> None:
        if self.at + n > self.size:
            raise TileError(f"the file ends within {what}")
        self.at += n

    def unpack(self, form: str, what: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form), what))


class _FileReader(_Reader):
    """The same from an open file, of which only what is taken is read."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at = file, size, 0

    def _next(self, n: int) -> bytes:
        self.file.seek(self.at)
        return self.file.read(n)


def parse(data: bytes) -> Tile:
    """A tile from its bytes; what follows the last part is ignored."""
    return parse_parts(_Reader(data))[0]


def parse_parts(r: _Reader, points: bool = True, masks: bool = True) -> tuple[Tile, int]:
    """(tile, number of points); without ``points`` or the data of ``masks`` these are passed over."""
    if r.take(4, "magic") != MAGIC:
        raise TileError("bad magic")
    version, flags, count, upm = r.unpack("<4I", "header")
    if version != VERSION:
        raise TileError(f"unsupported version {version}")
    if not upm:
        raise TileError("units per metre must be positive")
    anchor = r.unpack("<3q", "anchor")
    key = r.take(KEY_BYTES, "key") if flags & FLAG_KEY else None
    kind = _point_kind(bool(flags & FLAG_LABELS))
    rows = np.zeros(0, kind)
    if points:
        rows = np.frombuffer(r.take(count * kind.itemsize, "points"), kind)
    else:
        r.skip(count * kind.itemsize, "points")
    extent = mask = None
    if flags & FLAG_EXTENT:
        if r.take(4, "extent") != EXTENT_TAG:
            raise TileError("no extent where one was announced")
        extent = r.unpack("<4i", "extent")
    if flags & FLAG_MASK:
        if r.take(4, "mask") != MASK_TAG:
            raise TileError("no mask where one was announced")
        width, height, space, encoding, colours = r.unpack("<HHBBH", "mask")
        if space not in (SPACE_DECODED, SPACE_BOX):
            raise TileError(f"unknown coordinate space {space}")
        if encoding not in (RAW, RUNS):
            raise TileError(f"unknown encoding {encoding}")
        pairs = r.take(2 * colours, "palette")
        (size,) = r.unpack("<I", "mask size")
        data = b""
        if masks:
            data = r.take(size, "mask data")
        else:
            r.skip(size, "mask data")
        mask = Mask(width, height, space, encoding, list(zip(pairs[::2], pairs[1::2], strict=True)), data)
    return Tile(upm, anchor, rows["p"].reshape(-1, 3), rows["l"].copy() if flags & FLAG_LABELS else None, key, extent, mask), count


def dump(tile: Tile) -> bytes:
    points = np.asarray(tile.points, "<i4").reshape(-1, 3)
    if tile.labels is not None and len(tile.labels) != len(points):
        raise TileError("as many labels as points are needed")
    head, tail = frame(tile, len(points), tile.labels is not None)
    return head + _point_bytes(points, tile.labels) + tail


def frame(tile: Tile, count: int, labelled: bool) -> tuple[bytes, bytes]:
    """What stands before and after a file's points."""
    flags = (tile.key is not None) * FLAG_KEY | labelled * FLAG_LABELS | (tile.extent is not None) * FLAG_EXTENT | (tile.mask is not None) * FLAG_MASK
    head = MAGIC + struct.pack("<4I3q", VERSION, flags, count, tile.units_per_metre, *tile.anchor)
    if tile.key is not None:
        head += tile.key[:KEY_BYTES].ljust(KEY_BYTES, b"\0")
    tail = b""
    if tile.extent is not None:
        tail += EXTENT_TAG + struct.pack("<4i", *tile.extent)
    if tile.mask is not None:
        m = tile.mask
        tail += MASK_TAG + struct.pack("<HHBBH", m.width, m.height, m.coord_space, m.encoding, len(m.palette)) + bytes(b for pair in m.palette for b in pair) + struct.pack("<I", len(m.data)) + m.data
    return head, tail


def _point_kind(labelled: bool) -> np.dtype:
    return np.dtype([("p", "<i4", 3), ("l", "u1")] if labelled else [("p", "<i4", 3)])


def _point_bytes(points: np.ndarray, labels: np.ndarray | None) -> bytes:
    rows = np.empty(len(points), _point_kind(labels is not None))
    rows["p"] = points
    if labels is not None:
        rows["l"] = labels
    return rows.tobytes()


# ---------------------------------------------------------------- DataFrames


def _struct(values: tuple[int, ...] | None, names: tuple[str, ...]) -> dict | None:
    return values and dict(zip(names, values, strict=True))


_SMALL = pa.int16()
_ARROW = pa.schema([
    ("path", pa.string()), ("error", pa.string()), ("units_per_metre", pa.int64()), ("ax", pa.int64()), ("ay", pa.int64()), ("az", pa.int64()), ("tile_key", pa.binary()), ("labelled", pa.bool_()),
    ("points", pa.list_(pa.struct([("dx", pa.int32()), ("dy", pa.int32()), ("dz", pa.int32()), ("label", _SMALL)]))),
    ("extent", pa.struct([(n, pa.int32()) for n in ("lon_min", "lon_max", "lat_min", "lat_max")])),
    ("mask", pa.struct([("width", pa.int32()), ("height", pa.int32()), ("coord_space", _SMALL), ("encoding", _SMALL), ("palette", pa.list_(pa.struct([("class", _SMALL), ("precedence", _SMALL)]))), ("data", pa.binary())])),
])


def _one(name: str, value: object) -> pa.Array:
    return pa.array([value], _ARROW.field(name).type)


def to_batch(path: str, tile: Tile | None, error: str | None = None) -> pa.RecordBatch:
    """A row of the tile; its points go from one buffer to another."""
    row = dict.fromkeys(_ARROW.names) | {"path": path, "error": error}
    points = _one("points", None)
    if tile is not None:
        m = tile.mask
        mask = m and {"width": m.width, "height": m.height, "coord_space": m.coord_space, "encoding": m.encoding, "palette": [{"class": a, "precedence": b} for a, b in m.palette], "data": m.data}
        row |= {"units_per_metre": tile.units_per_metre, "tile_key": tile.key, "labelled": tile.labels is not None, "extent": _struct(tile.extent, EXTENT), "mask": mask, **dict(zip(("ax", "ay", "az"), tile.anchor, strict=True))}
        n = len(tile.points)
        label = pa.nulls(n, _SMALL) if tile.labels is None else pa.array(tile.labels.astype(np.int16))
        own = pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(tile.points[:, i])) for i in range(3)), label], names=["dx", "dy", "dz", "label"])
        points = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own)
    return pa.RecordBatch.from_arrays([points if c == "points" else _one(c, row[c]) for c in _ARROW.names], schema=_ARROW)


def from_batch(batch: pa.RecordBatch, at: int) -> Tile:
    """The tile of a row that has a tile's columns."""
    own = {c: batch.column(c)[at] for c in batch.schema.names}
    row = {c: v.as_py() for c, v in own.items() if c != "points"}
    points, labels = np.zeros((0, 3), np.int32), None
    if own["points"].is_valid:
        x = own["points"].values
        points = np.stack([x.field(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("dx", "dy", "dz")], axis=1)
        labels = x.field("label").to_numpy(zero_copy_only=False).astype(np.uint8) if row["labelled"] else None
    elif row["labelled"]:
        labels = np.zeros(0, np.uint8)
    m, e = row["mask"], row["extent"]
    mask = m and Mask(m["width"], m["height"], m["coord_space"], m["encoding"], [(p["class"], p["precedence"]) for p in m["palette"]], m["data"])
    return Tile(row["units_per_metre"], (row["ax"], row["ay"], row["az"]), points, labels, row["tile_key"], e and tuple(e[c] for c in EXTENT), mask)


def _parse_all(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    yield to_batch(path.as_py(), parse(content.as_py()))
                except TileError as e:
                    if strict:
                        raise
                    yield to_batch(path.as_py(), None, str(e))

    return run


def read_tiles(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """A row for each tile file below a folder; a file that is no tile has ``error`` set, or fails (strict)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{EXTENSION}").load(folder)
    return parse_tiles(files, strict)


HEADER_SCHEMA = """path string, error string, n long, units_per_metre long, ax long, ay long, az long, tile_key binary, labelled boolean,
extent struct<lon_min:int,lon_max:int,lat_min:int,lat_max:int>,
mask struct<width:int,height:int,coord_space:smallint,encoding:smallint,palette:array<struct<class:smallint,precedence:smallint>>,data:binary>"""


def read_headers(spark: SparkSession, folder: str, strict: bool = False, masks: bool = False) -> DataFrame:
    """A row for each tile file with all but its points, which are not read; ``n`` counts them.

    Files are found by the engine, without their contents.  Errors are those of ``read_tiles``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{EXTENSION}").load(folder)
    return parse_headers(files, strict, masks)


def parse_headers(files: DataFrame, strict: bool = False, masks: bool = False) -> DataFrame:
    """Rows of (path, length), also of a stream, as tiles' headers, which tasks read by range.

    Without ``masks`` a mask's ``data`` is empty and not read either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tile, n, error = None, None, None
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    try:
                        tile, n = parse_parts(_FileReader(f, size), points=False, masks=masks)
                    except TileError as e:
                        if strict:
                            raise
                        error = str(e)
                row = to_batch(path, tile, error)
                columns = {c: row.column(c) for c in row.schema.names if c != "points"}
                yield pa.RecordBatch.from_arrays([columns["path"], columns["error"], pa.array([n], pa.int64()), *list(columns.values())[2:]], names=["path", "error", "n", *list(columns)[2:]])

    return files.select("path", "length").mapInArrow(run, HEADER_SCHEMA)


def parse_tiles(files: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of (path, content), also of a stream, as tiles."""
    return files.select("path", "content").mapInArrow(_parse_all(strict), "path string, error string, " + TILE_SCHEMA)


def points_of(tiles: DataFrame, key: str = "path") -> DataFrame:
    """(key, pid, dx, dy, dz, label, units_per_metre, ax, ay, az) of all points."""
    return tiles.select(key, "units_per_metre", "ax", "ay", "az", F.posexplode("points").alias("pid", "p")).select(key, "pid", "p.*", "units_per_metre", "ax", "ay", "az")


def encode_tiles(tiles: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): the files' bytes of rows as ``read_tiles`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([dump(from_batch(batch, at))], pa.binary())], names=[key, "content"])

    columns = [c.name for c in _ARROW if c.name not in ("path", "error")]
    return tiles.select(F.col(key).cast("string").alias(key), *columns).mapInArrow(run, f"`{key}` string, content binary")


#: Points of a file that are written as one piece, that one task reads, and that are read at once.
PIECE, SPLIT, STEP = 1 << 8, 1 << 20, 1 << 16
#: The part that stands after a file's points.
LAST_PART = 1 << 62


def encode_pieces(tiles: DataFrame, points: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key, part, content): pieces of files, which by their parts in order are a file's bytes.

    ``tiles`` has a row for each file: the columns of a tile and, in place of its points, ``n``, their number;
    ``points`` are rows (key, labelled, dx, dy, dz, label), in any order, as they stay.  The first part, 0, is
    what stands before the points, the last what stands after them.  With ``order``, a column of whole numbers of
    which a file's points have each from 0 on once, the parts put them in that order: a piece holds points that
    follow one another, so pieces are long where the rows come in order, and right in any.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ends = frame(from_batch(batch, at), batch.column("n")[at].as_py(), bool(batch.column("labelled")[at].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(key)[at].as_py()] * 2, pa.string()), pa.array([0, LAST_PART], pa.int64()), pa.array(ends, pa.binary())], names=[key, "part", "content"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(key).dictionary_encode()
            code = own.indices.to_numpy()
            turn = batch.column("turn").to_numpy()
            to = np.lexsort((turn, code))
            code, turn, place = code[to], turn[to], np.stack([batch.column(c).to_numpy() for c in ("dx", "dy", "dz")], axis=1)[to]
            labelled = batch.column("labelled").to_numpy(zero_copy_only=False)[to]
            label = batch.column("label").fill_null(0).to_numpy()[to].astype(np.uint8)
            fresh = np.diff(code) != 0
            if order is not None:
                fresh |= np.diff(turn) != 1
            cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(code)]
            bounds = [(i, min(i + PIECE, end)) for begin, end in itertools.pairwise(cuts) for i in range(begin, end, PIECE)]
            names = own.dictionary.take(pa.array([code[i] for i, _ in bounds]))
            content = [_point_bytes(place[i:j], label[i:j] if labelled[i] else None) for i, j in bounds]
            parts = [1 + int(turn[i]) for i, _ in bounds]
            yield pa.RecordBatch.from_arrays([names, pa.array(parts, pa.int64()), pa.array(content, pa.binary())], names=[key, "part", "content"])

    schema = f"`{key}` string, part long, content binary"
    columns = [c.name for c in _ARROW if c.name not in ("path", "error", "points")]
    points_of_none = F.lit(None).cast("array<struct<dx:int,dy:int,dz:int,label:smallint>>").alias("points")
    whole = tiles.select(F.col(key).cast("string").alias(key), *columns, points_of_none, F.col("n").cast("long").alias("n"))
    rows = points.select(F.col(key).cast("string").alias(key), "labelled", "dx", "dy", "dz", F.col("label").cast("int").alias("label"), F.lit(0).cast("long").alias("turn") if order is None else F.col(order).cast("long").alias("turn"))
    return whole.mapInArrow(frames, schema).unionByName(rows.mapInArrow(pieces, schema))


def read_points(spark: SparkSession, folder: str, strict: bool = False, split: int = SPLIT) -> DataFrame:
    """``points_of`` the tiles of ``read_tiles``, by ranges of a file's points: neither is held whole.

    A file that is no tile has no points, or fails (strict).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, size, begin in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                try:
                    tile, count = parse_parts(_FileReader(f, size), points=False, masks=False)
                except TileError:
                    if strict:
                        raise
                    continue
                kind = _point_kind(tile.labels is not None)
                f.seek(HEADER_BYTES + (tile.key is not None) * KEY_BYTES + begin * kind.itemsize)
                end = min(count, begin + split)
                for at in range(begin, end, STEP):
                    n = min(STEP, end - at)
                    rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                    label = pa.nulls(n, _SMALL) if tile.labels is None else pa.array(rows["l"].astype(np.int16))
                    same = (pa.array(np.full(n, v, np.int64)) for v in (tile.units_per_metre, *tile.anchor))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n, dtype=np.int32)), *(pa.array(np.ascontiguousarray(rows["p"][:, i])) for i in range(3)), label, *same], names=["path", "pid", "dx", "dy", "dz", "label", "units_per_metre", "ax", "ay", "az"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{EXTENSION}").load(folder)
    # a range for each so many points that may be there; by number, as for the older layout
    parts = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length div {_point_kind(False).itemsize}, {split}L)")).alias("begin"))
    schema = "path string, pid int, dx int, dy int, dz int, label smallint, units_per_metre long, ax long, ay long, az long"
    return parts.repartition(max(1, min(parts.count(), 1 << 16))).mapInArrow(run, schema)


# ---------------------------------------------------------------- the older layout


def read_old(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, error, points) of files in the older layout: positions in metres."""
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    p, error = parse_old(content.as_py()), None
                    points = pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, i])) for i in range(3)], names=list("xyz")))
                except TileError as e:
                    points, error = pa.nulls(1, kind), str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([error], pa.string()), points], names=["path", "error", "points"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, error string, points array<struct<x:double,y:double,z:double>>")


#: Points of an older file that one task reads, and that are handled at once.
OLD_SPLIT, OLD_STEP = 1 << 20, 1 << 16


def read_old_points(spark: SparkSession, folder: str, pattern: str = "*", split: int = OLD_SPLIT) -> DataFrame:
    """(path, x, y, z) of all points of files in the older layout, those of ``read_old``, a row each.

    Tasks read ranges of a file's points, so that neither it nor its points are held; a file that is none in
    this layout has no points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, size, begin in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                head = f.read(52)
                if len(head) < 52 or head[:4] != OLD_MAGIC:
                    continue
                end = min(_old_count(head, size), begin + split)
                f.seek(52 + 6 * begin)
                for at in range(begin, end, OLD_STEP):
                    n = min(OLD_STEP, end - at)
                    p = _old_places(head, f.read(6 * n))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(3))], names=["path", *"xyz"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    parts = files.select("path", "length", F.explode(F.expr(f"sequence(0L, greatest(length - 52, 0L) div 6, {split}L)")).alias("begin"))
    # by number, as few bytes are many points here, which adaptive execution would give to one task
    return parts.repartition(max(1, min(parts.count(), 1 << 16))).mapInArrow(run, "path string, x double, y double, z double")


def _old_count(head: bytes, size: int) -> int:
    return min(struct.unpack("<I", head[12:16])[0], (size - 52) // 6)


def _old_places(head: bytes, data: bytes) -> np.ndarray:
    low, high = np.frombuffer(head[28:52], "<f4").astype(np.float64).reshape(2, 3)
    return low + np.frombuffer(data, "<u2").reshape(-1, 3) * ((high - low) / 65535.0)


def parse_old(data: bytes) -> np.ndarray:
    """Positions (n, 3) of the older layout: a 52-byte header and 16-bit positions in a box.

    The count is cut to what the bytes hold.
    """
    if len(data) < 52 or data[:4] != OLD_MAGIC:
        raise TileError("bad magic")
    return _old_places(data[:52], data[52 : 52 + 6 * _old_count(data, len(data))])
