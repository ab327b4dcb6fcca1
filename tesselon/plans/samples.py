"""Files of the kinds that a conversion reads, made from the derived views: meshes, an index, a map.

The queries of sources and conversions read what is written here.  Tasks write the files, one mesh or one
part of a map each.
"""

from __future__ import annotations

import contextlib
import itertools
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tesselon.sources import files

#: Nodes or ways in a block of a map file.
BLOCK = 8000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))


def _written(rows: DataFrame, folder: str, content: Callable[[Iterable[tuple]], Iterator[tuple[str, bytes]]]) -> None:
    """Write the files that ``content`` makes of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files.filesystem(folder)
        fs.create_dir(root, recursive=True)
        attempt = str(TaskContext.get().taskAttemptId())
        for name, data in content(_rows(batches)):
            files.put(fs, f"{root}/{name}", data, attempt)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    rows.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def write_meshes(lines: DataFrame, folder: str) -> None:
    """A mesh for each ``file`` of rows (file, line_no, line): text, or an archive where the name says so.

    Rows stream into the files in order; no file is held.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Buffer]]:
        for batch in batches:
            own = batch.column(0).dictionary_encode()
            code = own.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for begin, end in itertools.pairwise(cuts):
                if begin < end:
                    some = pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), batch.column(1).slice(begin, end - begin).fill_null(""))
                    yield own.dictionary[code[begin]].as_py(), pc.binary_join(some, "\n")[0].as_buffer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files.filesystem(folder)
        fs.create_dir(root, recursive=True)
        attempt = str(TaskContext.get().taskAttemptId())
        for name, own in itertools.groupby(texts(batches), key=lambda t: t[0]):
            with contextlib.ExitStack() as open_:
                f = open_.enter_context(files.appearing(fs, f"{root}/{name}", attempt))
                if name.endswith(".zip"):
                    z = open_.enter_context(zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED))
                    z.writestr("readme.txt", "v 0 0 0")
                    f = open_.enter_context(z.open("mesh.OBJ", "w", force_zip64=True))
                for _, text in own:
                    f.write(text)
                    f.write(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    rows = lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no").select("file", "line")
    rows.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def write_index(tiles: DataFrame, folder: str) -> None:
    """The feature collection of the tiles' boxes (prefix, box columns), one object as the format asks."""

    def corner(lon: str, lat: str):
        return F.array(lon, lat)

    ring = F.array(corner("lon_min", "lat_min"), corner("lon_max", "lat_min"), corner("lon_max", "lat_max"), corner("lon_min", "lat_max"), corner("lon_min", "lat_min"))
    url = F.concat(F.lit("https://tiles.example/"), "prefix", F.lit(".zip"))
    feature = F.struct(F.struct(F.array(ring).alias("coordinates")).alias("geometry"), F.struct(url.alias("url")).alias("properties"))
    tiles.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).write.text(folder)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(n: int, v: int | bytes) -> bytes:
    return _varint(n << 3 | 2) + _varint(len(v)) + v if isinstance(v, bytes) else _varint(n << 3) + _varint(v)


def _differences(values: Iterable[int]) -> bytes:
    steps = (b - a for a, b in itertools.pairwise([0, *values]))
    return b"".join(_varint(d << 1 if d >= 0 else (-d << 1) - 1) for d in steps)


def _blob(kind: bytes, raw: bytes) -> bytes:
    body = _field(2, len(raw)) + _field(3, zlib.compress(raw))
    head = _field(1, kind) + _field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def _map_file(blocks: Iterator[bytes], kind: str) -> Iterator[tuple[str, bytes]]:
    first = next(blocks, None)
    if first is not None:
        data = b"".join(_blob(b"OSMData", b) for b in itertools.chain([first], blocks))
        yield f"{kind}-{TaskContext.get().partitionId():05d}.pbf", _blob(b"OSMHeader", b"") + data


def write_map(nodes: DataFrame, ways: DataFrame, folder: str) -> None:
    """Nodes (node_id, lon, lat) and ways (way_id, tags map, refs array) in files ordered by id."""

    def node_blocks(rows: Iterable[tuple]) -> Iterator[bytes]:
        for part in itertools.batched(rows, BLOCK):
            ids, lon, lat = zip(*part, strict=True)
            own = [_differences(ids), *(_differences(round(x * 1e7) for x in c) for c in (lat, lon))]
            yield _field(2, _field(2, b"".join(_field(n, c) for n, c in zip((1, 8, 9), own, strict=True))))

    def way_blocks(rows: Iterable[tuple]) -> Iterator[bytes]:
        for part in itertools.batched(rows, BLOCK):
            number: dict[str, int] = {"": 0}
            made = []
            for way, tags, refs in part:
                pairs = [(number.setdefault(k, len(number)), number.setdefault(v, len(number))) for k, v in dict(tags).items()]
                keys, values = (b"".join(_varint(p[i]) for p in pairs) for i in (0, 1))
                made.append(_field(3, _field(1, way) + _field(2, keys) + _field(3, values) + _field(8, _differences(refs))))
            yield _field(1, b"".join(_field(1, s.encode()) for s in number)) + _field(2, b"".join(made))

    _written(nodes.select("node_id", "lon", "lat").repartitionByRange("node_id").sortWithinPartitions("node_id"), folder, lambda rows: _map_file(node_blocks(rows), "a-nodes"))
    _written(ways.select("way_id", "tags", "refs").repartitionByRange("way_id").sortWithinPartitions("way_id"), folder, lambda rows: _map_file(way_blocks(rows), "b-ways"))


def write_old_tiles(points: DataFrame, folder: str) -> None:
    """Files in the older layout: rows (file, low array, high array, qx, qy, qz), a 16-bit place each.

    Rows stream by in order of files; a file is held as its bytes, six for each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files.filesystem(folder)
        fs.create_dir(root, recursive=True)
        attempt = str(TaskContext.get().taskAttemptId())
        name, box, places = None, b"", bytearray()

        def put() -> pa.RecordBatch:
            head = b"HPC1" + struct.pack("<6I", 1, 0, len(places) // 6, 0, 0, 0)
            files.put(fs, f"{root}/{name}", head + box + places, attempt)
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

        for batch in batches:
            own = batch.column("file").dictionary_encode()
            code = own.indices.to_numpy()
            q = np.stack([batch.column(c).to_numpy() for c in ("qx", "qy", "qz")], axis=1).astype("<u2")
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for begin, end in itertools.pairwise(cuts):
                if begin < end and batch.column("file")[begin].as_py() != name:
                    if name is not None:
                        yield put()
                    name, places = batch.column("file")[begin].as_py(), bytearray()
                    box = np.array([*batch.column("low")[begin].as_py(), *batch.column("high")[begin].as_py()], "<f4").tobytes()
                places += q[begin:end].tobytes()
        if name is not None:
            yield put()

    rows = points.select("file", "low", "high", "qx", "qy", "qz").repartition("file").sortWithinPartitions("file")
    rows.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
