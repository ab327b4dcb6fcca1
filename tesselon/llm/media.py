"""Media columns: content-addressed payloads in tar shards.

Method: a row's payload is its text in UTF-8, filled up with zero bytes to a positive multiple of 64,
and stored without loss as an 8-bit grey PNG image 64 samples wide.  A payload is addressed by its
SHA-256 digest and stored once.  Digests and keys are shuffled, which settles the row that stores each
digest that several rows have; up to ``store.PARTS`` * ``store.LOOKUP`` settled digests are then looked up
where the payloads are read, which stay in place.  With more of them a plain join finds the rows, and
payloads are shuffled once.  A task appends the images of its rows to tar shards, which
have temporary names until they are whole.  Rows carry digest, shard, offset and length.  Reading, a
range read of the image's 33 first bytes alone fills the metadata columns (width, height, depth); a
second range read gets the samples, from which the feature columns are computed.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tesselon.llm import store

WIDTH = 64
HEADER = 33
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 64 << 20
# The signature and chunk layout of PNG.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with the filter type 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def image_header(first: bytes) -> tuple[int, int, int]:
    """(width, height, depth) from the first bytes of an image."""
    if len(first) < HEADER or first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("no image header")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return width, height, depth


def decode_image(data: bytes) -> bytes:
    width, height, _ = image_header(data)
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("unknown row filter")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and histogram of 16 classes of the samples."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    total = int(count @ np.arange(256))
    square = int(count @ (np.arange(256) ** 2))
    mean = total / len(x)
    return f"{mean:.4f};{max(0.0, square / len(x) - mean * mean) ** 0.5:.4f};" + ",".join(map(str, count.reshape(16, 16).sum(1).tolist()))


def _write(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store.filesystem(uri)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, name, temporary, at, number = None, "", "", 0, 0
        found: list[tuple] = []

        def close():
            nonlocal out
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()
                store.commit(fs, f"{root}/{temporary}", f"{root}/{name}")
                out = None
                rows, found[:] = list(zip(*found, strict=True)), []
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=list("abcd"))
            return None

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode_image(raw.as_py())
                if out is None:
                    name = f"shard-{task.partitionId():06d}-{number:04d}.tar"
                    temporary = f".{name}.{task.taskAttemptId()}"
                    out, at, number = fs.open_output_stream(f"{root}/{temporary}", compression=None), 0, number + 1
                member = tarfile.TarInfo(f"{d.hex()}.png")
                member.size = len(data)
                head = member.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + data + b"\0" * (-len(data) % 512))
                found.append((d, name, at + len(head), len(data)))
                at += len(head) + len(data) + (-len(data) % 512)
                if at >= SHARD_BYTES:
                    yield close()
        rest = close()
        if rest is not None:
            yield rest

    return run


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store.filesystem(uri)
        name, file = None, None
        for batch in batches:
            rows = []
            for d, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                file.seek(offset)
                width, height, depth = image_header(file.read(HEADER))
                file.seek(offset)
                image = file.read(length)
                samples = decode_image(image)
                rows.append((d, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), length, hashlib.sha256(image).hexdigest(), feature(samples), width, height, depth, shard, offset))
            if rows:
                types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f"c{i}" for i in range(12)])
        if file is not None:
            file.close()

    return run


def payload(text: Column) -> Column:
    """The text's bytes and zero bytes up to a positive multiple of 64 (null counts as empty)."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill)))


def owners(docs: DataFrame, scratch: store.Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, owner, alone): of each digest that several rows have, the least key among them, and
    whether it is one row's only.  Copies are counted by digest and key before they meet."""
    digests = docs.select(F.sha2(payload(F.col(text)), 256).alias("hex"), F.col(key).alias("key")).select(F.unhex("hex").alias("digest"), "key")
    each = digests.groupBy("digest", "key").agg(F.count("*").alias("n"))
    least = each.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("least")).filter("n > 1")
    return scratch.written(least.select("digest", F.col("least.key").alias("owner"), (F.col("least.n") == 1).alias("alone")), "owners")


def stored_once(docs: DataFrame, scratch: store.Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, payload), a row for each digest of ``docs``.

    The table of owners is broadcast in parts of bounded size, for each of which ``docs`` is read once;
    beyond that it is joined.  Rows that share the owner's key, too, meet by digest, one of each task.
    """
    settled = owners(docs, scratch, key, text)
    rows = docs.select(F.col(key).alias("key"), payload(F.col(text)).alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    parts = [rows.transform(f).join(F.broadcast(settled.transform(f)), "digest", "left") for f in store.lookups(settled, F.col("digest"))]
    found = functools.reduce(DataFrame.unionByName, parts) if parts else rows.join(settled, "digest", "left")
    owned = F.col("key").eqNullSafe(F.col("owner"))
    out = found.filter(F.col("alone").isNull() | (F.col("alone") & owned)).select("digest", "payload")
    if settled.filter(~F.col("alone")).isEmpty():
        return out
    return out.unionByName(found.filter(~F.col("alone") & owned).groupBy("digest").agg(F.first("payload").alias("payload")))


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: sizes, digests and features of its payload as stored.

    Equal texts share one stored image, of which there is one for each digest.  Null and empty texts
    are 64 zero bytes; texts of any length are stored whole.  Null and repeated keys and repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    uri = store.fresh_dir(spark, "media")
    with store.Scratch(spark) as scratch:
        once = stored_once(docs, scratch, key, text)
        stored = store.written(once.mapInArrow(store.by_slices(_write(uri), 256), "digest binary, shard string, offset long, length long"), "index", f"{uri}/_index")
    places = stored.repartition("shard").sortWithinPartitions("shard", "offset")
    features = places.mapInArrow(store.by_slices(_read(uri), 256), "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, depth int, shard string, offset long")
    rows = docs.select(F.col(key), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(payload(F.col(text)), 256)).alias("digest"))
    return rows.join(features, "digest").drop("digest")
