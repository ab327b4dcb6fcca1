"""WARC archives from a table: a deterministic sharded writer, and a reader.

Method: records are sorted by ranges of key and digest; each task writes its range, one gzip member a
record, and starts a new file when the compressed size is reached.  The ranges follow from exact
running sums of the records' sizes, not from a sample, and headers and digests are made anew from the
payloads, with nothing that depends on clock, host, attempt or the input's partitions, so that a run
again gives equal files.
A file has a temporary name until it is whole; a manifest names the files, their sizes and digests,
and readers read what the manifest lists.

Payloads that repeat are written once: of the records with equal payloads of at least ``least``
bytes, the one with the largest key is a response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.llm import store

FILE_BYTES = 32 << 20
LEAST = 1000
#: Bytes of a range: total / FEWEST, but at least LEAST_RANGE and at most MOST_RANGE; and no more than MOST ranges.
LEAST_RANGE, MOST_RANGE, FEWEST, MOST = 8 << 20, 256 << 20, 64, 1 << 14
# Names of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int | None) -> str:
    return f"<urn:record:{'none' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit holds the HTTP head only, whose length field still gives the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "urn:none")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[4:4] = [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", _PROFILE)]
    return _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(uri: str, file_bytes: int, date: str):
    """Rows in order (key, refers_to, copies, url, payload) -> manifest; a row without payload is a mark.

    A mark stands before the records of its key and digest and tells what they refer to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store.filesystem(uri)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out = None
        name, temporary, size, records, number, sha = "", "", 0, 0, 0, None
        mark: tuple | None = None  # (key, digest, key of the response)

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            store.commit(fs, f"{root}/{temporary}", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64()), "sha256": [sha.hexdigest()]})

        for batch in batches:
            for key, digest, refers_to, copies, url, payload in zip(*(batch.column(i) for i in range(6)), strict=True):
                key, digest, url, payload = key.as_py(), digest.as_py(), url.as_py(), payload.as_py()
                if payload is None:
                    mark = (key, digest, refers_to.as_py())
                    continue
                target = mark[2] if mark and mark[:2] == (key, digest) else refers_to.as_py()
                data = member(record(key, url, payload, digest, target, date))
                for _ in range(copies.as_py()):
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{number:04d}.warc.gz"
                        temporary = f".{name}.{task.taskAttemptId()}"
                        out, size, records, sha, number = fs.open_output_stream(f"{root}/{temporary}", compression=None), 0, 0, hashlib.sha256(), number + 1
                    out.write(data)
                    sha.update(data)
                    size += len(data)
                    records += 1
                    if size >= file_bytes:
                        yield close()
        if out is not None:
            yield close()

    return run


#: Characters of a place: one for null, 16 for the key, 40 for the digest, 12 for a share of many copies.
_PLACE = 69


def _place(key: Column, digest: Column) -> Column:
    """A string that sorts as (key, digest) do, nulls first."""
    number = F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(key.isNull(), F.concat(F.lit("0"), digest)).otherwise(F.concat(F.lit("1"), number, digest))


def range_bytes(index: DataFrame) -> int:
    total = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(LEAST_RANGE, min(MOST_RANGE, total // FEWEST), -(-total // MOST))


def range_starts(index: DataFrame, each: int, scratch: store.Scratch) -> list[str]:
    """The least place of each range of ``each`` bytes after the first, from exact running sums.

    Sums are taken by place in two steps: within sorted parts, whose bounds do not matter, and over the
    parts' totals.  The driver holds a row for each part and for each range.
    """
    parts = max(1, index.rdd.getNumPartitions())
    by_place = index.groupBy("place").agg(F.sum("size").alias("size"))
    ordered = scratch.written(by_place.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id()), "places")
    totals = {r.part: r.size for r in ordered.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    base, at = [], 0
    for part in range(max(totals, default=-1) + 1):
        base.append((part, at))
        at += totals.get(part, 0)
    bases = index.sparkSession.createDataFrame(base or [(0, 0)], "part int, base long")
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ordered.withColumn("end", F.sum("size").over(own)).join(F.broadcast(bases), "part")
    end = F.col("base") + F.col("end")
    number = F.floor((end - F.col("size")) / each)
    return [r.place for r in ends.groupBy(number.alias("range")).agg(F.min("place").alias("place")).orderBy("range").collect()][1:]


def write(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row below ``uri``; returns the manifest (file, records, bytes, sha256).

    Null html is an empty payload.  Rows with a null key come first, as responses under
    a record id without a key, and are read back with a null key.  Rows that share a key and a
    payload are records of one kind.  Payloads of any length are written whole; other columns are
    ignored; an empty table gives an empty manifest.

    Equal payloads are found by digest in a table of keys and digests; the payloads themselves move
    once, to be sorted.  Where the rows of one key and digest exceed a range, they are counted by url
    first, and rows that stand for many, over several ranges if need be, are written so often.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.sha1(raw).alias("digest"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("place", _place(F.col("key"), F.col("digest")))
    with store.Scratch(spark) as scratch:
        index = scratch.written(rows.select("key", "digest", "place", F.octet_length("payload").alias("bytes"), (F.octet_length("payload") + 512).cast("long").alias("size")), "index")
        large = index.filter(F.col("bytes") >= least).select("key", "digest", "place")
        keep = large.groupBy("digest").agg(F.max("key").alias("refers_to"), F.min("key").alias("low")).filter("low < refers_to").select("digest", "refers_to")
        marks = large.join(keep, "digest").filter("key < refers_to").distinct()
        each = range_bytes(index)
        one, none = F.lit(1).cast("long"), F.lit(None)
        records = rows.select("key", "digest", none.cast("long").alias("refers_to"), one.alias("copies"), "url", "payload", "place")
        hot = scratch.written(index.groupBy("place").agg(F.count("*").alias("n"), F.sum("size").alias("size")).filter((F.col("n") > 1) & (F.col("size") > each)).select("place"), "hot")
        if not hot.isEmpty():  # no more of them than ranges
            many = records.join(F.broadcast(hot), "place").groupBy("key", "digest", "url", "place").agg(F.first("payload").alias("payload"), F.sum("copies").alias("n"))
            some = F.greatest(one, F.floor(each / (F.octet_length("payload") + 512)))
            many = many.withColumn("some", some).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("some")) - 1)))
            many = many.withColumn("copies", F.least("some", F.col("n") - F.col("chunk") * F.col("some"))).join(marks.drop("place"), ["key", "digest"], "left")
            many = scratch.written(many.withColumn("place", F.concat("place", F.lpad(F.col("chunk").cast("string"), 12, "0"))).select(records.columns), "many")
            records = records.join(F.broadcast(hot), "place", "left_anti").unionByName(many)
            index = index.join(F.broadcast(hot), "place", "left_anti").select("place", "size").unionByName(many.select("place", ((F.octet_length("payload") + 512) * F.col("copies")).alias("size")))
        starts = np.array(range_starts(index, each, scratch), f"S{_PLACE}")

        @F.pandas_udf("int")
        def range_of(place: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(starts, place.to_numpy().astype(f"S{_PLACE}"), "right").astype(np.int32))

        both = records.unionByName(marks.select("key", "digest", "refers_to", none.cast("long").alias("copies"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "place"))
        ordered = both.repartitionById(len(starts) + 1, range_of("place")).sortWithinPartitions("place", F.col("payload").isNotNull(), "url")
        manifest = ordered.select("key", "digest", "refers_to", "copies", "url", "payload").mapInArrow(_write(uri, file_bytes, date), "file string, records long, bytes long, sha256 string")
        return store.written(manifest, "manifest", f"{uri}/_manifest")


def records(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The members of a gzip stream, one at a time."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(z.decompress(rest))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        else:
            rest = b""


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a record, whose digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first.encode() != _VERSION:
        raise ValueError(f"not a record: {first[:40]}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"]:
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    return fields, block


def _number(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store.filesystem(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in records(stream):
                        f, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                        digest = base64.b32decode(f["warc-payload-digest"][5:]).hex()
                        response = f["warc-type"] == "response"
                        if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {f['warc-record-id']}")
                        rows.append((_number(f["warc-record-id"]), length, digest, f["warc-type"], None if response else _number(f["warc-refers-to"]), f["warc-target-uri"], payload if response else None))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list("abcdefg"))


def read(manifest: DataFrame, uri: str, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record."""
    schema = f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary"
    spark = manifest.sparkSession
    return manifest.select("file").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(_read(uri), schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    uri = store.fresh_dir(pages.sparkSession, "warc")
    return read(write(pages, uri, key, url, html), uri, key)
