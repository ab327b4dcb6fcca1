"""The index of tile footprints: a feature collection with a polygon and a link each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tesselon.functions import geo, names
from tesselon.sources import files

FEATURE = "geometry struct<coordinates:array<array<array<double>>>>, properties struct<url:string>"
#: Bytes of a collection that one task reads.
SPLIT = 32 << 20


def ring_bounds(ring: Column) -> Column:
    """struct(lon_min, lat_min, lon_max, lat_max) over a ring's finite vertices; none: an empty box."""
    good = F.filter(ring, lambda v: geo.finite(v[0], v[1]))

    def end(f, i: int, none: float) -> Column:
        return F.coalesce(f(F.transform(good, lambda v: v[i])), F.lit(none))

    inf = float("inf")
    return F.struct(end(F.array_min, 0, inf).alias("lon_min"), end(F.array_min, 1, inf).alias("lat_min"), end(F.array_max, 0, -inf).alias("lon_max"), end(F.array_max, 1, -inf).alias("lat_max"))


def _ranges(spark: SparkSession, path: str, split: int) -> DataFrame:
    """(path, part, first, end): ranges of the bytes of a file, or of a folder's files."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long")))
    cut = found.select("path", "length", cut.alias("first"))
    return cut.select("path", F.expr(f"first div {split}").alias("part"), "first", F.least(F.col("first") + split, F.col("length")).alias("end"))


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Where quotes stand that no backslash takes their meaning; ``before`` backslashes precede the data."""
    at = np.flatnonzero(data == 34)
    other = np.flatnonzero(data != 92)
    # backslashes right before each quote: up to the last other byte before it
    last = np.searchsorted(other, at) - 1
    run = np.where(last >= 0, at - 1 - other[last], at + before)
    return at[run % 2 == 0]


def _backslashes(f: pa.NativeFile, first: int) -> int:
    n = 0
    while n < first:
        f.seek(first - n - 1)
        if f.read(1) != b"\\":
            break
        n += 1
    return n


def _read(f: pa.NativeFile, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    before = _backslashes(f, first)
    f.seek(first)
    data = np.frombuffer(f.read(end - first), np.uint8)
    return data, _quotes(data, before)


def _outside(n: int, quotes: np.ndarray, inside: int) -> np.ndarray:
    """Which of ``n`` bytes lie outside strings, quotes excluded; ``inside``: whether the first is in one."""
    turns = np.zeros(n + 1, np.int64)
    turns[quotes + 1] = 1
    out = (np.cumsum(turns)[:n] + inside) % 2 == 0
    out[quotes] = False
    return out


def _steps(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """+1 where a bracket opens, -1 where one closes."""
    opens, closes = (data == 123) | (data == 91), (data == 125) | (data == 93)
    return np.where(outside, opens.astype(np.int8) - closes.astype(np.int8), 0)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.NativeFile]]:
    for row in (r for b in batches for r in b.to_pylist()):
        fs, name = files.filesystem(row["path"])
        with fs.open_input_file(name) as f:
            yield row, f


def _balance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, part, first, end, quotes, depth0, depth1): brackets that a range leaves open if it begins outside a
    string, or inside one."""
    for row, f in _open(batches):
        data, quotes = _read(f, row["first"], row["end"])
        depth = [int(_steps(data, _outside(len(data), quotes, s)).sum()) for s in (0, 1)]
        yield pa.RecordBatch.from_pylist([row | {"quotes": len(quotes), "depth0": depth[0], "depth1": depth[1]}])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, part, member, found): the last member of the root object that begins in a range, if any, and whether
    ``features`` does."""
    for row, f in _open(batches):
        data, quotes = _read(f, row["first"], row["end"])
        inside = row["quotes_before"] % 2
        depth = row["depth"] + np.cumsum(_steps(data, _outside(len(data), quotes, inside)), dtype=np.int64)
        names = quotes[inside::2]
        begun = [name for at in names[depth[names] == 1].tolist() if (name := _member_at(f, row["first"] + at)) is not None]
        if begun:
            yield pa.RecordBatch.from_pylist([{"path": row["path"], "part": row["part"], "member": begun[-1], "found": "features" in begun}])


def _member_at(f: pa.NativeFile, at: int) -> str | None:
    """The string that begins at byte ``at``, if a colon follows."""
    size = 256
    while True:
        f.seek(at)
        data = f.read(size)
        ends = _quotes(np.frombuffer(data[1:], np.uint8), 0)
        rest = data[int(ends[0]) + 2 :].lstrip() if len(ends) else b""
        if rest or len(data) < size:
            return json.loads(data[: int(ends[0]) + 2]) if rest[:1] == b":" else None
        size *= 4


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each object that begins in a range within the root's member ``features``."""
    for row, f in _open(batches):
        first, end, inside = row["first"], row["end"], row["quotes_before"] % 2
        data, quotes = _read(f, first, end)
        outside = _outside(len(data), quotes, inside)
        steps = _steps(data, outside)
        depth = row["depth"] + np.cumsum(steps, dtype=np.int64)
        names = quotes[inside::2]
        named = [(at, name) for at in names[depth[names] == 1].tolist() if (name := _member_at(f, first + at)) is not None]
        begin = np.array([at for at, _ in named], np.int64)
        ours = np.array([row["member"] == "features", *(name == "features" for _, name in named)])
        within = ours[np.searchsorted(begin, np.arange(len(data)), "right")]
        level = depth - (steps > 0)  # of the place before a bracket that opens
        stray = within & (depth == 2) & (steps == 0) & (outside | np.isin(np.arange(len(data)), quotes)) & ~np.isin(data, (9, 10, 13, 32, 44))
        if stray.any():
            raise ValueError(f"malformed feature at byte {first + int(np.flatnonzero(stray)[0])} of {row['path']}")
        starts = np.flatnonzero(within & (steps > 0) & (level == 2))
        if (data[starts] != 123).any():
            raise ValueError(f"malformed feature in {row['path']}")
        ends = np.flatnonzero((steps < 0) & (depth == 2))
        texts, raw = [], data.tobytes()
        for at in starts.tolist():
            k = int(np.searchsorted(ends, at))
            texts.append(raw[at : int(ends[k]) + 1] if k < len(ends) else _rest(f, first + at))
        yield pa.RecordBatch.from_pydict({"text": pa.array([t.decode("utf-8") for t in texts], pa.string())})


def _rest(f: pa.NativeFile, at: int, step: int = 1 << 16) -> bytes:
    """The object that begins at byte ``at``, to its end."""
    while True:
        f.seek(at)
        raw = f.read(step)
        data = np.frombuffer(raw, np.uint8)
        closed = np.flatnonzero(np.cumsum(_steps(data, _outside(len(data), _quotes(data, 0), 0)), dtype=np.int64) == 0)
        if len(closed):
            return raw[: int(closed[0]) + 1]
        if len(raw) < step:
            raise ValueError(f"malformed feature at byte {at}")
        step *= 4


def read_index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(prefix, lon_min, lat_min, lon_max, lat_max) of every feature; malformed files fail.

    The prefix is the stem of the link's last component; the box is that of the first ring.  The file is one
    object, which tasks read by ranges of ``split`` bytes: from each range's quotes and brackets follows
    whether the next begins in a string, and how deep; then each range cuts out the features that begin in
    it, and reads on to the end of the last.
    """
    ranges = _ranges(spark, path, split)
    n = max(1, min(ranges.count(), 1 << 16))
    counted = files.checkpointed(ranges.repartition(n).mapInArrow(_balance, "path string, part long, first long, end long, quotes long, depth0 long, depth1 long"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    placed = placed.withColumn("own", F.when(F.col("quotes_before") % 2 == 0, F.col("depth0")).otherwise(F.col("depth1")))
    placed = placed.withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
    known = files.checkpointed(placed.repartition(n).mapInArrow(_members, "path string, part long, member string, found boolean"))
    whole = placed.groupBy("path").agg(F.sum("own").alias("open"), F.sum("quotes").alias("quotes")).join(known.groupBy("path").agg(F.max("found").alias("found")), "path", "left")
    broken = whole.filter("open <> 0 or quotes % 2 <> 0 or not coalesce(found, false)").first()
    if broken:
        raise ValueError(f"malformed feature collection: {broken.path}")
    member = F.last("member", ignorenulls=True).over(before)
    rows = placed.join(known.drop("found"), ["path", "part"], "left").withColumn("open_member", member).select("path", "part", "first", "end", "quotes_before", "depth", F.col("open_member").alias("member"))
    texts = rows.repartition(n).mapInArrow(_features, "text string")
    rows = texts.select(F.from_json("text", FEATURE, {"mode": "FAILFAST"}).alias("f"))
    ok = F.col("f.properties.url").isNotNull() & (F.size("f.geometry.coordinates") > 0) & F.forall("f.geometry.coordinates", lambda r: F.forall(r, lambda v: F.size(v) == 2))
    url = F.when(F.coalesce(ok, F.lit(False)), F.col("f.properties.url")).otherwise(F.raise_error(F.lit("malformed feature")).cast("string"))
    return rows.select(names.stem(url).alias("prefix"), ring_bounds(F.col("f.geometry.coordinates")[0]).alias("b")).select("prefix", "b.*")
