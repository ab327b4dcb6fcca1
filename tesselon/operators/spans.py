"""Rows of pixels that ways cover, for a batch of ways at a time, and the painting of them into grids.

Small helpers of ``raster``, in arrays: they run inside tasks, on rows that Spark has dealt out and sorted.
Pixel arithmetic is in single precision, operation by operation, so that borders fall on the same pixels as
in single-precision code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Crossings or pixels that are held at once; a single way may have more.
ROOM = 1 << 20


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): every whole number from ``first`` to ``last`` of each pair, and the pair's place."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _portions(cost: np.ndarray) -> Iterator[slice]:
    """Ways in order, together of at most ``ROOM`` cost, or one."""
    ends = np.cumsum(cost)
    at = 0
    while at < len(cost):
        to = max(at + 1, int(np.searchsorted(ends, ROOM + (ends[at - 1] if at else 0), "right")))
        yield slice(at, to)
        at = to


#: (rank of each way, lowest rank of each row of the grid): rows that a way cannot change are passed over.
Above = tuple[np.ndarray, np.ndarray]


def area_spans(first: np.ndarray, x: np.ndarray, y: np.ndarray, grid: int, above: Above | None = None) -> tuple[np.ndarray, ...]:
    """(way, y, a, b) of pixels inside, by the even-odd rule: crossings of a row, in pairs, bound spans.

    Way i has the vertices ``first[i]`` to ``first[i + 1]``; those with less than three have no inside.
    """
    size = np.diff(first)
    way = np.repeat(np.arange(len(size)), size)
    here = np.arange(first[0], first[-1])
    before = np.where(here == first[:-1][way], first[1:][way] - 1, here - 1)
    xi, yi, xj, yj = (v.astype(np.int64) for v in (x[here], y[here], x[before], y[before]))
    kept = (yi != yj) & (size[way] >= 3)
    way, xi, yi, xj, yj = (v[kept] for v in (way, xi, yi, xj, yj))
    edge, row = ranges(np.minimum(yi, yj), np.maximum(yi, yj) - 1)
    if above is not None:
        kept = above[0][way[edge]] > above[1][row]
        edge, row = edge[kept], row[kept]
    slope = (row - yi[edge]).astype(np.float32) / (yj - yi).astype(np.float32)[edge]
    cross = (xj - xi).astype(np.float32)[edge] * slope + xi.astype(np.float32)[edge]
    # crossings are not negative, so their bits are in their order
    line = way[edge] * grid + row
    order = np.sort(line << 32 | (cross + np.float32(0)).view(np.int32).astype(np.int64))
    line, cross = order >> 32, np.ceil((order & 0xFFFFFFFF).astype(np.uint32).view(np.float32)).astype(np.int64)
    a, b, line = np.maximum(cross[::2], 0), np.minimum(cross[1::2] - 1, grid - 1), line[::2]
    kept = a <= b
    return line[kept] // grid, line[kept] % grid, a[kept], b[kept]


def line_pixels(first: np.ndarray, x: np.ndarray, y: np.ndarray, radius: np.ndarray, grid: int, above: Above | None = None) -> tuple[np.ndarray, ...]:
    """(way, y, x) of pixels whose centre lies within the radius of a segment; near several, several times.

    A row of a segment lists the pixels between the ends of its outline there, not its whole box: the
    outline is two arcs and two parallels of the segment, and convex, so that its outermost crossings
    with the row bound one interval.  It is widened by more than single precision can lose, and the exact
    test decides.
    """
    size = np.diff(first)
    way = np.repeat(np.arange(len(size)), size)
    here = np.arange(first[0], first[-1])
    here, way = here[here + 1 < first[1:][way]], way[here + 1 < first[1:][way]]
    x0, y0, x1, y1 = (v.astype(np.float32) for v in (x[here], y[here], x[here + 1], y[here + 1]))
    r = radius[way].astype(np.float32)
    low, high = (np.clip(v, 0, grid - 1).astype(np.int64) for v in (np.floor(np.minimum(y0, y1) - r), np.ceil(np.maximum(y0, y1) + r)))
    seg, row = ranges(low, high)
    if above is not None:
        kept = above[0][way[seg]] > above[1][row]
        seg, row = seg[kept], row[kept]
    left, right = _outline(*(v[seg].astype(np.float64) for v in (x0, y0, x1, y1, r)), row + 0.5)
    kept = np.isfinite(left)
    seg, row = seg[kept], row[kept]
    a, b = np.maximum(np.ceil(left[kept] - 0.5), 0).astype(np.int64), np.minimum(np.floor(right[kept] - 0.5), grid - 1).astype(np.int64)
    at, px = ranges(a, b)
    seg, row = seg[at], row[at]
    dx, dy = x1 - x0, y1 - y0
    norm = (dx * dx + dy * dy + np.float32(1e-12))[seg]
    x0, y0, dx, dy, r = x0[seg], y0[seg], dx[seg], dy[seg], r[seg]
    cx, cy = px.astype(np.float32) + np.float32(0.5), row.astype(np.float32) + np.float32(0.5)
    t = np.clip(((cx - x0) * dx + (cy - y0) * dy) / norm, np.float32(0), np.float32(1))
    ex, ey = cx - (x0 + t * dx), cy - (y0 + t * dy)
    near = ex * ex + ey * ey <= r * r
    return way[seg[near]], row[near], px[near]


def _outline(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, r: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the widened outline at height ``row``; infinite the wrong way round where it has none."""
    wide = r * 1.001 + 0.01
    dx, dy = x1 - x0, y1 - y0
    left, right = np.full(len(r), np.inf), np.full(len(r), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for x, y in ((x0, y0), (x1, y1)):
            half = np.sqrt(wide * wide - (row - y) * (row - y))  # no number beyond the arc
            left, right = np.fmin(left, x - half), np.fmax(right, x + half)
        length = np.sqrt(dx * dx + dy * dy)
        for side in (-1.0, 1.0):
            nx, ny = -dy * wide * side / length, dx * wide * side / length
            along = (row - (y0 + ny)) / dy
            crossing = np.where((along >= 0) & (along <= 1), x0 + nx + along * dx, np.nan)
            left, right = np.fmin(left, crossing), np.fmax(right, crossing)
    return left, right


def _line_spans(way: np.ndarray, y: np.ndarray, x: np.ndarray, grid: int) -> tuple[np.ndarray, ...]:
    """(way, y, a, b): the distinct pixels as spans."""
    at = np.sort((way * grid + y) * (grid + 1) + x)  # a row ends with a place that is no pixel
    at = at[np.diff(at, prepend=-2) > 0]
    begins = np.diff(at, prepend=-2) > 1
    a, b = at[begins], at[np.append(begins[1:], len(at) > 0)]
    line, a = a // (grid + 1), a % (grid + 1)
    return line // grid, line % grid, a, b % (grid + 1)


def _vertices(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    px = batch.column(batch.schema.get_field_index("px"))
    return px.offsets.to_numpy().astype(np.int64), *(px.values.field(c).to_numpy() for c in ("x", "y"))


def spans(grid: int, areas: bool):
    """Rows (tile_id, way_id, class, px, radius) -> (tile_id, way_id, class, y, a, b), disjoint spans of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, x, y = _vertices(batch)
            for part in _portions(np.diff(first) * grid):
                own = first[part.start : part.stop + 1]
                if areas:
                    way, *span = area_spans(own, x, y, grid)
                else:
                    radius = batch.column("radius").to_numpy()[part]
                    way, *span = _line_spans(*line_pixels(own, x, y, radius, grid), grid)
                place = pa.array(way + part.start)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in ("tile_id", "way_id", "class")), *(pa.array(v.astype(np.int32)) for v in span)], names=["tile_id", "way_id", "class", "y", "a", "b"])

    return run


def _rows_of(tile: object, kind: pa.DataType, rank: np.ndarray) -> pa.RecordBatch:
    """The painted rows of a tile's grid, their ranks as bytes; the first, if none is painted."""
    y = np.flatnonzero(rank.any(axis=1))
    y = y if len(y) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array([tile] * len(y), kind), pa.array(y.astype(np.int32)), pa.array([rank[i].tobytes() for i in y], pa.binary())], names=["tile_id", "y", "ranks"])


def painted(grid: int):
    """Rows (tile_id, is_area, rank, px, radius) in order of tiles, the highest ranks first -> (tile_id, y, ranks):
    the highest rank of each pixel as 64-bit numbers, 0 where none is.  One grid is held at a time.

    A way below every pixel's rank can change none, nor can those after it in its tile; nor can a way change a row
    of which that holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, kind, best = None, None, None
        for batch in batches:
            first, x, y = _vertices(batch)
            ids, area, rank, radius = batch.column("tile_id"), batch.column("is_area").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(), batch.column("radius").to_numpy()
            kind = ids.type
            code = ids.dictionary_encode().indices.to_numpy()
            # stretches of ways of one tile and kind
            cuts = np.flatnonzero((np.diff(code) != 0) | (area[1:] != area[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
                if begin == end:
                    continue
                own = ids[begin].as_py()
                if best is None or own != tile:
                    if best is not None:
                        yield _rows_of(tile, kind, best)
                    tile, best = own, np.zeros((grid, grid), np.int64)
                flat = best.reshape(-1)
                for part in _portions(np.diff(first[begin : end + 1]) * grid):
                    lo, hi = begin + part.start, begin + part.stop
                    if rank[lo] < flat.min():
                        break
                    # the last pixel of a row lies in no area, as their spans end before their vertices
                    above = rank[lo:hi], (best[:, : max(1, grid - 1)] if area[begin] else best).min(axis=1)
                    if area[begin]:
                        _paint_spans(flat, rank[lo:hi], *area_spans(first[lo : hi + 1], x, y, grid, above), grid)
                    else:
                        way, row, px = line_pixels(first[lo : hi + 1], x, y, radius[lo:hi], grid, above)
                        np.maximum.at(flat, row * grid + px, rank[lo:hi][way])
        if best is not None:
            yield _rows_of(tile, kind, best)

    return run


def _paint_spans(flat: np.ndarray, rank: np.ndarray, way: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, grid: int) -> None:
    for part in _portions(b - a + 1):
        which, at = ranges((y * grid + a)[part], (y * grid + b)[part])
        np.maximum.at(flat, at, rank[way[part]][which])


def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile_id, y, ranks) in that order -> (tile_id, y, classes), of the highest of equal rows: a byte for each
    pixel, its class and 1, or 0 where nothing is painted."""

    def row(key: tuple, kind: pa.DataType, best: np.ndarray) -> pa.RecordBatch:
        code = np.where(best == 0, 0, (best & 15) + 1).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([key[1]], pa.int32()), pa.array([code.tobytes()], pa.binary())], names=["tile_id", "y", "classes"])

    key, kind, best = None, None, None
    for batch in batches:
        kind = batch.column("tile_id").type
        for tile, y, ranks in zip(*(batch.column(c) for c in ("tile_id", "y", "ranks")), strict=True):
            own, ranks = (tile.as_py(), y.as_py()), np.frombuffer(ranks.as_buffer(), np.int64)
            if own == key:
                best = np.maximum(best, ranks)
                continue
            if best is not None:
                yield row(key, kind, best)
            key, best = own, ranks
    if best is not None:
        yield row(key, kind, best)


def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``highest`` -> (tile_id, y, x, class) of painted pixels."""
    for batch in batches:
        for i, classes in enumerate(batch.column("classes")):
            code = np.frombuffer(classes.as_buffer(), np.uint8)
            x = np.flatnonzero(code)
            place = pa.array(np.full(len(x), i))
            yield pa.RecordBatch.from_arrays([batch.column("tile_id").take(place), batch.column("y").take(place), pa.array(x.astype(np.int32)), pa.array(code[x].astype(np.int32) - 1)], names=["tile_id", "y", "x", "class"])
