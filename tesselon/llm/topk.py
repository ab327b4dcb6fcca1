"""Exact top-k inner products with block-at-a-time pruning.

Method: documents are dealt to the nearest of a few pivots and cut into ranges of like vectors; a range
keeps each term's largest and smallest weight, and so does each block of the range's forward index.
For a query, the sum over terms of what the extreme weights could give bounds every score in a range or
block.  A query first scores one range of its own pivot, which gives it k scores and so a k-th.  Ranges
whose bound falls below the k-th of every query of a query block are left where they are; the others
are taken in descending order of their bound, and within them the blocks, each scored through the
forward index, until the bounds fall below the k-th best score so far.  Bounds err upwards only and
scores are whole numbers, so the result is exact.

Queries, too, are dealt into blocks by their pivots.  Only summaries of ranges meet every query block;
vectors travel to the query blocks that could use them.  Each task passes on k rows a query at most, and
a window picks the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tesselon.llm.store import Scratch, by_slices, written

#: Vectors of a range, of a query block and of a block within a range; ranges of a shelf of summaries, and of a task.
RANGE, QUERIES, BLOCK, SHELF, TAKE = 2048, 2048, 256, 1024, 8
#: Pivots: one for each so many vectors, and at most so many.
PER_PIVOT, PIVOTS = 4096, 1024
_NONE = -(1 << 63)


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, vectors = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(scale * np.array(v, np.float64))
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                sizes.append(len(v))
                vectors.append(x.astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary())], names=list("abc"))

    return run


def _packed(vectors: list[bytes], size: int) -> bytes:
    """The vectors one after the other: as 32-bit whole numbers, or all as doubles if one needs them."""
    if all(len(v) == 4 * size for v in vectors):
        return b"".join(vectors)
    return b"".join(np.frombuffer(v, "<i4").astype("<f8").tobytes() if len(v) == 4 * size else v for v in vectors)


def _matrix(data: bytes, rows: int, size: int) -> np.ndarray:
    """The packed vectors as whole numbers: of 32 bits, or as objects if they are held as doubles."""
    if len(data) == 4 * rows * size:
        return np.frombuffer(data, "<i4").reshape(rows, size)
    return np.array([int(x) for x in np.frombuffer(data, "<f8")], object).reshape(rows, size)


def search(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int, block: int = BLOCK, floor: list[int] | None = None, work: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, its best (ids, scores) among ``docs``; ``own`` are the queries' ids.

    Ties go to the smaller id.  Rows with the query's id are its own and take no part.  ``floor`` holds
    a score for each query below which nothing is asked for; ``work`` takes up how many pairs of a query
    and a block were scored, and of how many.
    """
    nq, n = len(queries), len(docs)
    width = max(1, docs.shape[1])
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(docs).max(initial=0)) * width
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    # neighbours share their two strongest terms and those terms' signs
    strong = np.argsort(-np.abs(docs), axis=1, kind="stable")[:, :2]
    sign = np.take_along_axis(docs, strong, 1) < 0
    order = np.lexsort([ids, *(np.concatenate([strong * 2 + sign], 1).T[::-1])]) if n else np.zeros(0, np.int64)
    ids, docs = ids[order], docs[order].astype(kind)
    q = queries.astype(kind)
    cuts = [*range(0, n, block), n] if n else [0]
    blocks = list(zip(cuts, cuts[1:], strict=False))
    high = np.stack([docs[a:b].max(0) for a, b in blocks]) if blocks else np.zeros((0, width), kind)
    low = np.stack([docs[a:b].min(0) for a, b in blocks]) if blocks else high
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    by = np.argsort(-bound, axis=1, kind="stable")
    # below every score; whole numbers must keep a negative of their own
    least = -np.inf if kind in (np.float32, np.float64) else -(1 << 62) if kind is np.int64 else -most - 1
    score = np.full((nq, k), least, kind)
    name = np.full((nq, k), np.iinfo(np.int64).max, np.int64)
    asked = np.array([max(-most - 1, min(most + 1, x)) for x in floor] if floor is not None else [-most - 1] * nq, object).astype(kind)
    live = np.arange(nq)
    scored = 0
    for r in range(len(blocks)):
        at = by[live, r]
        keep = bound[live, at] >= np.maximum(score[live, k - 1], asked[live])
        live, at = live[keep], at[keep]
        if not len(live):
            break
        scored += len(live)
        turn = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[turn], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(turn)], strict=False):
            mine = live[turn[lo:hi]]
            a, b = blocks[at[turn[lo]]]
            s = q[mine] @ docs[a:b].T
            hit = (s >= np.maximum(score[mine, k - 1], asked[mine])[:, None]).any(1)
            if not hit.any():
                continue
            mine, s = mine[hit], s[hit]
            who = np.broadcast_to(ids[a:b], s.shape)
            lost = (who == own[mine][:, None]) | (s < asked[mine][:, None])
            if lost.any():
                s[lost] = least
                who = np.where(lost, np.iinfo(np.int64).max, who)
            s = np.concatenate([score[mine], s], 1)
            who = np.concatenate([name[mine], who], 1)
            top = np.lexsort((who, -s), axis=1)[:, :k]
            score[mine] = np.take_along_axis(s, top, 1)
            name[mine] = np.take_along_axis(who, top, 1)
    if work is not None:
        work[0] += scored
        work[1] += nq * len(blocks)
    out = []
    for i in range(nq):
        real = name[i] != np.iinfo(np.int64).max
        if kind is object and any(abs(s) >= 1 << 63 for s in score[i][real]):
            raise ValueError(f"query {own[i]}: a score beyond 64 bits")
        out.append((name[i][real], score[i][real].astype(np.int64)))
    return out


def _assign(pivots: dict[int, np.ndarray]):
    """Adds the number of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                p = pivots.get(n)
                if p is None or not n:
                    near.append(0)
                    continue
                x = np.frombuffer(v.as_buffer(), "<i4" if v.as_buffer().size == 4 * n else "<f8").astype(np.float64)
                near.append(int(np.argmin((p * p).sum(1) - 2 * (p @ x))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=list("abcd"))

    return run


def _gather(bounds: bool):
    """Rows (n, name, pivot, chunk, [(id, v, pivot)]) -> a row of packed vectors, with bounds for ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, members = batch.column(0)[i].as_py(), sorted(batch.column(2)[i].as_py(), key=lambda m: (m["id"], m["v"]))
                data = _packed([m["v"] for m in members], n)
                ids = np.array([m["id"] for m in members], "<i8")
                out = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([ids.tobytes()]), pa.array([data]), pa.array([np.array([m["near"] for m in members], "<i4").tobytes()])]
                if bounds:
                    x = np.frombuffer(data, "<i4" if len(data) == 4 * n * len(ids) else "<f8").reshape(len(ids), n).astype("<f8")
                    out += [pa.array([x.min(0).tobytes()]), pa.array([x.max(0).tobytes()])]
                yield pa.RecordBatch.from_arrays(out, names=list("abcdefg")[: len(out)])

    return run


def _found(own: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], work: list[int]) -> pa.RecordBatch:
    """A row for each result; the row without a query tells the work that was done, and of how much."""
    sizes = [len(a) for a, _ in found]
    query = pa.array([*np.repeat(own, sizes).tolist(), None], pa.int64())
    return pa.RecordBatch.from_arrays([query, pa.array([*(x for a, _ in found for x in a.tolist()), work[0]], pa.int64()), pa.array([*(x for _, s in found for x in s.tolist()), work[1]], pa.int64())], names=list("abc"))


def _home(k: int):
    """Queries of a block against one range of a pivot: those that have this pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, ids = np.frombuffer(row["own"], "<i8"), np.frombuffer(row["ids"], "<i8")
                mine = np.frombuffer(row["near"], "<i4") == row["pivot"]
                if mine.any():
                    q, d = _matrix(row["q"], len(own), row["n"])[mine], _matrix(row["d"], len(ids), row["n"])
                    work = [0, 0]
                    yield _found(own[mine], search(q, own[mine], ids, d, k, work=work), work)

    return run


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query block against a shelf of summaries -> (n, query block, range, largest bound) of those in reach."""
    for batch in batches:
        for row in batch.to_pylist():
            own, near, n = np.frombuffer(row["own"], "<i8"), np.frombuffer(row["near"], "<i4"), row["n"]
            floor = _floor(own, row["floors"])
            q = _matrix(row["q"], len(own), n).astype(np.float64)
            low, high = (np.stack([np.frombuffer(x[side], "<f8") for x in row["shelf"]]) for side in ("low", "high"))
            bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            bound += (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12  # rounding errs upwards
            pivot, chunk = (np.array([x[c] for x in row["shelf"]]) for c in ("pivot", "chunk"))
            done = (chunk == 0) & (near[:, None] == pivot)
            ok = ~done & (bound >= np.nextafter(np.array(floor, np.float64), -np.inf)[:, None])
            at = np.flatnonzero(ok.any(0))
            best = np.where(ok, bound, -np.inf).max(0)[at] if len(at) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.int32()), pa.array([row["qb"]] * len(at), pa.int64()), pa.array([row["shelf"][i]["rid"] for i in at.tolist()], pa.int64()), pa.array(best)], names=list("abcd"))


def _floor(own: np.ndarray, floors: list[dict] | None) -> list[int]:
    known = {x["query_id"]: x["floor"] for x in floors or []}
    return [known.get(i, _NONE) for i in own.tolist()]


def _rest(k: int):
    """A query block against several ranges, the best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, near, n = np.frombuffer(row["own"], "<i8"), np.frombuffer(row["near"], "<i4"), row["n"]
                q, floor = _matrix(row["q"], len(own), n), _floor(own, row["floors"])
                for part in sorted(row["ranges"], key=lambda x: (-x["bound"], x["rid"])):
                    ids = np.frombuffer(part["ids"], "<i8")
                    mine = (near != part["pivot"]) | (part["chunk"] != 0)
                    asked, work = np.flatnonzero(mine).tolist(), [0, 0]
                    found = search(q[mine], own[mine], ids, _matrix(part["d"], len(ids), n), k, floor=[floor[i] for i in asked], work=work)
                    for i, (_, s) in zip(asked, found, strict=True):
                        if len(s) == k:
                            floor[i] = max(floor[i], int(s[-1]))
                    yield _found(own[mine], found, work)

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", work: dict[str, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id ``every`` divides.

    Components become floor(scale * x).  Vectors that are null or hold a null or non-finite component
    take no part; vectors of different lengths never meet.  Rows that share the query's id count as
    its own; of repeated query ids one vector is asked.  Ties rank by the smaller id.  Components may be of any
    size; a score among the best that a 64-bit number cannot hold is an error.  Other columns are
    ignored; an empty table gives no rows.  ``work`` takes up how many pairs of a query and a block were
    ``scored``, of how many ``blocks``.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.written(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(by_slices(_quantise(scale)), "id long, n int, v binary"), "vectors")
        query = F.pmod("id", F.lit(every)) == 0
        size = rows.agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q")).first()
        count = max(1, min(PIVOTS, size.n // PER_PIVOT))
        sample: dict[int, dict[bytes, None]] = {}
        for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(count).collect():
            sample.setdefault(r.n, {})[bytes(r.v)] = None
        pivots = {n: np.stack([np.frombuffer(v, "<i4" if len(v) == 4 * n else "<f8").astype(np.float64) for v in vs]) for n, vs in sample.items()}
        near = scratch.written(rows.mapInArrow(by_slices(_assign(pivots)), "id long, n int, v binary, near int"), "near")

        # ranges: a pivot's vectors in chunks; the number only spreads repeated rows
        place = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.ceil(F.col("m") / RANGE)).cast("int")
        chunked = near.join(near.groupBy("n", "near").agg(F.count("*").alias("m")), ["n", "near"]).withColumn("chunk", place)
        name = F.struct(F.col("near").alias("pivot"), "chunk")
        grouped = chunked.groupBy("n", name.alias("name")).agg(F.collect_list(F.struct("id", "v", "near")).alias("members"))
        kinds = "n int, name struct<pivot:int,chunk:int>, ids binary, d binary, near binary, low binary, high binary"
        ranges = grouped.mapInArrow(by_slices(_gather(True), 4), kinds).select("n", "name.*", "ids", "d", "low", "high")
        ranges = scratch.written(ranges.withColumn("rid", F.monotonically_increasing_id()), "ranges")

        # query blocks: neighbouring pivots' queries together
        wanted = max(1, -(-size.q // QUERIES))
        group = F.floor(F.col("near") * wanted / count).alias("grp")
        asked = near.filter(query).groupBy("id", "n").agg(F.min(F.struct("v", "near")).alias("x")).select("id", "n", "x.v", "x.near").withColumn("grp", group)
        parts = asked.groupBy("n", "grp").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
        asked = asked.join(parts, ["n", "grp"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        blocks = asked.groupBy("n", F.struct("grp", "part").alias("name")).agg(F.collect_list(F.struct("id", "v", "near")).alias("members"))
        blocks = blocks.mapInArrow(by_slices(_gather(False), 4), "n int, name struct<grp:long,part:long>, own binary, q binary, near binary").select("n", "name.grp", "own", "q", "near")
        blocks = scratch.written(blocks.withColumn("qb", F.monotonically_increasing_id()), "queries")

        first = ranges.filter("chunk = 0").withColumn("grp", F.floor(F.col("pivot") * wanted / count)).select("n", "grp", "pivot", "ids", "d")
        home = scratch.written(blocks.join(first, ["n", "grp"]).mapInArrow(by_slices(_home(k), 4), "query_id long, vec_id long, score long"), "home")
        best = home.filter("query_id is not null").groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("floor")).filter(F.col("m") == k)
        member = asked.select(F.col("id").alias("query_id"), "n", "grp").join(best, "query_id")
        floors = member.groupBy("n", "grp").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
        blocks = scratch.written(blocks.join(floors, ["n", "grp"], "left"), "floors")

        # summaries of all ranges meet every query block; ranges follow where they could count
        turn = F.pmod("rid", F.lit(max(1, -(-ranges.count() // SHELF))))
        shelves = ranges.select("n", turn.alias("turn"), F.struct("rid", "pivot", "chunk", "low", "high").alias("s")).groupBy("n", "turn").agg(F.collect_list("s").alias("shelf"))
        turns = shelves.groupBy("n").agg(F.collect_list("turn").alias("turns"))
        met = blocks.join(turns, "n").withColumn("turn", F.explode("turns")).join(shelves, ["n", "turn"]).select("n", "qb", "own", "q", "near", "floors", "shelf")
        reach = scratch.written(met.mapInArrow(by_slices(_reach, 4), "n int, qb long, rid long, bound double"), "reach")
        order = Window.partitionBy("qb").orderBy(F.desc("bound"), "rid")
        reach = reach.select("qb", "rid", "bound", F.floor((F.row_number().over(order) - 1) / TAKE).alias("take"))
        taken = reach.join(ranges, "rid").groupBy("qb", "take").agg(F.collect_list(F.struct("rid", "bound", "pivot", "chunk", "ids", "d")).alias("ranges"))
        rest = taken.join(blocks.select("n", "qb", "own", "q", "near", "floors"), "qb").mapInArrow(by_slices(_rest(k), 1), "query_id long, vec_id long, score long")
        found = scratch.written(home.unionByName(rest), "found")
        if work is not None:
            done = found.filter("query_id is null").agg(F.sum("vec_id").alias("scored")).first()
            work["scored"] = done.scored or 0
            cells = ranges.groupBy("n").agg(F.sum(F.ceil(F.octet_length("ids") / (8 * BLOCK))).alias("m")).join(blocks.groupBy("n").agg(F.sum(F.octet_length("own") / 8).alias("q")), "n")
            work["blocks"] = int(cells.agg(F.sum(F.col("m") * F.col("q"))).first()[0] or 0)
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.filter("query_id is not null").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        return written(ranked.select("query_id", "rank", "vec_id", "score"), "top")
