"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

Method.  A document's fingerprint is the bitwise majority of the hashes of its three-word shingles.
Equal fingerprints are one member from then on.  A vantage-point tree over a sample of the fingerprints
cuts Hamming space into shards: every member lives in the shard that its distances to the tree's vantage
points lead to, and by the triangle bound it can only have partners in shards whose borders it is
within the radius of.  It visits those of them that lie on the inner side, so that each pair of
neighbouring shards is compared once.  Within a shard a second tree, over the shard's members, answers
all queries at once: a branch is entered by the queries that the triangle bound leaves there, and left
alone where all it could tell is known, namely where its members and the query are connected already.

The sample decides how even the shards are, and cannot change a result.  A shard of more members, or of
more queries, than a task should hold is cut into blocks, each pair of which is a task of its own.  Only
links that join something new leave a task, so dense groups give no pair lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tesselon.llm.graph import components
from tesselon.llm.store import Scratch, by_slices, release, written

#: Words of a shingle, and the seed of its hash.
WIDTH, SEED = 3, 42
#: Differing bits at which fingerprints still link.
RADIUS = 3
#: Members of a shard that the routing tree aims at, the most members and queries of a task, and of a leaf.
SHARD, MEMBERS, QUERIES, LEAF = 1 << 16, 1 << 17, 1 << 18, 64
#: Fingerprints that the routing tree is made of: so many for each shard, and at most so many in all.
PER_SHARD, SAMPLE = 16, 1 << 20
#: Fingerprints that are routed at once, and shingles that are hashed at once.
ROUTED, PART = 1 << 17, 1 << 14


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of one whole text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six blanks of ASCII
    if not words:
        return 0
    joined, wide = b" ".join(words), min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    del words
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(size) - wide + 1], end[wide - 1 :]
    of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(first), PART):
        a, b = first[k : k + PART].tolist(), last[k : k + PART].tolist()
        hashes = np.fromiter((of(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), "<u8", len(a))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc", "fp"])

    return run


# ---------------------------------------------------------------- trees


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_at(d: np.ndarray) -> int | None:
    """The distance nearest the median that leaves members on both sides, those up to it and those beyond."""
    values, counts = np.unique(d, return_counts=True)
    if len(values) < 2:
        return None
    below = np.cumsum(counts)[:-1]
    return int(values[int(np.argmin(np.abs(2 * below - len(d))))])


class Router:
    """The tree whose leaves are the shards: for each node a vantage point, a distance and two children.

    A child below zero is the shard -1 - child.
    """

    def __init__(self, sample: np.ndarray, shards: int):
        self.point: list[int] = []
        self.at: list[int] = []
        self.child: list[list[int]] = []
        self.shards = 0
        sample = np.unique(sample)
        rng = np.random.Generator(np.random.PCG64(11))
        stack = [(sample, max(1, shards), None)]
        while stack:
            own, parts, parent = stack.pop()
            mu, vantage = None, np.uint64(0)
            if parts > 1 and len(own) > 1:
                vantage = own[int(rng.integers(len(own)))]
                mu = split_at(distance(own, vantage))
            if mu is None:
                number = -1 - self.shards
                self.shards += 1
            else:
                number = len(self.point)
                self.point.append(int(vantage))
                self.at.append(mu)
                self.child.append([0, 0])
                inside = distance(own, vantage) <= mu
                stack.append((own[inside], (parts + 1) // 2, (number, 0)))
                stack.append((own[~inside], parts // 2, (number, 1)))
            if parent:
                self.child[parent[0]][parent[1]] = number

    def route(self, fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, positions, whether the shard is their home) of all fingerprints.

        Of two neighbouring regions the outer one's members visit the inner one, where the triangle
        bound allows a partner there.
        """
        stack = [(0 if self.point else -1, np.arange(len(fp)), np.ones(len(fp), bool))]
        while stack:
            node, own, home = stack.pop()
            if node < 0:
                yield -1 - node, own, home
                continue
            d, mu = distance(fp[own], np.uint64(self.point[node])).astype(np.int16), self.at[node]
            inner = d <= mu + radius
            outer = np.where(home, d > mu, d > mu - radius)
            for side, into in enumerate((inner, outer)):
                if into.any():
                    stack.append((self.child[node][side], own[into], (home & (d <= mu if side == 0 else d > mu))[into]))


class Forest:
    """Connected members of a task, with the links that connected them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                break
            r = self.parent[up]
        self.parent[x] = r
        return r

    def star(self, centre: int, others: np.ndarray) -> None:
        """Links of ``centre`` with each of ``others``; those that join something new are kept."""
        own = int(self.find(np.array([centre]))[0])
        roots, first = np.unique(self.find(others), return_index=True)
        fresh = roots != own
        if fresh.any():
            roots, first = roots[fresh], first[fresh]
            self.parent[roots] = own
            self.a.append(np.full(len(first), centre))
            self.b.append(others[first])


def links(fp: np.ndarray, member: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """Pairs (i, j) within ``radius`` bits that connect all of ``fp`` with the members that they can reach.

    ``fp`` are distinct fingerprints; ``member`` tells which of them the tree holds.  Every fingerprint
    is a query.
    """
    forest = Forest(len(fp))
    rng = np.random.Generator(np.random.PCG64(len(fp)))
    members = np.flatnonzero(member)
    if not len(members) or len(fp) < 2:
        return np.zeros((0, 2), np.int64)
    order = members.copy()  # a node is a range of it
    nodes: list[tuple[int, int, int, int, int, int]] = []  # (from, to, vantage member or -1, distance, inside, outside)
    stack = [(0, len(order), None)]
    while stack:
        a, b, parent = stack.pop()
        number = len(nodes)
        own = order[a:b]
        mu, vantage = None, -1
        if b - a > leaf:
            vantage = int(own[int(rng.integers(len(own)))])
            d = distance(fp[own], fp[vantage])
            forest.star(vantage, own[d <= radius])
            mu = split_at(d)
        nodes.append((a, b, vantage if mu is not None else -1, mu or 0, 0, 0))
        if parent is not None:
            p = nodes[parent[0]]
            nodes[parent[0]] = (*p[:4], number, p[5]) if parent[1] == 0 else (*p[:5], number)
        if mu is not None:
            inside = d <= mu
            order[a:b] = np.concatenate([own[inside], own[~inside]])
            middle = a + int(inside.sum())
            stack += [(middle, b, (number, 1)), (a, middle, (number, 0))]

    work = [(0, np.arange(len(fp)))]
    while work:
        number, queries = work.pop()
        a, b, vantage, mu, inside, outside = nodes[number]
        labels = forest.find(order[a:b])
        if (labels == labels[0]).all():  # connected among themselves: queries connected with them have nothing to find
            queries = queries[forest.find(queries) != labels[0]]
        if not len(queries):
            continue
        if vantage < 0:
            _leaf(fp, order[a:b], queries, radius, forest)
            continue
        d = distance(fp[queries], fp[vantage]).astype(np.int16)
        near = queries[d <= radius]
        if len(near):
            forest.star(vantage, near)
        work.append((outside, queries[d > mu - radius]))
        work.append((inside, queries[d <= mu + radius]))
    if not forest.a:
        return np.zeros((0, 2), np.int64)
    return np.stack([np.concatenate(forest.a), np.concatenate(forest.b)], axis=1)


def _leaf(fp: np.ndarray, own: np.ndarray, queries: np.ndarray, radius: int, forest: Forest, cells: int = 1 << 17) -> None:
    """Compare all queries with the members of a leaf, in bounded parts."""
    for m in range(0, len(own), LEAF):
        some = own[m : m + LEAF]
        step = max(1, cells // len(some))
        for q in range(0, len(queries), step):
            part = queries[q : q + step]
            hit = distance(fp[part][:, None], fp[some][None, :]) <= radius
            for k in np.flatnonzero(hit.sum(axis=0) > 0).tolist():
                others = part[hit[:, k]]
                if len(others) > 1 or others[0] != some[k]:
                    forest.star(int(some[k]), others)


# ---------------------------------------------------------------- operator


def _route(router: Router, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def routed(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fp = np.concatenate(parts)
            for shard, own, home in router.route(fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(fp[own]), pa.array(home)], names=["shard", "fp", "home"])

        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy())
            n += batch.num_rows
            if n >= ROUTED:
                yield from routed(parts)
                parts, n = [], 0
        if n:
            yield from routed(parts)

    return run


def pairs(members: DataFrame, scratch: Scratch, radius: int = RADIUS, shard: int = SHARD, most_members: int = MEMBERS, most_queries: int = QUERIES) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``fp`` of ``members`` that differ in ``radius`` bits or fewer."""
    spark = members.sparkSession
    n = members.count()
    shards = max(1, min(-(-n // shard), SAMPLE // PER_SHARD))
    share = min(1.0, 1.2 * PER_SHARD * shards / max(1, n))
    # by a hash, so that a task that is run again draws the same; the limit is there for safety only
    drawn = members.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE) if shards > 1 else members.limit(0)
    router = Router(np.array(sorted(r.fp for r in drawn.select("fp").collect()), np.int64).view(np.uint64), shards)
    dealt = scratch.written(members.select("fp").mapInArrow(_route(router, radius), "shard int, fp long, home boolean"), "routed")

    # the counts have a row for each shard, of which there are SAMPLE / PER_SHARD at most
    sizes = dealt.groupBy("shard").agg(F.ceil(F.sum(F.col("home").cast("long")) / most_members).alias("mblocks"), F.ceil(F.count("*") / most_queries).alias("qblocks"))
    placed = dealt.join(F.broadcast(sizes.filter("mblocks > 0")), "shard")
    place = placed.select("shard", "fp", "home", "mblocks", "qblocks", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("mblocks")).alias("m"), F.pmod(F.xxhash64("fp", F.lit(2)), F.col("qblocks")).alias("q"))

    def upto(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    asked = place.select("shard", upto("mblocks").alias("m"), "q", "fp", F.lit(False).alias("member"))
    held = place.filter("home").select("shard", "m", upto("qblocks").alias("q"), "fp", F.lit(True).alias("member"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp, where = np.unique(rows["fp"].to_numpy().view(np.uint64), return_inverse=True)
        member = np.zeros(len(fp), bool)
        member[where[rows["member"].to_numpy()]] = True
        found = fp.view(np.int64)[links(fp, member, radius)]
        release()
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return asked.unionByName(held).groupBy("shard", "m", "q").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``; ``fingerprint`` is 16 hexadecimal digits.

    The component is the smallest key reachable over links of ``radius`` bits or fewer.  A null, empty
    or wordless text has the fingerprint zero, which links like any other; fewer words than ``width``
    are one shingle.  Ties (as many hashes with a bit as without) give the bit 0.  Texts of any length
    are taken whole.  Repeated rows are repeated; rows with the same key but different texts are linked
    only where their fingerprints are.  A row with a null key has a fingerprint, no component, and
    connects nothing.  ``key`` must be a whole number; other columns are ignored; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.written(rows.mapInArrow(by_slices(_sign(width)), "doc long, fp long"), "fingerprints")
        members = scratch.written(signed.filter("doc is not null").groupBy("fp").agg(F.min("doc").alias("doc")), "members")
        found = scratch.written(pairs(members, scratch, radius), "pairs")
        joined = scratch.written(members.join(components(found, scratch=scratch).withColumnRenamed("node", "fp"), "fp"), "joined")
        smallest = joined.groupBy("component").agg(F.min("doc").alias("smallest"))
        # only members with a partner need a look; the rest are named by their own smallest document
        moved = joined.join(smallest, "component").select("fp", "smallest")
        named = scratch.written(members.join(moved, "fp", "left").select("fp", F.coalesce("smallest", "doc").alias("component_id")), "named")
        out = signed.join(named, "fp", "left").select(F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))
        return written(out, "simhash")
