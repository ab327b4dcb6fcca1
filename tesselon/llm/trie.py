"""Prefix trie of conversations: ternary search trees over turn ids, one for each range shard.

Method.  Distinct turns get ids, and a conversation is the sequence of its turns' ids.  Equal sequences
are one path from then on.  Paths are dealt out by ranges; each shard inserts its sorted paths into a
ternary search tree, the median first, which balances it, and one pass over the tree's nodes, children
before parents, adds up members, leaves and savings.  Nodes that other shards may hold too lie on the
shard's first and last path; these are passed on in part, and merged by what names them, the digest of
their ids: sums are added, and what a merged node adds to its ancestors is summed along the path of one
shard that holds it.

Sequences are cut into layers of ``DEPTH`` turns, so that a row stays small however long a conversation
is: what continues a path of that length is a tree of its own, whose root is merged with that path's
end, the deepest layer first.  Turns are numbered over ranges, not conversation by conversation.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.llm.store import Scratch, written

#: Turns of a layer, turns of a shard, rows of a range that are numbered together, ids of a chunk of members.
DEPTH, SHARD, ROWS, CHUNK = 1024, 1 << 18, 1 << 18, 4096
NOBODY = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- one shard


class Tree:
    """A ternary search tree of sequences of ids.  Node 0 is the root; a node's parent comes before it."""

    def __init__(self):
        self.label, self.low, self.high, self.down, self.parent, self.words = [0], [-1], [-1], [-1], [-1], [0]
        self.members, self.first, self.ends = [0], [None], [None]

    def _new(self, label: int, parent: int, words: int) -> int:
        self.label.append(label)
        for x in (self.low, self.high, self.down):
            x.append(-1)
        self.parent.append(parent)
        self.words.append(words)
        self.members.append(0)
        self.first.append(None)
        self.ends.append(None)
        return len(self.label) - 1

    def insert(self, path: list[int], words: list[int], members: int, first: int, ends: str | None) -> None:
        at = 0
        for label, size in zip(path, words, strict=True):
            node, links = self.down[at], self.down
            place = at
            while node >= 0 and self.label[node] != label:
                links, place = (self.low if label < self.label[node] else self.high), node
                node = links[node]
            if node < 0:
                node = links[place] = self._new(label, at, size)
            at = node
        self.members[at], self.first[at], self.ends[at] = members, first, ends

    def insert_all(self, rows: list[tuple]) -> None:
        """Sorted paths, the median first, then both halves alike."""
        stack = [(0, len(rows))]
        while stack:
            a, b = stack.pop()
            if a < b:
                middle = (a + b) // 2
                self.insert(*rows[middle])
                stack += [(middle + 1, b), (a, middle)]

    def nodes(self, path: list[int]) -> list[int]:
        """The root and the nodes along a path."""
        out = [0]
        for label in path:
            node = self.down[out[-1]]
            while self.label[node] != label:
                node = (self.low if label < self.label[node] else self.high)[node]
            out.append(node)
        return out

    def add_up(self, open_: set[int]) -> None:
        """Members of every subtree; children, leaves and savings of what hangs below each node, where
        the ``open_`` nodes, which other shards may hold, count for nothing themselves."""
        n = len(self.label)
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.members[p] += self.members[i]
            self.first[p] = self.first[i] if self.first[p] is None else min(self.first[p], self.first[i])
            if i not in open_:
                if not self.children[i]:
                    self.leaves[i] = 1
                self.saved[i] += (self.members[i] - 1) * self.words[i]
                self.children[p] += 1
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]


#: A shard's rows: nodes that are done, and nodes of the chains (open paths) with what the shard adds.
_FIELDS = "chain long, shard long, layer long, depth long, digest binary, parent binary, parent_first long, fresh boolean, members long, first long, children long, leaves long, saved long, words long, ends string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string()]


def _sharded(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        shard, chain = TaskContext.get().partitionId(), 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])
            out.clear()
            return batch

        a = 0
        while a < len(rows):
            prefix, layer = rows[a][:2]
            b = a
            while b < len(rows) and rows[b][0] == prefix:
                b += 1
            own = rows[a:b]
            tree = Tree()
            tree.insert_all([r[2:7] for r in own])
            chains = [(r, tree.nodes(r[2])) for i, r in enumerate(own) if a + i in (0, len(rows) - 1) or len(r[2]) == depth] or [(own[0], [0])]
            open_ = {n for _, nodes in chains for n in nodes}
            tree.add_up(open_)
            digest: dict[int, bytes] = {0: prefix}
            for r, nodes in chains:
                for d, n in enumerate(nodes):
                    fresh = n not in digest or n == 0 and digest.get(-1) is None
                    if n == 0:
                        digest[-1] = b""
                    elif fresh:
                        digest[n] = r[7] if d == depth else hashlib.blake2b(digest[nodes[d - 1]] + struct.pack("<q", r[2][d - 1]), digest_size=32).digest()
                    up = digest[nodes[d - 1]] if d else None
                    sums = (tree.members[n], tree.first[n], tree.children[n], tree.leaves[n], tree.saved[n], tree.words[n], tree.ends[n]) if fresh else (0, None, 0, 0, 0, 0, None)
                    out.append((chain, shard, layer, layer * depth + d, digest[n], up, None, fresh, *sums))
                chain += 1
                if len(out) > 20_000:
                    yield flush()
            level = [0] * len(tree.label)
            for n in range(1, len(tree.label)):
                p = tree.parent[n]
                level[n] = level[p] + 1
                if n not in open_:
                    out.append((None, shard, layer, layer * depth + level[n], None, digest.get(p), None if p in open_ else tree.first[p], True, tree.members[n], tree.first[n], tree.children[n], tree.leaves[n], tree.saved[n], tree.words[n], tree.ends[n]))
                    if len(out) > 20_000:
                        yield flush()
            a = b
        if out:
            yield flush()

    return run


# ---------------------------------------------------------------- sequences


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, id, words), sorted by c -> with the range's number and the place in it among rows of the same c."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        c = batch.column(0).to_numpy()
        if not len(c):
            continue
        begins = np.flatnonzero(np.diff(c, prepend=c[0] - 1 if c[0] > -(1 << 62) else c[0] + 1))
        place = np.arange(len(c)) - np.repeat(begins, np.diff(np.append(begins, len(c))))
        if c[0] == last:
            place[: begins[1] if len(begins) > 1 else len(c)] += count
        last, count = c[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), part, np.int64)), pa.array(place)], names=["c", "id", "words", "part", "place"])


def numbered(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows: int = ROWS) -> DataFrame:
    """(c, seq, id, words): each conversation's turns in order, from 0; equal turns have equal ids.

    The order is by turn, nulls first; ties stand in the order of the digests of role and text.
    """
    r, x = (F.coalesce(F.col(n), F.lit("")) for n in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, x), 256))
    read = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), digest.alias("d"), F.regexp_count(x, F.lit(_WORD)).cast("long").alias("words"))
    known = scratch.written(read.groupBy("d").agg(F.max("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "turns")
    given = read.drop("words").join(known, "d").withColumn("copy", F.monotonically_increasing_id())
    parts = max(1, -(-turns.count() // rows))
    order = ["c", F.asc_nulls_first("t"), "d", "copy"]  # copies can be told apart, so that any number of them can be split
    dealt = given.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", "id", "words")
    placed = scratch.written(dealt.mapInArrow(_places, "c long, id long, words long, part long, place long"), "placed")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("c", "part").count().withColumn("offset", F.sum("count").over(before)).filter("offset is not null").drop("count")
    # of the conversations of a range only its first can have begun before: a row for each range at most
    return placed.join(F.broadcast(offsets), ["c", "part"], "left").select("c", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("seq"), "id", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, pos, id, words) of conversations that begin with turns of another, and a row with null ``pos`` for each.

    Conversation c has the first h turns of conversation c - c % 20, and then its own after its first h,
    where h is the checksum (CRC-32) of its decimal id modulo 4.
    """
    h, base = F.expr("crc32(cast(cast(c as string) as binary)) % 4"), F.expr("c - c % 20")
    convs = turns.select("c").distinct()
    heads = turns.filter("seq < 3 and c % 20 = 0").select(F.col("c").alias("base"), "seq", "id", "words")
    have = heads.groupBy("base").agg(F.count("*").alias("have"))
    given = convs.select("c", h.alias("h"), base.alias("base")).filter("h > 0").join(heads, "base").filter("seq < h").select("c", F.col("seq").alias("pos"), "id", "words")
    own = turns.withColumn("h", h).filter("seq >= h").withColumn("base", base).join(have, "base", "left")
    own = own.select("c", (F.least("h", F.coalesce("have", F.lit(0))) + F.col("seq") - F.col("h")).alias("pos"), "id", "words")
    null = F.lit(None).cast("long")
    return own.unionByName(given).unionByName(convs.select("c", null.alias("pos"), null.alias("id"), null.alias("words")))


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (c, layer, digest of the layer's ids) of one conversation -> (c, layer, prefix, last)."""
    rows = rows.sort_values("layer")
    prefix, out = b"", []
    for s in rows["s"]:
        out.append(prefix)
        prefix = hashlib.sha256(prefix + s).digest()
    return pd.DataFrame({"c": rows["c"], "layer": rows["layer"], "prefix": out, "last": [False] * (len(out) - 1) + [True]})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, members), sorted by path and chunk -> (path, digest of the members, comma-joined)."""
    key, now = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if now is not None:
                    done.append((key, now.hexdigest()))
                key, now = k, hashlib.sha256(ids.encode())
            else:
                now.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["path_key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([now.hexdigest()], pa.string())], names=["path_key", "ends"])


def _paths(turns: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """(prefix, layer, path, words, members, first, ends, path_key): the distinct paths of every layer."""
    one = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "words"))
    layer = F.coalesce(F.floor(F.col("pos") / depth), F.lit(0)).cast("long")
    cut = turns.groupBy("c", layer.alias("layer")).agg(F.array_sort(F.collect_list(one)).alias("all"))  # DEPTH turns at most
    cut = cut.select("c", "layer", F.transform("all", lambda x: x["id"]).alias("path"), F.transform("all", lambda x: x["words"]).alias("words"))
    cut = scratch.written(cut.withColumn("s", F.unhex(F.sha2(F.array_join(F.transform("path", lambda x: x.cast("string")), ","), 256))), "layers")
    many = F.expr(f"layer > 0 or size(path) = {depth}")
    short = cut.filter(~many).withColumn("prefix", F.lit(b"")).withColumn("last", F.lit(True))
    chained = cut.filter(many).select("c", "layer", "s").groupBy("c").applyInPandas(_chain, "c long, layer long, prefix binary, last boolean")
    # rows of a layer below DEPTH are many only where the layer is above 0
    part = cut.filter(many).join(chained, ["c", "layer"])
    key = F.unhex(F.sha2(F.concat("prefix", "s"), 256))
    rows = short.unionByName(part.select(*short.columns)).withColumn("path_key", key)
    listed = rows.filter("last").groupBy("path_key", F.floor(F.col("c") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    ends = listed.repartition("path_key").sortWithinPartitions("path_key", "chunk").select("path_key", "ids").mapInArrow(_ends, "path_key binary, ends string")
    paths = rows.groupBy("path_key").agg(F.first("prefix").alias("prefix"), F.first("layer").alias("layer"), F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("members"), F.min("c").alias("first"))
    return scratch.written(paths.join(ends, "path_key", "left").select("prefix", "layer", "path", "words", "members", "first", "ends", "path_key"), "paths")


# ---------------------------------------------------------------- merging


def _merged(chains: DataFrame, below: DataFrame | None) -> DataFrame:
    """The nodes of one layer's chains, with all that hangs below them.

    ``below`` has the sums of the trees that continue paths of this layer, by digest.
    """
    owner = F.min(F.when(F.col("fresh"), F.struct("shard", "chain")))
    sums = (F.sum(c).alias(c) for c in ("members", "children", "leaves", "saved"))
    nodes = chains.groupBy("digest").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("first").alias("first"), F.max("words").alias("words"), F.max("ends").alias("ends"), owner.alias("owner"), *sums)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, "digest", "left")
    if below is None:
        nodes = nodes.withColumns({f"more_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
    else:
        nodes = nodes.join(below, "digest", "left")

    def plus(*names: str) -> Column:
        return sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))

    nodes = nodes.withColumn("children", plus("children", "kids", "more_children"))
    nodes = nodes.withColumn("own_leaves", plus("leaves", "more_leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
    nodes = nodes.withColumn("own_saved", plus("saved", "more_saved") + (F.col("members") - 1) * F.col("words"))
    own = nodes.select("digest", "owner.shard", "owner.chain", "own_leaves", "own_saved")
    deeper = Window.partitionBy("shard", "chain").orderBy(F.desc("depth"))
    along = chains.select("shard", "chain", "depth", "digest").join(own, ["shard", "chain", "digest"], "left")
    totals = along.select("digest", *(F.coalesce(F.sum(f"own_{c}").over(deeper), F.lit(0)).alias(c) for c in ("leaves", "saved"))).groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("leaves", "saved").join(totals, "digest").select("digest", "depth", "parent", "first", "members", "children", "leaves", "saved", "ends")


def trie(turns: DataFrame, scratch: Scratch, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of conversations (c, pos, id, words), with a row of null ``pos`` for each conversation.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    paths = _paths(turns, scratch, depth)
    n = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = max(1, -(-n // shard))
    sorted_ = paths.repartitionByRange(shards, "prefix", "path").sortWithinPartitions("prefix", "path")
    made = scratch.written(sorted_.mapInArrow(_sharded(depth), _FIELDS), "shards")
    chains = made.filter("chain is not null")
    top = chains.agg(F.max("layer")).first()[0]
    open_, below = [], None
    for layer in range(-1 if top is None else top, -1, -1):
        nodes = scratch.written(_merged(chains.filter(F.col("layer") == layer), below), "merged")
        if layer:
            below = nodes.filter(F.col("depth") == layer * depth).select("digest", *(F.col(c).alias(f"more_{c}") for c in ("children", "leaves", "saved")))
            nodes = nodes.filter(F.col("depth") > layer * depth)
        open_.append(nodes)
    done = made.filter("chain is null")
    columns = ["first", "depth", "parent", "parent_first", "members", "children", "leaves", "saved", "ends"]
    nodes = done.select(*columns)
    for more in open_:
        nodes = nodes.unionByName(more.withColumn("parent_first", F.lit(None).cast("long")).select(*columns))
    lows = [m.select(F.col("digest").alias("parent"), F.col("first").alias("above")) for m in open_]
    if lows:
        known = lows[0]
        for m in lows[1:]:
            known = known.unionByName(m)
        nodes = nodes.join(known, "parent", "left").withColumn("parent_first", F.coalesce("parent_first", "above"))
    return nodes.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", depth: int = DEPTH, shard: int = SHARD, rows: int = ROWS, rebuild: bool = True) -> DataFrame:
    """The trie of all conversations, each rebuilt (see :func:`rebuilt`) unless told otherwise.

    A null role or text is empty, and so is one of no characters; rows of a null conversation belong to
    none.  Turns are ordered by number, nulls first, ties by the digest of role and text; repeated rows
    are repeated turns.  Texts and conversations of any length are taken whole.  A conversation id must
    be a whole number, and for negative ids the remainder has the sign of the id.  Other columns are
    ignored; an empty table gives no rows.
    """
    with Scratch(turns.sparkSession) as scratch:
        given = numbered(turns, scratch, conv, turn, role, text, rows)
        if rebuild:
            given = rebuilt(given)
        else:
            null = F.lit(None).cast("long")
            given = given.withColumnRenamed("seq", "pos").unionByName(given.select("c").distinct().select("c", null.alias("pos"), null.alias("id"), null.alias("words")))
        return written(trie(given, scratch, depth, shard), "trie")


SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i : list_reduce(list_prepend(i, range(8)), lambda a, b : CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
t AS (SELECT conv_id AS c, turn, sha256(CAST(length(r) AS VARCHAR) || ':' || r || x) AS d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce("text", '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, d, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS s FROM t),
ids AS (SELECT DISTINCT c, c - c % 20 AS base FROM n),
k AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z : CAST(ord(z) AS BIGINT))),
    lambda a, b : xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) % 4 AS h FROM ids, tab),
p AS (SELECT k.c, n.s, 0 AS o, n.d, n.w FROM k JOIN n ON n.c = k.base AND n.s < k.h UNION ALL SELECT k.c, n.s, 1, n.d, n.w FROM k JOIN n ON n.c = k.c AND n.s >= k.h),
m AS (SELECT c, row_number() OVER q AS depth, string_agg(d, '') OVER q AS node, w FROM p WINDOW q AS (PARTITION BY c ORDER BY o, s)
  UNION ALL SELECT c, 0, '', 0 FROM k),
l AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
e AS (SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS members FROM m JOIN l USING (c, depth) GROUP BY node),
g AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, CASE WHEN depth > 0 THEN left(node, length(node) - 64) END AS up FROM m GROUP BY node, depth),
f AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN f USING (node)),
s AS (SELECT left(node, 64 * i) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM (SELECT node, n_children, n_convs, w, unnest(range(depth + 1)) AS i FROM v) GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
FROM v JOIN s ON s.node = v.node LEFT JOIN v u ON u.node = v.up LEFT JOIN e ON e.node = v.node"""
