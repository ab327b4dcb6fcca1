"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Method.  Every document has a set of word shingles and a signature of K minima.  Documents with equal
sets are one class, which one document represents from then on.  A class is posted under its
(coordinate, value) pairs.  Two classes whose signatures agree in at least T coordinates must share a
pair among each one's K - T + 1 rarest pairs (the prefix), so only those are posted, and pairs that
one class alone has are skipped.

Collisions are counted on the posting lists in two passes.  The first pairs each list's members with
their neighbours in a random order and with the list's hub, the member whose pairs are the commonest: a
number of pairs that grows with the lists alone.  Pairs that agree in T coordinates or more are
confirmed on the full sets, and their components taken.  The second skips every list whose members are
in one component by then, and in the others counts the collisions of members of different components,
list chunk by list chunk and each pair in the first list it has in common.  Only members with a pair at
the match threshold pass on their sets, and a block returns no more links than join its members.
Pairs within a component need no link, so no similar pair is lost: it shares a list, and is either
connected by confirmed links after the first pass or counted in the second.

With K = 48 and T = 26, two sets of similarity 0.8 agree too rarely with a probability below 3e-5.
Hot lists are dealt out by a salt in the first pass and cut into chunks in the second; a list's
commonest component meets only the other members.  No pair list of a group is ever made, nothing is
collected on the driver, and no list, candidate or partner is capped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tesselon.llm import pieces
from tesselon.llm.graph import components
from tesselon.llm.store import Scratch, by_slices, lookups, written

#: Signature coordinates, and how many must agree.
K, AGREE = 48, 26
#: Members of a posting list, and shingles of theirs, that are handled at once.
LIST, SHINGLES = 512, 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240521))
_XOR = _rng.integers(0, 1 << 63, K, np.uint64)
_MUL = _rng.integers(0, 1 << 63, K, np.uint64) | np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


#: Random values of a byte at each place of a word; longer words are hashed whole.
_PLACES = 64
_VALUE = _rng.integers(0, (1 << 64) - 1, _PLACES << 8, np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def word_keys(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of words by tabulation: any two words collide with a probability of 2^-64."""
    size = end - first
    begin = np.cumsum(size) - size
    step = np.arange(int(size.sum()), dtype=np.int64)
    at = step - np.repeat(begin, size)
    h = np.zeros(len(step) + 1, np.uint64)
    np.cumsum(_VALUE[((at & (_PLACES - 1)) << 8) | data[np.repeat(first, size) + at]], out=h[1:])
    k = (h[begin + size] - h[begin]) ^ (size.astype(np.uint64) * _LENGTH)
    for i in np.flatnonzero(size > _PLACES).tolist():
        k[i] = np.frombuffer(hashlib.blake2b(data[first[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return k


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (ASCII lower case, words between white space)."""
    for part in pieces.chunks(texts):
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in part]
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = ~_SPACE[data]
        fresh = np.ones(len(data) + 1, bool)
        fresh[1:] = ~word[:-1]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        first = np.flatnonzero((word & (fresh | border))[:-1])
        end = np.flatnonzero(word[:-1] & (~word[1:] | border[1:])) + 1
        k = word_keys(data, first, end) if len(first) else np.zeros(0, np.uint64)
        n = max(0, len(k) - width + 1)
        s = np.zeros(n, np.uint64)
        for j in range(width):
            s = (s ^ (s >> np.uint64(31))) * _STEP[j % len(_STEP)] + k[j : j + n]
        s = (s ^ (s >> np.uint64(30))) * _STEP[-1]
        s ^= s >> np.uint64(32)
        at = np.searchsorted(first, offsets).tolist()
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:  # fewer words than a shingle: the whole sequence
                yield np.frombuffer(hashlib.blake2b(k[a:b].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(K, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), 1 << 14):
        out = np.minimum(out, (((shingles[a : a + (1 << 14)][None, :] ^ _XOR[:, None]) * _MUL[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype("<u4")


def _described(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, bytes | None, np.ndarray]]:
    """(shingles, digest of the set, signature as coordinate and value) of each text in column 1."""
    coordinate, none = np.arange(K, dtype=np.int64) << 32, np.zeros(0, np.int64)
    for u in shingle_sets([x or "" for x in batch.column(1).to_pylist()], width):
        if len(u):
            yield u, hashlib.blake2b(u.tobytes(), digest_size=16).digest(), coordinate | signature(u).astype(np.int64)
        else:
            yield u, None, none


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in values])]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for u, key, sig in _described(batch, width):
                n.append(len(u))
                keys.append(key)
                sigs.append(sig)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(sigs)], names=list("abcd"))

    return run


def _sets(width: int):
    """Rows (class, text, digest of the class) -> (class, size, signature, shingles) where they agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, len(u), sig, u.tobytes()) for c, want, (u, key, sig) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _described(batch, width), strict=True) if key == want]
            c, n, sigs, sets = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), _lists(list(sigs)), pa.array(sets, pa.binary())], names=list("abcd"))

    return run


def similar_sets(s: np.ndarray, t: np.ndarray, similar: int) -> bool:
    """Whether 100 * intersection >= similar * union, of sorted distinct values."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int(np.count_nonzero(t[at] == s))
    return 100 * both >= similar * (len(s) + len(t) - both)


def _confirm(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar_sets(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), similar) for s, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _union(parent: list[int], i: int, j: int) -> bool:
    """Join the trees of i and j; whether they were two."""
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    while parent[j] != j:
        parent[j] = j = parent[parent[j]]
    parent[i] = j
    return i != j


def collisions(pair: int, component: np.ndarray, size: np.ndarray, signatures: np.ndarray, prefixes: list[np.ndarray], similar: int) -> np.ndarray:
    """Places (i, j), i < j, of the members of list ``pair`` that agree in AGREE coordinates or more, are
    in different components and share no list before this one; the best matches first."""
    if component.min() == component.max():
        return np.zeros((0, 2), np.int64)
    agree = np.zeros((len(size), len(size)), np.int16)
    for c in signatures.T:
        agree += c[:, None] == c[None, :]
    ok = (agree >= AGREE) & (component[:, None] != component[None, :]) & (100 * np.minimum(size[:, None], size) >= similar * np.maximum(size[:, None], size))
    ok = np.triu(ok, 1)
    if ok.any():
        before = overlaps([p[p < pair] for p in prefixes])
        ok &= before == 0
    pairs = np.argwhere(ok)
    return pairs[np.argsort(-agree[pairs[:, 0], pairs[:, 1]], kind="stable")]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of distinct values."""
    flat = np.concatenate(sets)
    value, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[code] > 1
    number = np.cumsum(count > 1) - 1
    code, owner = number[code[shared]], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 23) // max(1, len(sets)))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(code, (a, a + width))
        x = np.zeros((len(sets), int(code[hi - 1]) - a + 1 if hi > lo else 0), np.float32)
        x[owner[lo:hi], code[lo:hi] - a] = 1
        out += x @ x.T
    return out


def block_links(pairs: np.ndarray, sets: list[np.ndarray], similar: int) -> list[tuple[int, int]]:
    """Those of ``pairs`` with 100 * overlap >= similar * union that join the members."""
    parent, size = list(range(len(sets))), [len(s) for s in sets]
    if len(pairs) > 20 * len(sets):
        i, j = pairs.T
        both, n = overlaps(sets)[i, j].astype(np.int64), np.array(size)
        found = pairs[100 * both >= similar * (n[i] + n[j] - both)]
        return [(a, b) for a, b in found.tolist() if _union(parent, a, b)]
    return [(a, b) for a, b in pairs.tolist() if similar_sets(sets[a], sets[b], similar) and _union(parent, a, b)]


def _members(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], pa.StructArray]:
    x = block.values
    cid, component, size = (x.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    prefix, ends = x.field(4).flatten().to_numpy(), np.cumsum([0, *pa.compute.list_value_length(x.field(4)).to_pylist()])
    return cid, component, size, x.field(3).flatten().to_numpy().reshape(len(x), K), [prefix[a:b] for a, b in zip(ends, ends[1:], strict=False)], x


def _needed(similar: int):
    """Rows (pair, i, j, members) -> (pair, i, j, cid) of the members with a pair at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, block in enumerate(batch.column(3)):
                cid, component, size, sig, prefixes, _ = _members(block)
                need = np.unique(collisions(batch.column(0)[r].as_py(), component, size, sig, prefixes, similar))
                where.append(np.full(len(need), r))
                who.append(cid[need])
            at = pa.array(np.concatenate(where))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(np.concatenate(who))], names=list("abcd"))

    return run


def _link(similar: int):
    """Rows (pair, members with sets) -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for pair, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cid, component, size, sig, prefixes, x = _members(block)
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in x.field(5)]
                links = block_links(collisions(pair, component, size, sig, prefixes, similar), sets, similar)
                a.append(cid[[i for i, _ in links]])
                b.append(cid[[j for _, j in links]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, members: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) at the match threshold whose full sets are similar."""
    for side in "ab":
        pairs = pairs.join(members.select(F.col("cid").alias(side), F.col("n").alias(f"n{side}"), F.col("pairs").alias(f"p{side}")), side)
    near = 100 * F.least("na", "nb") >= similar * F.greatest("na", "nb")
    pairs = pairs.filter(near).filter(F.size(F.array_intersect("pa", "pb")) >= AGREE).select("a", "b")
    for side in "ab":
        pairs = pairs.join(members.select(F.col("cid").alias(side), F.col("shingles").alias(f"s{side}")), side)
    return pairs.select("a", "b", "sa", "sb").mapInArrow(by_slices(_confirm(similar)), "a long, b long")


def _beside(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of members that stand side by side in a list, in an order of its own, or with its hub."""
    salt = F.pmod(F.xxhash64("cid", "pair"), F.ceil(F.col("often") / LIST))
    turn = Window.partitionBy("pair", "salt").orderBy("place", "cid")
    beside = lists.select("pair", "cid", salt.alias("salt"), F.xxhash64("pair", "cid").alias("place")).withColumn("next", F.lead("cid").over(turn))
    hubs = lists.groupBy("pair").agg(F.max(F.struct("weight", "cid")).alias("hub")).select("pair", F.col("hub.cid").alias("next"))
    pairs = beside.filter("next is not null").select("cid", "next").unionByName(lists.join(hubs, "pair").filter("cid <> next").select("cid", "next"))
    return pairs.select(F.least("cid", "next").alias("a"), F.greatest("cid", "next").alias("b")).distinct()


def _blocks(lists: DataFrame, joined: DataFrame, members: DataFrame) -> DataFrame:
    """(pair, i, j, cid, component, n): lists with members of several components, in chunks that must meet.

    A list of LIST members or fewer is a block.  In a longer one the members of its commonest
    component are apart from the others: chunks of others meet each other, and each chunk of the
    component; chunks of the component do not meet.
    """
    named = lists.join(joined.withColumnRenamed("node", "cid"), "cid", "left").join(members.select("cid", "n"), "cid").select("pair", "cid", "n", F.coalesce("component", "cid").alias("component"))
    counts = named.groupBy("pair", "component").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    open_ = counts.groupBy("pair").agg(F.sum("m").alias("all"), F.sum("size").alias("size"), F.count("*").alias("parts"), F.max(F.struct("m", "component", "size")).alias("most")).filter("parts > 1 and all > 2")
    small = (F.col("all") <= LIST) & (F.col("size") <= SHINGLES)

    def chunks(m: Column, size: Column) -> Column:
        return F.greatest(F.ceil(m / LIST), F.ceil(size / SHINGLES))

    own = F.when(small, 0).otherwise(chunks(F.col("most.m"), F.col("most.size")))
    rest = F.when(small, 1).otherwise(chunks(F.col("all") - F.col("most.m"), F.col("size") - F.col("most.size")))
    sizes = open_.select("pair", F.col("most.component").alias("largest"), own.cast("long").alias("own"), rest.cast("long").alias("rest"))
    placed = named.join(sizes, "pair").withColumn("inner", (F.col("own") > 0) & (F.col("component") == F.col("largest")))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("cid", "pair"), F.when(F.col("inner"), F.col("own")).otherwise(F.col("rest"))))

    def block(i: Column, j: Column) -> Column:
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))

    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    c = F.col("chunk")
    meets = F.transform(upto("rest"), lambda k: block(F.least(c, k), F.greatest(c, k)))
    inner = F.transform(upto("rest"), lambda k: block(k, -1 - c))
    outer = F.transform(upto("own"), lambda k: block(c, -1 - k))
    blocks = placed.select("pair", "cid", "component", "n", F.explode(F.when(F.col("inner"), inner).otherwise(F.concat(meets, outer))).alias("block"))
    return blocks.select("pair", "block.i", "block.j", "cid", "component", "n")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similar: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    ``similar`` is the least similarity in percent.  The component is its smallest key.  A null or
    wordless text has no shingles and is linked with nothing; equal texts, repeated rows and texts with
    the same key share a component.  Rows with a null key get a null component and are not kept.
    Texts of any length are taken whole.  ``key`` must be a whole number; other columns are ignored; an
    empty table gives no rows.  The result is written, and goes with the caller's ``scratch`` where one is given.
    """
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    keep = scratch
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.written(rows.mapInArrow(by_slices(_sign(width)), schema), "signed")
        usable = signed.filter("set_key is not null and doc is not null")
        # written, so that numbers stay and a class of many copies can be split in the joins with it
        classes = scratch.written(usable.groupBy("set_key").agg(F.min("doc").alias("doc")).withColumn("cid", F.monotonically_increasing_id()), "classes")

        # posting lists over the rarest pairs of each class; a class meets one row, by digest and key
        posted = usable.join(classes, ["set_key", "doc"]).select("cid", F.explode("pairs").alias("pair"))
        often = posted.groupBy("pair").agg(F.count("*").alias("often")).filter("often > 1")
        rarest, whole = Window.partitionBy("cid").orderBy("often", "pair"), Window.partitionBy("cid")
        shared = posted.join(often, "pair").withColumn("place", F.row_number().over(rarest)).withColumn("of", F.count("*").over(whole)).withColumn("weight", F.sum("often").over(whole))
        lists = scratch.written(shared.filter(F.col("place") <= F.col("of") - (AGREE - 1)).select("cid", "pair", "often", "weight").distinct(), "lists")

        # the sets of the posted classes are made anew from their texts: only they travel
        wanted = scratch.written(lists.select("cid").distinct().join(classes, "cid"), "wanted")
        parts = [rows.transform(f).join(F.broadcast(wanted.transform(f)), "doc") for f in lookups(wanted, F.col("doc"))]
        texts = functools.reduce(DataFrame.unionByName, parts) if parts else rows.join(wanted, "doc")
        texts = texts.select("cid", "text", "set_key")
        sets = texts.mapInArrow(by_slices(_sets(width)), "cid long, n long, pairs array<long>, shingles binary")
        prefixes = lists.groupBy("cid").agg(F.array_sort(F.collect_set("pair")).alias("prefix"))
        members = scratch.written(sets.dropDuplicates(["cid"]).join(prefixes, "cid"), "members")

        first = scratch.written(_confirmed(_beside(lists), members, similar), "first")
        joined = components(first, scratch=scratch)
        blocks = scratch.written(_blocks(lists, joined, members), "blocks")
        light = blocks.join(members.select("cid", "pairs", "prefix"), "cid").groupBy("pair", "i", "j").agg(F.collect_list(F.struct("cid", "component", "n", "pairs", "prefix")).alias("members"))
        needed = light.mapInArrow(by_slices(_needed(similar), 64), "pair long, i long, j long, cid long")
        full = blocks.join(needed, ["pair", "i", "j", "cid"]).join(members.drop("n"), "cid").groupBy("pair", "i", "j").agg(F.collect_list(F.struct("cid", "component", "n", "pairs", "prefix", "shingles")).alias("members"))
        second = scratch.written(full.select("pair", "members").mapInArrow(by_slices(_link(similar), 16), "a long, b long"), "second")

        # the classes of a key that has several sets
        several = usable.groupBy("doc").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low <> high").select("doc")
        of = usable.join(several, "doc").select("doc", "set_key").distinct().join(classes.select("set_key", "cid"), "set_key").select("doc", "cid")
        tied = of.join(of.groupBy("doc").agg(F.min("cid").alias("b")), "doc").filter("cid <> b").select(F.col("cid").alias("a"), "b")
        found = components(first.unionByName(second).unionByName(tied), scratch=scratch)

        grouped = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("set_key", "doc", F.coalesce("component", "cid").alias("grp"))
        smallest = grouped.groupBy("grp").agg(F.min("doc").alias("smallest"))
        named = scratch.written(grouped.join(smallest, "grp").select("set_key", "smallest"), "named")
        component = F.when(F.col("doc").isNotNull(), F.coalesce("smallest", "doc"))
        out = signed.join(named, "set_key", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))
        return keep.written(out, "near") if keep else written(out, "near")
