"""Alignment of two tokenizers by products of sparse token-byte incidence matrices.

Method.  Both tokenizers cut the same bytes.  Each one's tokens are the rows of an incidence matrix
whose columns are the bytes, in compressed rows (CSR) built here.  The product A Bt, made row by row
after Gustavson, has an entry for every pair of tokens that overlap, namely the bytes they share.  The
offsets where tokens of both end cut the bytes into groups, and the product of the token-group
incidences has an entry for every pair of tokens of one group.

Texts are encoded once, into a table of ids.  The counts of id pairs, in documents, are summed in tasks
before they are shuffled.  The commonest pairs, ``HOT`` at most, are broadcast, and what a document
holds of them is added up where its ids are read; its other pairs meet their counts in a join.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tesselon.llm import pieces
from tesselon.llm.packing import ByteEncoder
from tesselon.llm.store import Scratch, by_slices, written
from tesselon.llm.wordbpe import byte_symbols

#: Id pairs that are broadcast at most, of 17 bytes each.
HOT = 1 << 20
#: Entries of a product that are made at once; distinct stretches that are kept with their ids.
ENTRIES, STRETCHES = 1 << 16, 200_000
#: The second vocabulary's mark of a blank (fixed value).
MARK = "▁"


# ---------------------------------------------------------------- sparse matrices


class Csr:
    """A sparse matrix in compressed rows: row i has the columns and values of places start[i] to start[i + 1]."""

    def __init__(self, start: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int):
        self.start, self.column, self.value, self.columns = start, column, value, columns

    @classmethod
    def ranges(cls, first: np.ndarray, end: np.ndarray, columns: int) -> Csr:
        """Row i has ones from ``first[i]`` to ``end[i]``."""
        size = end - first
        start = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=start[1:])
        column = np.arange(start[-1], dtype=np.int32) + np.repeat((first - start[:-1]).astype(np.int32), size)
        return cls(start, column, np.ones(len(column), np.int32), columns)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))

    def transposed(self) -> Csr:
        rows, value = self.rows(), self.value
        if (self.column[1:] < self.column[:-1]).any():
            order = np.argsort(self.column, kind="stable")
            rows, value = rows[order], value[order]
        start = np.zeros(self.columns + 1, np.int32)
        np.cumsum(np.bincount(self.column, minlength=self.columns), out=start[1:])
        return Csr(start, rows, value, len(self.start) - 1)

    def reach(self, other: Csr) -> np.ndarray:
        """How many entries each row of ``self @ other`` is the sum of."""
        ends = np.concatenate([[0], np.cumsum(np.diff(other.start)[self.column])])
        return ends[self.start[1:]] - ends[self.start[:-1]]

    def __matmul__(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of the rows of ``other`` that row i names, times its values."""
        at, row, value = other.start[self.column], self.rows(), self.value
        size = other.start[self.column + 1] - at
        if (size != 1).any():
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)
            row, value = np.repeat(row, size), np.repeat(value, size)
        column, value = other.column[at], other.value[at] * value
        again = row[1:] == row[:-1]
        if (again & (column[1:] < column[:-1])).any():
            order = np.lexsort((column, row))
            row, column, value = row[order], column[order], value[order]
            again = row[1:] == row[:-1]
        new = np.flatnonzero(np.concatenate([[len(row) > 0], ~(again & (column[1:] == column[:-1]))])) if len(row) else np.zeros(0, np.int64)
        row, column = row[new], column[new]
        start = np.searchsorted(row, np.arange(len(self.start)))
        return Csr(start, column, np.add.reduceat(value, new) if len(new) else value, other.columns)


def _blocks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ENTRIES at most, or of one row."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
        yield at, to
        at = to


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared bytes) of the overlapping tokens that end at these offsets, in blocks of A's rows."""
    a_first, b_first = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    for r, s in _blocks(a_end - a_first):
        low, high = int(a_first[r]), int(a_end[s - 1])
        p, q = int(np.searchsorted(b_end, low, "right")), int(np.searchsorted(b_first, high, "left"))
        a = Csr.ranges(a_first[r:s] - low, a_end[r:s] - low, high - low)
        b = Csr.ranges(np.maximum(b_first[p:q] - low, 0), np.minimum(b_end[p:q], high) - low, high - low)
        c = a @ b.transposed()
        yield c.rows().astype(np.int64) + r, c.column.astype(np.int64) + p, c.value


def _grouped(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, Csr, Csr]:
    """Offsets where groups end, and the token-group incidences of both."""
    both = np.minimum(np.searchsorted(b_end, a_end), max(0, len(b_end) - 1))
    ends = a_end[b_end[both] == a_end] if len(b_end) else b_end
    a, b = (np.searchsorted(ends, x) for x in (a_end, b_end))
    return ends, Csr.ranges(a, a + 1, len(ends)), Csr.ranges(b, b + 1, len(ends))


def shared_groups(a_end: np.ndarray, b_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the tokens that lie in one group, in blocks of A's rows."""
    _, a, b = _grouped(a_end, b_end)
    b = b.transposed()
    for r, s in _blocks(a.reach(b)):
        c = Csr(a.start[r : s + 1] - a.start[r], a.column[a.start[r] : a.start[s]], a.value[a.start[r] : a.start[s]], a.columns) @ b
        yield c.rows().astype(np.int64) + r, c.column.astype(np.int64)


# ---------------------------------------------------------------- tokenizers


class Table:
    """The bytes of every id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[ids] - ends + size, size)]


class Grown:
    """An array of whole numbers that grows at its end."""

    def __init__(self):
        self.data, self.n = np.zeros(1 << 12, np.int64), 0

    @property
    def now(self) -> np.ndarray:
        return self.data[: self.n]

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Tokenizers:
    """Both tokenizers, and the bytes of their ids; each distinct stretch of texts is encoded once.

    A stretch begins with a blank that follows something else than white space, or with the text.
    Neither tokenizer joins anything across its beginning: the first by its pattern, the second if no
    entry of its vocabulary joins a blank to what stands before it, which is looked up.
    """

    def __init__(self, a: str, b: str, limit: int = STRETCHES):
        import sentencepiece

        self.a, self.b = ByteEncoder(a, special=False), sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {s: k for k, s in enumerate(byte_symbols())}
        entries = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            entries[i] = bytes(byte[c] for c in s if c in byte)  # special tokens are no bytes, and no text gives them
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_table = Table(entries)
        self.b_table = Table([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(named)])
        self.blank = self.b.piece_to_id(MARK)
        self.apart = not self.b.is_unknown(self.blank) and not any(y == MARK != x for s in named for x, y in zip(s, s[1:], strict=False))
        #: how ids are stored
        self.kinds = tuple("<u2" if len(t.size) <= 1 << 16 else "<u4" for t in (self.a_table, self.b_table))
        self.memo = pieces.Memo(self._learn, self._forget, limit, 1 << 24, cut=self.cut)
        self._forget()

    def cut(self, cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the stretches."""
        starts = np.zeros(len(cp), bool)
        starts[offsets[:-1][offsets[:-1] < len(cp)]] = True
        if self.apart and len(cp):
            starts[1:] |= (cp[1:] == 32) & (pieces.classes(cp)[:-1] != pieces.SPACE)
        first = np.flatnonzero(starts)
        return first, np.append(first[1:], len(cp))

    def _forget(self) -> None:
        self.flat, self.at = (Grown(), Grown()), (Grown(), Grown())
        self.good = Grown()
        for x in self.at:
            x.add(np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> range:
        first, n = self.good.n, len(words)
        a, a_begin = self.a.joined(words)
        # the second library adds the leading blank itself, but to nothing
        got = [x if len(w) > 1 else [self.blank] for w, x in zip(words, self.b.encode([w[1:] for w in words], num_threads=1), strict=True)]
        b_begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, n))])
        b = np.fromiter(itertools.chain.from_iterable(got), np.int64, int(b_begin[-1]))
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, n))])
        whole = np.frombuffer(b"".join(raw), np.uint8)
        good = np.ones(n, np.int64)
        for table, ids, begin in ((self.a_table, a, a_begin), (self.b_table, b, b_begin)):
            back, at = table.join(ids), np.concatenate([[0], np.cumsum(table.size[ids])])[begin]
            if not (np.array_equal(at, ends) and np.array_equal(back, whole)):
                good &= np.fromiter((back[i:j].tobytes() == r for i, j, r in zip(at, at[1:], raw, strict=False)), np.int64, n)
        for side, (ids, begin) in enumerate(((a, a_begin), (b, b_begin))):
            self.at[side].add(self.flat[side].n + begin[1:])
            self.flat[side].add(ids)
        self.good.add(good)
        return range(first, first + n)

    @functools.cached_property
    def decimals(self) -> Table:
        """Every id in decimal, with a comma."""
        return Table([f"{i},".encode() for i in range(max(len(self.a_table.size), len(self.b_table.size)))])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a blank and each text by both; none where the text is empty or its bytes do not come back."""
        none = np.zeros(0, np.int64)
        for part in pieces.chunks(texts):
            codes, begin = self.memo.codes([" " + texts[i] if texts[i] and MARK not in texts[i] else "" for i in part], spaces=True)
            bad = np.concatenate([[0], np.cumsum(1 - self.good.now[codes])])[begin].tolist()
            sides = []
            for flat, at in zip(self.flat, self.at, strict=True):
                first = at.now[codes]
                size = at.now[codes + 1] - first
                ends = np.concatenate([[0], np.cumsum(size)])
                sides.append((flat.now[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends[begin].tolist()))
            (a, i), (b, j) = sides
            for k in range(len(part)):
                yield (a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]) if bad[k] == bad[k + 1] else (none, none)


class Aligned:
    """What the products say of several texts, whose ids stand one after the other."""

    def __init__(self, t: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.n = len(a)
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, self.n) for x in (a, b))
        self.a_end, self.b_end = np.cumsum(t.a_table.size[self.a]), np.cumsum(t.b_table.size[self.b])
        blocks = [(np.zeros(0, np.int64),) * 2, *((i, j) for i, j, _ in overlaps(self.a_end, self.b_end))]
        i, j = (np.concatenate(x) for x in zip(*blocks, strict=True))
        #: for each link: its text, and the number of its id pair among ``pairs``
        self.text = np.repeat(np.arange(self.n), self.n_a)[i]
        number, self.pairs = pd.factorize(self.a[i] << 32 | self.b[j])
        self.number = number.astype(np.int64)

    def held(self) -> np.ndarray:
        """How many texts hold each pair."""
        own = np.unique(self.text << 32 | self.number)
        return np.bincount(own & 0xFFFFFFFF, minlength=len(self.pairs))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sum of links' values for each text."""
        ends = np.searchsorted(self.text, np.arange(self.n + 1))
        return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

    def groups(self, decimals: Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(groups, token pairs that share one, the groups written out) of each text."""
        ends, ga, gb = _grouped(self.a_end, self.b_end)
        texts_end = np.concatenate([[0], self.a_end])[np.concatenate([[0], np.cumsum(self.n_a)])]
        n_groups = np.diff(np.searchsorted(ends, texts_end, "right"))
        shared = np.concatenate([[0], np.cumsum(ga.reach(gb.transposed()))])
        n_shared = np.diff(shared[np.concatenate([[0], np.cumsum(self.n_a)])])
        # A's and B's tokens, group by group; the last of a side and of a group end in other signs than commas
        a_last, b_last = (np.cumsum(np.bincount(g.column, minlength=len(ends))) for g in (ga, gb))
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[np.arange(len(self.a)) + np.concatenate([[0], b_last])[ga.column]] = self.a
        ids[np.arange(len(self.b)) + a_last[gb.column]] = self.b
        listed, after = decimals.join(ids), np.cumsum(decimals.size[ids])
        listed[after[a_last + np.concatenate([[0], b_last[:-1]]) - 1] - 1] = ord("|")
        listed[after[a_last + b_last - 1] - 1] = ord(";")
        whole = listed.tobytes()
        at = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return n_groups, n_shared, [whole[p : max(p, q - 1)] for p, q in zip(at, at[1:], strict=False)]


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    """One pair for each worker process, kept between tasks."""
    if (a, b) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[a, b] = Tokenizers(a, b)
    return _tokenizers[a, b]


# ---------------------------------------------------------------- operator


def encoded(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, a, b): every row's ids by both tokenizers as bytes; ``row`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = tokenizers(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [[x.astype(kind).tobytes() for x, kind in zip(both, t.kinds, strict=True)] for both in t.encode([x or "" for x in batch.column(1).to_pylist()])]
            sides = (pa.array([g[k] for g in got], pa.binary()) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(got))), batch.column(0), *sides], names=list("rkab"))
            row += len(got)

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return docs.select(F.col(key), F.col(text)).mapInArrow(by_slices(run), schema)


def _read(t: Tokenizers, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """A few rows (..., a, b) at a time, and what the products say of them."""
    sides = [[np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)] for k, kind in zip((-2, -1), t.kinds, strict=True)]
    size, at = [len(x) for x in sides[0]], 0
    while at < len(size):
        to, n = at + 1, size[at]
        while to < len(size) and n + size[to] <= ENTRIES:
            n += size[to]
            to += 1
        yield batch.slice(at, to - at), Aligned(t, sides[0][at:to], sides[1][at:to])
        at = to


def pair_counts(ids: DataFrame, a: str, b: str) -> DataFrame:
    """(pair, n): for each id pair that any row of :func:`encoded` holds linked, how many rows do.

    A pair is the id of A * 2^32 + the id of B.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, parts, size = tokenizers(a, b), [], 0
        for batch in batches:
            for _, got in _read(t, batch):
                parts.append((got.pairs, got.held()))
                size += len(got.pairs)
                if size > 1 << 20:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], names=["pair", "n"])
                        size = 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(parts)], names=["pair", "n"])

    return ids.select("a", "b").mapInArrow(by_slices(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, pairs = pd.factorize(np.concatenate([p for p, _ in parts]))
    out = np.zeros(len(pairs), np.int64)
    np.add.at(out, code, np.concatenate([n for _, n in parts]))
    return pairs, out


def ranked(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``counts`` with ``best``: whether the pair's count is the highest of its id of A."""
    counts = scratch.written(counts, "counts")
    own = F.shiftright("pair", 32)
    tops = counts.groupBy(own.alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A
    return scratch.written(counts.withColumn("a", own).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "ranked")


def commonest(pairs: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of the highest counts, ``most`` at most, ascending, with counts and marks."""
    step = F.floor(F.log("n") * 64).cast("int")
    sizes = sorted(((r.step, r["count"]) for r in pairs.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, 1 << 30
    for at, size in sizes:  # counts in steps of 1 / 64: a few hundred rows
        if total + size > most:
            break
        total, least = total + size, at
    got = pairs.filter(step >= least).orderBy("pair").toArrow()
    return tuple(got.column(c).to_numpy() for c in ("pair", "n", "best"))


def _looked_up(hot: tuple[np.ndarray, np.ndarray, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each pair is among the hot ones; its count and mark there, else zero."""
    key, count, best = hot
    if not len(key):
        return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    where = np.minimum(np.searchsorted(key, pairs), len(key) - 1)
    known = key[where] == pairs
    return known, np.where(known, count[where], 0), (known & best[where]).astype(np.int64)


def summary(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """For every row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared.

    ``n_shared`` counts the token pairs that share a group.  A text that is null or empty, or that a
    tokenizer does not give back byte for byte, has no tokens: zeros, and an empty digest.  Texts of any
    length are taken whole.  Repeated rows count as rows of their own, and so do repeated and null keys.
    Ties for the highest count are all best.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum")
    with Scratch(spark) as scratch:
        ids = scratch.written(encoded(docs, a, b, key, text), "encoded")
        pairs = ranked(pair_counts(ids, a, b), scratch)
        known = spark.sparkContext.broadcast(commonest(pairs, hot))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tokenizers(a, b)
            for batch in batches:
                for rows, got in _read(t, batch):
                    n_groups, n_shared, texts = got.groups(t.decimals)
                    found, count, best = _looked_up(known.value, got.pairs)
                    links = np.ones(len(got.number), np.int64)
                    table = [got.n_a, got.n_b, n_groups, got.per_text(links), n_shared, got.per_text(best[got.number]), got.per_text(count[got.number])]
                    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in texts]
                    cold = ~found[got.number]
                    own, times = np.unique(got.text[cold] << 32 | got.number[cold], return_counts=True)
                    ends = pa.array(np.searchsorted(own, np.arange(got.n + 1) << 32), pa.int32())
                    rest = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (got.pairs[own & 0xFFFFFFFF], times)]
                    columns = [*rows.columns[:2], *(pa.array(x) for x in table), pa.array(digests, pa.string()), *rest]
                    yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])

        schema = T.StructType([*ids.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType()), T.StructField("cold", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
        rows = scratch.written(ids.mapInArrow(by_slices(run), schema), "rows")
        rare = rows.select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("pair"), F.col("x.times").alias("times"))
        rest = rare.join(pairs, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        out = rows.drop("cold", "times").join(rest, "row", "left")

        def with_rest(name: str, more: str) -> Column:
            return (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)

        result = written(out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", with_rest("n_best", "more_best"), with_rest("count_sum", "more"), "groups_sha256", "n_shared"), "aligned")
        known.destroy()
        return result


def links(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every two tokens that share a group: key, a, b, a_id, b_id, n_bytes.

    ``a`` and ``b`` are the tokens' places; ``n_bytes`` is how much they overlap, zero where they only
    share a group.  The rules for texts are those of :func:`summary`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a, b)
        for batch in batches:
            for k, (a_ids, b_ids) in enumerate(t.encode([x or "" for x in batch.column(1).to_pylist()])):
                if not len(a_ids):
                    continue
                n_b, a_end, b_end = len(b_ids), np.cumsum(t.a_table.size[a_ids]), np.cumsum(t.b_table.size[b_ids])
                parts = [(i * n_b + j, n) for i, j, n in overlaps(a_end, b_end)]
                known, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                for i, j in shared_groups(a_end, b_end):
                    where = np.minimum(np.searchsorted(known, i * n_b + j), len(known) - 1)
                    n = np.where(known[where] == i * n_b + j, size[where], 0)
                    row = batch.column(0).take(pa.array(np.full(len(i), k)))
                    yield pa.RecordBatch.from_arrays([row, *(pa.array(x) for x in (i, j, a_ids[i], b_ids[j], n))], names=list("kabcdn"))

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("a", "b", "a_id", "b_id", "n_bytes"))])
    return docs.select(F.col(key), F.col(text)).mapInArrow(by_slices(run), schema)
