"""Packing of tokenised documents into fixed windows by multiway differencing.

Method: whole windows' worth of a document's ids stand alone; what is left of each document goes
through Karmarkar-Karp multiway differencing in blocks.  Partial partitions are merged, the one with
the largest imbalance first, each largest part with the other's smallest, which gives near-equal
windows.  The count of windows starts at the least that could do and rises whenever a window exceeds
its capacity, until differencing gives none that does.  As documents may be cut freely, the emptiest
windows, as many as the room in all of them would hold, then fill the room in the others, so that less
than a window of a block stays open; its pieces join the next block.  A task's last open window is cut
into sequences whose lengths are powers of two, which need no padding.

No shuffle takes place: each task packs what it reads, and its memory is bounded by a block.
Sequence numbers hold the partition's number in their upper bits, so a task that is run again makes
the same rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tesselon.llm import pieces
from tesselon.llm.store import by_slices
from tesselon.llm.wordbpe import byte_symbols

WINDOW = 2048
#: Remainders that are differenced together.
BLOCK = 384
#: The byte-level vocabularies' pattern of pieces (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_rank(model: dict):
    """The same vocabulary for the library that merges by rank, which is faster for single pieces.

    None unless every merge makes the id that follows its predecessor's: then ids are ranks and both
    libraries merge alike.
    """
    vocab = model["vocab"]
    made = [vocab["".join(p) if isinstance(p, list) else p.replace(" ", "")] for p in model["merges"]]
    if made != list(range(256, 256 + len(made))) or sorted(vocab.values()) != list(range(256 + len(made))):
        return None
    byte = {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """Ids of whole texts by a byte-level vocabulary; each distinct piece is encoded once.

    The vocabulary is held once: the library that reads its file is loaded only for what needs it.
    Without ``special``, the strings of special tokens are text like any other.
    """

    def __init__(self, path: str, special: bool = True):
        self.path = path
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [x["content"] for x in data["added_tokens"]] if special else []
        self.ranks = _by_rank(data["model"])
        self.memo = pieces.Memo(self._learn, self._forget)
        self._forget()

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n, self.used = 0, 0

    def _learn(self, words: list[str]) -> range:
        if self.ranks is not None:
            # pieces are not split again: the library's pattern cannot take a million blanks
            got = [self.ranks._encode_single_piece(w) for w in words]
        else:
            got = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32)
        count = np.fromiter(map(len, got), np.int64, len(got))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(words) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.n + 1 : self.n + len(words) + 1] = self.used + np.cumsum(count)
        first = self.n
        self.n += len(words)
        self.used += len(ids)
        return range(first, self.n)

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more at the end)."""
        codes, begin = self.memo.codes(texts, spaces=True)
        first = self.at[codes]
        size = self.at[codes + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends[begin]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for part in pieces.chunks(texts):
            own = [texts[i] for i in part]
            odd = {k for k, t in enumerate(own) if any(s in t for s in self.special)}
            ids, cuts = self.joined(["" if k in odd else t for k, t in enumerate(own)])
            cuts = cuts.tolist()
            for k, t in enumerate(own):
                if k in odd:  # holds a special token: the library's own path
                    yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[cuts[k] : cuts[k + 1]]


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of ``windows`` near-equal windows.

    A state is the windows' sums in descending order with their contents; contents are kept as pairs
    and flattened at the end.
    """
    heap = []
    for i, x in enumerate(lengths):
        sums = np.zeros(windows, np.int64)
        sums[0] = x
        heap.append((-x if windows > 1 else 0, i, sums, [i] + [None] * (windows - 1)))
    heapq.heapify(heap)
    n = len(lengths)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        joined = [y if x is None else x if y is None else (x, y) for x, y in zip(own, reversed(other), strict=True)]
        n += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n, sums, [joined[k] for k in order.tolist()]))
    out = []
    for content in heap[0][3] if heap else [None] * windows:
        items, stack = [], [content]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                items.append(x)
        out.append(sorted(items))
    return out


def fill(items: list[tuple[int, int, int]], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows and what stays open, of items (document, start, length) below the capacity."""
    total = sum(x[2] for x in items)
    lengths = [x[2] for x in items]
    windows = max(1, -(-total // capacity))
    while True:
        groups = [[items[i] for i in g] for g in difference(lengths, windows)]
        sums = [sum(x[2] for x in g) for g in groups]
        over = sum(max(0, x - capacity) for x in sums)
        if not over:
            break
        windows += max(1, over // capacity)  # a window at least, and what is above capacity needs as many
    order = sorted(range(windows), key=lambda k: (-sums[k], k))
    kept = order[: total // capacity]
    spare = [x for k in order[len(kept) :] for x in groups[k]]
    full = []
    for k in kept:
        g = groups[k]
        while sums[k] < capacity:
            d, s, n = spare.pop()
            room = capacity - sums[k]
            take = min(n, room)
            g.append((d, s, take))
            if take < n:
                spare.append((d, s + take, n - take))
            sums[k] += take
        full.append(g)
    return full, spare


def powers_of_two(items: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences with power-of-two lengths, the longest first."""
    left, out = list(items), []
    total = sum(x[2] for x in items)
    while total:
        room, now = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            d, s, n = left.pop(0)
            take = min(n, room)
            now.append((d, s, take))
            if take < n:
                left.insert(0, (d, s + take, n - take))
            room -= take
        out.append(now)
    return out


def _schema(key: str, kind: T.DataType) -> T.StructType:
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in names)])


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, end_id: int = 1) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty; an empty text is the one id ``end_id``.  Every row of ``docs`` is
    packed, repeated keys and texts too; texts of any length are cut into whole windows; other columns
    are ignored.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        ids: dict[int, tuple] = {}  # document in work -> (key, ids of its remainder, where it starts, all its ids' count)
        items: list[tuple[int, int, int]] = []
        rows: list[tuple] = []
        number, kind = 0, None

        def place(groups) -> None:
            nonlocal sequence
            for g in groups:
                at = 0
                for d, s, n in g:
                    k, own, base, count = ids[d]
                    rows.append((k, s, n, zlib.crc32(own[s - base : s - base + n].tobytes()), count, sequence, at))
                    at += n
                sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[pa.int64()] * 6], strict=True)], names=list("abcdefg"))

        for batch in batches:
            kind = batch.column(0).type
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for k, own in zip(batch.column(0).to_pylist(), e.encode(texts), strict=True):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                count = len(own)
                whole = count // window * window
                for s in range(0, whole, window):
                    rows.append((k, s, window, zlib.crc32(own[s : s + window].tobytes()), count, sequence, 0))
                    sequence += 1
                if count > whole:
                    ids[number] = (k, own[whole:], whole, count)
                    items.append((number, whole, count - whole))
                    number += 1
                if len(items) >= block:
                    full, items = fill(items, window)
                    place(full)
                    ids = {d: ids[d] for d in {x[0] for x in items}}
                if len(rows) >= 20_000:
                    yield flush()
        if items:
            full, items = fill(items, window)
            place([*full, *powers_of_two(items)])
        if rows:
            yield flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(by_slices(run), _schema(key, docs.schema[key].dataType))
