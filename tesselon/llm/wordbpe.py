"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Method: one pass counts the corpus's words; the frequent ones are merged once and compiled into a
minimal acyclic transducer, an automaton that shares prefixes and suffixes and whose arcs carry
outputs that add up to a word's number, under which its ids are stored.  The file lies in the shared
folder and is memory-mapped.  Words that the transducer does not know are merged exactly there.
The lexicon therefore only saves time: any lexicon gives the same ids.

Handles the ``tokenizers`` model kind of the vocabulary file ``word_bpe_49k.json``: NFC, white space,
lower case, words, single number characters, byte symbols and a suffix at word ends.  Texts are
processed whole.  A null or empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from tesselon.llm import pieces, store
from tesselon.llm.store import by_slices

_LABEL_BITS = 21
_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NEVER = 1 << 62
#: Words of more bytes are merged by a heap.
_LONG = 256


# ---------------------------------------------------------------- transducer


class Transducer:
    """Sorted word list -> minimal acyclic automaton; a word's outputs sum to its place in the list."""

    def __init__(self, arc_key, arc_to, arc_out, final, value_at, values):
        self.arc_key, self.arc_to, self.arc_out = arc_key, arc_to, arc_out
        self.final, self.value_at, self.values = final, value_at, values

    @classmethod
    def build(cls, words: list[str], ids: list[list[int]]) -> Transducer:
        """``words`` must be strictly ascending by code points."""
        register: dict[tuple, int] = {}
        arcs: list[list[tuple[int, int]]] = []
        final: list[bool] = []
        count: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            got = register.get(key)
            if got is None:
                got = register[key] = len(arcs)
                arcs.append(node[1])
                final.append(node[0])
                count.append(int(node[0]) + sum(count[t] for _, t in node[1]))
            return got

        path: list[list] = [[False, []]]
        last = ""
        for w in words:
            common = len(os.path.commonprefix([last, w]))
            while len(path) > common + 1:
                done = freeze(path.pop())
                path[-1][1].append((ord(last[len(path) - 1]), done))
            path += [[False, []] for _ in range(len(w) - common)]
            path[-1][0] = True
            last = w
        while len(path) > 1:
            done = freeze(path.pop())
            path[-1][1].append((ord(last[len(path) - 1]), done))
        root = freeze(path.pop())
        # the root is renumbered 0 so that a walk can begin there
        number = {root: 0}
        for s in range(len(arcs)):
            if s != root:
                number[s] = len(number)
        rows = []
        for s, own in enumerate(arcs):
            out = int(final[s])
            for label, to in own:
                rows.append(((number[s] << _LABEL_BITS) | label, number[to], out))
                out += count[to]
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 3)
        f = np.zeros(len(arcs), np.int64)
        for s, x in enumerate(final):
            f[number[s]] = x
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
        flat = np.array([i for x in ids for i in x], np.int64)
        return cls(a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy(), f, at, flat)

    def packed(self) -> bytes:
        """The bytes that ``map`` reads."""
        parts = [self.arc_key, self.arc_to, self.arc_out, self.final, self.value_at, self.values]
        return b"".join(p.astype("<i8").tobytes() for p in [np.array([len(p) for p in parts]), *parts])

    @classmethod
    def map(cls, uri: str) -> Transducer:
        """Mapped into memory where the shared folder is mounted, else read once."""
        fs, path = store.filesystem(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            everything = np.memmap(path, "<i8", "r")
        else:
            with fs.open_input_file(path) as f:
                everything = np.frombuffer(f.read(), "<i8")
        sizes = everything[:6]
        ends = np.cumsum(sizes) + 6
        return cls(*(everything[e - s : e] for s, e in zip(sizes, ends, strict=True)))

    def find(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, -1 where unknown; all words walk the automaton together."""
        cp, offsets = pieces.code_points(words)
        length = np.diff(offsets)
        state = np.zeros(len(words), np.int64)
        out = np.zeros(len(words), np.int64)
        live = np.flatnonzero(length > 0) if len(self.arc_key) else np.zeros(0, np.int64)
        state[length == 0] = -1
        if not len(self.arc_key):
            state[:] = -1
        step = 0
        while len(live):
            key = (state[live] << _LABEL_BITS) | cp[offsets[live] + step].astype(np.int64)
            at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[at] == key
            state[live] = np.where(hit, self.arc_to[at], -1)
            out[live] += np.where(hit, self.arc_out[at], 0)
            step += 1
            live = live[hit & (length[live] > step)]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, out, -1)

    def ids(self, number: int) -> list[int]:
        return self.values[self.value_at[number] : self.value_at[number + 1]].tolist()


# ---------------------------------------------------------------- exact merging


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.token = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = s
        v = self.vocab
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[(v[a], v[b])] = rank << _ID_BITS | v[a + b]
        symbols = byte_symbols()
        self.inner = [v[s] for s in symbols]
        self.last = [v[s + self.suffix] for s in symbols]

    def merge(self, word: str) -> list[int]:
        """The ids of one lower-cased word: the pair of least rank is merged, leftmost first."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, get = self.inner, self.merges.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > _LONG:
            return self._merge_long(ids)
        # a pair's entry is its rank, shifted, with the id it makes
        pairs = [get(p, _NEVER) for p in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) != _NEVER:
            at = pairs.index(best)
            ids[at : at + 2] = [best & _ID_MASK]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), _NEVER)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap over linked symbols, for words of any length."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [get(p, _NEVER) for p in zip(ids, ids[1:], strict=False)]
        heap = [(p >> _ID_BITS) << 40 | i for i, p in enumerate(pairs) if p != _NEVER]
        heapq.heapify(heap)
        pairs.append(_NEVER)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << 40) - 1)
            p = pairs[i]
            if p >> _ID_BITS != entry >> 40:  # no longer this pair
                continue
            ids[i] = p & _ID_MASK
            j = after[i]
            pairs[j] = _NEVER
            ids[j] = -1
            k = after[i] = after[j]
            pairs[i] = get((ids[i], ids[k]), _NEVER) if k < n else _NEVER
            if k < n:
                before[k] = i
                if pairs[i] != _NEVER:
                    heapq.heappush(heap, (pairs[i] >> _ID_BITS) << 40 | i)
            h = before[i]
            if h >= 0:
                pairs[h] = get((ids[h], ids[i]), _NEVER)
                if pairs[h] != _NEVER:
                    heapq.heappush(heap, (pairs[h] >> _ID_BITS) << 40 | h)
        return [x for x in ids if x >= 0]


#: Characters met that Python's tables know.
_known: set[str] = set()


def newer(text: str) -> bool:
    """Whether ``text`` has a character that Python's tables do not know."""
    fresh = set(text) - _known
    if any(unicodedata.category(c) == "Cn" for c in fresh):
        return True
    _known.update(fresh)
    return False


@functools.cache
def _library() -> Callable[[str], str]:
    """The library's own NFC and lower case."""
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def normalised(text: str) -> str:
    """NFC, then lower case character by character (no context rule for the final sigma).

    What was assigned keeps its forms in later versions of Unicode, so only a text with a character that
    Python does not know needs the library's tables, which may be newer.
    """
    if text.isascii():
        return text.lower()
    if newer(text):
        return _library()(text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Encodes and decodes whole texts with a mapped lexicon and exact merging."""

    def __init__(self, vocabulary: str, lexicon: str | None = None):
        self.v = Vocabulary(vocabulary)
        self.lexicon = Transducer.map(lexicon) if lexicon else None
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.v.special, key=len, reverse=True))) if self.v.special else None
        self.memo = pieces.Memo(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.id_bytes: list[bytes] = []
        self.decoded: list[str] = []
        self.special_code: dict[str, int] = {}

    def _add(self, ids: list[int]) -> int:
        self.id_bytes.append(struct.pack(f"<{len(ids)}I", *ids))
        token = self.v.token
        self.decoded.append(" ".join([token[i] for i in ids]))
        return len(self.id_bytes) - 1

    def _learn(self, words: list[str]) -> list[int]:
        found = self.lexicon.find(words).tolist() if self.lexicon else [-1] * len(words)
        return [self._add(self.lexicon.ids(k) if k >= 0 else self.v.merge(w)) for w, k in zip(words, found, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        for part in pieces.chunks(texts):
            own = [texts[i] for i in part]
            segments, owner, fixed = [], [], []
            for k, t in enumerate(own):
                if self.special and "<" in t and self.special.search(t):
                    at = 0
                    for m in self.special.finditer(t):
                        segments += [t[at : m.start()], ""]
                        fixed += [None, m.group()]
                        owner += [k, k]
                        at = m.end()
                    t = t[at:]
                segments.append(t)
                fixed.append(None)
                owner.append(k)
            codes, begin = self.memo.codes([normalised(s) for s in segments], spaces=False)
            codes, begin = codes.tolist(), begin.tolist()
            per_text: list[list[int]] = [[] for _ in own]
            for s, k in enumerate(owner):
                if fixed[s] is not None:
                    if fixed[s] not in self.special_code:
                        self.special_code[fixed[s]] = self._add([self.v.special[fixed[s]]])
                    per_text[k].append(self.special_code[fixed[s]])
                else:
                    got = codes[begin[s] : begin[s + 1]]
                    per_text[k] = got if not per_text[k] else per_text[k] + got
            ib, de = self.id_bytes, self.decoded
            for c in per_text:
                yield b"".join([ib[x] for x in c]), " ".join([de[x] for x in c])


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, lexicon: str | None) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    key = (vocabulary, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, lexicon)
    return _encoders[key]


# ---------------------------------------------------------------- lexicon


def _count_words(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []

        def learn(new: list[str]) -> range:
            words.extend(new)
            return range(len(words) - len(new), len(words))

        counts, total = np.zeros(0, np.int64), 0

        def flush(memo):
            nonlocal counts, total
            keep = np.flatnonzero(counts >= max(2, total * share)).tolist()
            rows = pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in keep], pa.string()), "n": pa.array(counts[keep], pa.int64())})
            words.clear()
            memo.clear()
            counts, total = np.zeros(0, np.int64), 0
            return rows

        memo = pieces.Memo(learn, lambda: None, 1 << 60, 1 << 60)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for part in pieces.chunks(texts):
                codes, _ = memo.codes([normalised(texts[i]) for i in part], spaces=False)
                total += len(codes)
                got = np.bincount(codes, minlength=len(words))
                got[: len(counts)] += counts
                counts = got
                if len(words) > 400_000 or memo.held > 1 << 24:
                    yield flush(memo)
        yield flush(memo)

    return run


def frequent_words(docs: DataFrame, size: int = 1 << 15, text: str = "text") -> DataFrame:
    """(word, n) of the ``size`` most frequent words, by lossy counting over all texts.

    A task passes on words that make up at least ``1 / (8 * size)`` of the words it has seen, so that
    what is shuffled stays bounded for each task.
    """
    counted = docs.select(text).mapInArrow(by_slices(_count_words(1 / (8 * size))), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = 1 << 15, text: str = "text") -> str:
    """Compile the transducer on the driver (``size`` words at most); returns its file's place.

    The file lies in the shared folder, from which executors map it into memory.
    """
    words = sorted(r.word for r in frequent_words(docs, size, text).collect())
    v = Vocabulary(vocabulary)
    t = Transducer.build(words, [v.merge(w) for w in words])
    spark = docs.sparkSession
    uri = f"{store.shared_root(spark)}/lexicon-{uuid.uuid4().hex}.bin"
    fs, path = store.filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(t.packed())
    return uri


# ---------------------------------------------------------------- operator


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(key, n_tokens, ids, decoded) of every row; with ``digests`` the SHA-256 of both instead.

    Any columns other than ``key`` and ``text`` are ignored, so clashing names do no harm; repeated
    keys give repeated rows; an empty table gives an empty one.  Texts of any length are taken whole, and a
    word of n bytes is merged in time n log n.  Of pairs of the same rank the leftmost is merged first.
    """
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, lexicon)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, ids, decoded = [], [], []
            for a, b in e.encode(texts):
                n.append(len(a) // 4)
                ids.append(hashlib.sha256(a).hexdigest() if digests else a)
                decoded.append(hashlib.sha256(b.encode()).hexdigest() if digests else b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.binary()), pa.array(decoded, pa.string())], names=["k", "n", "i", "d"])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    schema = T.StructType([T.StructField(key, key_type), T.StructField("n_tokens", T.LongType()), T.StructField(names[0], T.StringType() if digests else T.BinaryType()), T.StructField(names[1], T.StringType())])
    return docs.select(F.col(key), F.col(text)).mapInArrow(by_slices(run), schema)


def encode_all(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """:func:`encode` with a lexicon of the texts' own frequent words, which goes when the rows are written."""
    lexicon = build_lexicon(docs, vocabulary, text=text)
    try:
        return store.written(encode(docs, vocabulary, lexicon, key, text, digests), "encoded")
    finally:
        store.delete(docs.sparkSession, lexicon)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the tokens of the id bytes, joined by blanks (null ids: null)."""

    @F.pandas_udf(T.StringType())
    def join(column: pd.Series) -> pd.Series:
        token = encoder(vocabulary, None).v.token
        return column.map(lambda b: None if b is None else " ".join([token[i] for i in np.frombuffer(b, "<u4").tolist()]))

    return rows.withColumn(out, join(F.col(ids)))
