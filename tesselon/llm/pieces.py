"""Vectorised splitting of whole texts into the pieces that byte-pair vocabularies work on.

Many texts are handled as one array of code points: class changes mark the borders, and a prefix
polynomial gives every piece a 64-bit key, so that Python touches only distinct pieces.  A key only
gathers pieces that may be equal: their code points are compared before they count as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_UNKNOWN = 255
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Code points handled at once; bounds the memory of a batch.
CHUNK = 1 << 19

_powers: np.ndarray | None = None
_inverse: np.ndarray | None = None
_classes: np.ndarray | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if _powers is None or len(_powers) < n:
        size = max(n, CHUNK + (1 << 18)) + 1
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inv):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _powers, _inverse = out
    return _powers[:n], _inverse[:n]


def classes(cp: np.ndarray) -> np.ndarray:
    """Class of each code point, as the tokenizers library's own splitter sees it."""
    global _classes
    if _classes is None:
        _classes = np.full(0x110000, _UNKNOWN, np.uint8)
    got = _classes[cp]
    if (got == _UNKNOWN).any():
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.unique(cp[got == _UNKNOWN]).tolist():
            first = split("!" + chr(c) + "a")
            if first[0][1] == (0, 2):
                kind = OTHER
            elif first[1][1] == (1, 3) and chr(c) != " ":
                kind = LETTER
            else:
                kind = NUMBER if split(chr(c) + "1")[0][1] == (0, 2) and chr(c) != " " else SPACE
            _classes[c] = kind
        got = _classes[cp]
    return got


def chunks(texts: list[str]) -> list[list[int]]:
    """Consecutive positions of ``texts`` whose code points sum to about CHUNK."""
    out, now, size = [], [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > CHUNK:
            out.append(now)
            now, size = [], 0
        now.append(i)
        size += len(t)
    return [*out, now] if now else out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _contractions(cp: np.ndarray, starts: np.ndarray, at: np.ndarray, doc_start: np.ndarray) -> None:
    """'s 't 're 've 'm 'll 'd where the apostrophe begins its piece; ``starts`` is changed."""
    n = len(cp)
    for i in at.tolist():
        if i + 1 >= n or doc_start[i + 1]:
            continue
        a = cp[i + 1]
        if a in (115, 116, 109, 100):  # s t m d
            k = 2
        elif i + 2 < n and not doc_start[i + 2] and (a, cp[i + 2]) in ((114, 101), (118, 101), (108, 108)):
            k = 3
        else:
            continue
        starts[i + 1 : i + k] = False
        if i + k < n:
            starts[i + k] = True


def borders(cp: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each piece.

    ``spaces`` True: one blank joins the run after it, other white space forms pieces.  False: white
    space is dropped and each number character stands alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes(cp)
    doc_start = np.zeros(n + 1, bool)
    doc_start[offsets[:-1][offsets[:-1] < n]] = True
    doc_start[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change |= doc_start[:n]
    starts = change.copy()
    if spaces:
        after = np.flatnonzero(change[1:] & ~doc_start[1:n] & (cls[:-1] == SPACE)) + 1
        starts[after - 1] = True
        starts[after] = cp[after - 1] != 32
        quotes = np.flatnonzero((cp == 39) & starts)
    else:
        starts |= cls == NUMBER
        quotes = np.flatnonzero((cp == 39) & change)
    if len(quotes):
        _contractions(cp, starts, quotes, doc_start)
    first = np.flatnonzero(starts)
    end = np.append(first[1:], n)
    if not spaces:
        keep = cls[first] != SPACE
        first, end = first[keep], end[keep]
    return first, end


def keys(cp: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of pieces."""
    n = len(cp)
    powers, inverse = _tables(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * powers[:n], out=h[1:])
    k = (h[end] - h[first]) * inverse[first]
    k += (end - first).astype(np.uint64) * _MIX
    k ^= k >> np.uint64(32)
    k *= _MIX
    k ^= k >> np.uint64(29)
    return k


def distinct(cp: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each piece among the distinct pieces, and those."""
    text = cp.tobytes().decode("utf-32-le", "surrogatepass")
    code, keyed = pd.factorize(keys(cp, first, end))
    where = np.empty(len(keyed), np.int64)
    where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    size, model = end - first, where[code]
    same = bool((size == size[model]).all())
    if same:
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum()), dtype=np.int64)
        same = bool((cp[np.repeat(first - begin, size) + step] == cp[np.repeat(first[model] - begin, size) + step]).all())
    if not same:  # pieces that differ share a key
        code, words = pd.factorize(np.array([text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], object))
        return code, words.tolist()
    return code, [text[a:b] for a, b in zip(first[where].tolist(), end[where].tolist(), strict=True)]


class Memo:
    """Maps the pieces of many texts to numbers, calling ``learn`` once for each new piece.

    It holds at most ``limit`` pieces, and pieces of ``characters`` before the last batch, and then
    starts anew, which costs time but changes no result.

    ``cut`` gives the pieces (code points and texts' offsets in, first and end out) where they are not
    those of ``borders``.
    """

    def __init__(self, learn, forget, limit: int = 150_000, characters: int = 1 << 24, cut=None):
        self.learn, self.forget, self.limit, self.characters, self.cut = learn, forget, limit, characters, cut
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0

    def codes(self, texts: list[str], spaces: bool) -> tuple[np.ndarray, np.ndarray]:
        """A number for each piece, and where each text's pieces begin (one more at the end)."""
        cp, offsets = code_points(texts)
        first, end = self.cut(cp, offsets) if self.cut else borders(cp, offsets, spaces)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        code, words = distinct(cp, first, end)
        if len(self.known) + len(words) > self.limit or self.held > self.characters:
            self.clear()
            self.forget()
        known = self.known
        found = [known.get(w, -1) for w in words]
        fresh = [i for i, x in enumerate(found) if x < 0]
        if fresh:
            new = [words[i] for i in fresh]
            self.held += sum(map(len, new))
            number = self.learn(new)
            for i, x in zip(fresh, number, strict=True):
                found[i] = known[words[i]] = x
        return np.asarray(found, np.int64)[code], np.searchsorted(first, offsets)
