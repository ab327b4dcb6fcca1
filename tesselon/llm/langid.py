"""Language identification with error-correcting output codes.

Method: each language gets a codeword of plus and minus ones.  A binary classifier over hashed letter
n-grams (lengths 1 to 3 of the whole text, letters in lower case, everything else a blank) predicts
each bit.  Decoding takes the codeword of least loss, every bit's logistic loss weighted by how well
its classifier does on that language.  A prediction whose two best losses are close is flagged as
ambiguous.

Every label is learned.  The classifiers are fitted on the driver on at most ``per_language`` distinct
texts of each language, chosen by a hash of the text, and on ``SAMPLE`` in all or, with more labels than
that, on one of each; only their feature vectors, of fixed size, are collected.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tesselon.llm import pieces
from tesselon.llm.store import by_slices

DIMENSIONS = 4096
PER_LANGUAGE = 500
#: Texts of all labels together that the driver learns from, unless one of each are more.
SAMPLE = 12_000
#: Counts of labels, of about 50 bytes each, that are broadcast at most.
LOOKUP = 1 << 16
UNKNOWN = "und"
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit feature vectors, whether there is a letter) of whole texts."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    some = np.zeros(len(texts), bool)
    for part in pieces.chunks(texts):
        own = [texts[i].lower() for i in part]
        cp, offsets = pieces.code_points(own)
        if not len(cp):
            continue
        letter = pieces.classes(cp) == pieces.LETTER
        c = np.where(letter, cp, 32).astype(np.uint32)
        one = (c + np.uint32(7)) * _M[0]
        grams = [one]
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _M[1] + one[1:]
        grams.append(two)
        if len(c) > 2:
            grams.append((two[:-1] ^ (two[:-1] >> np.uint32(13))) * _M[2] + one[2:])
        bins = [((g ^ (g >> np.uint32(16))) * _M[1]) >> _SHIFT for g in grams]
        for k, i in enumerate(part):
            a, b = int(offsets[k]), int(offsets[k + 1])
            some[i] = letter[a:b].any()
            if some[i]:
                v = np.zeros(DIMENSIONS, np.float64)
                for n, g in enumerate(bins):
                    if b - n > a:
                        v += np.bincount(g[a : b - n], minlength=DIMENSIONS)
                v = np.sqrt(v)
                out[i] = v / np.linalg.norm(v)
    return out, some


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1: exhaustive up to seven classes, else the best of random codes.

    Beyond 256 classes fewer codes are tried, as what it takes to compare their words grows with the square.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = np.array([[1, *rest] for rest in itertools.product((1, -1), repeat=n - 1)][1:])
        return bits.T.astype(np.float64)
    rng = np.random.default_rng(seed)
    width = math.ceil(10 * math.log2(n))
    best, far = None, -1.0
    for _ in range(max(1, min(200, 200 * 256**2 // n**2))):
        c = rng.choice([-1.0, 1.0], (n, width))
        d = float(width)
        for at in range(0, n, 512):
            apart = (width - c[at : at + 512] @ c.T) / 2
            apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = width
            d = min(d, apart.min())
        if d > far and (np.abs(c.sum(0)) < n).all():
            best, far = c, d
    return best


class Model:
    """Codewords, bit classifiers and the weights of decoding."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, ambiguous_below: float):
        self.languages, self.code, self.weights, self.bias, self.trust, self.ambiguous_below = languages, code, weights, bias, trust, ambiguous_below

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        plus, minus = np.logaddexp(0, -margins), np.logaddexp(0, margins)
        return plus @ (self.trust * (self.code > 0)).T + minus @ (self.trust * (self.code < 0)).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        x, some = features([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        loss = self.losses(x.astype(np.float64))
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        gap = np.full(len(loss), np.inf)
        if loss.shape[1] > 1:
            two = np.partition(loss, 1, 1)
            gap = two[:, 1] - two[:, 0]
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        # rounded, as products of matrices of unlike sizes differ in their last digits
        score = np.where(some, p[np.arange(len(best)), best], 0.0).round(9)
        return names, score.tolist(), (~some | (gap < self.ambiguous_below)).tolist()


def train(x: np.ndarray, labels: list[str], steps: int = 80, ambiguous_below: float = 0.05) -> Model:
    languages = sorted(set(labels))
    number = {v: k for k, v in enumerate(languages)}
    ids = np.array([number[v] for v in labels], np.int64)
    share = np.bincount(ids, minlength=len(languages))
    code = codewords(len(languages))
    y = code[ids] if languages else np.zeros((0, 0))
    bits = code.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    x = x.astype(np.float32)
    y = y.astype(np.float32)
    # rows of rare languages weigh as much as those of common ones
    weight = (1 / (max(1, len(languages)) * share[ids])).astype(np.float32)[:, None]
    velocity = [np.zeros_like(w), np.zeros_like(b)]
    for _ in range(steps if bits else 0):
        pull = weight * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        for v, g, p in zip(velocity, (x.T @ pull - 1e-5 * w, pull.sum(0)), (w, b), strict=True):
            v *= 0.9
            v += 20 * g
            p += v
    trust = np.ones((len(languages), bits))
    if bits:
        trust[:] = 0
        np.add.at(trust, ids, (x @ w + b) * y > 0)
        trust = trust / share[:, None] + 1e-6
        trust *= bits / trust.sum(1, keepdims=True)
    return Model(languages, code, w.astype(np.float64), b.astype(np.float64), trust, ambiguous_below)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, some = features(batch.column(1).to_pylist())
        keep = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([x[i].astype("<f2").tobytes() for i in keep.tolist()], pa.binary())], names=["a", "b"])


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows where ``usable`` holds and text and language are there (a bounded sample).

    Of each label the distinct texts of smallest hash are taken, so that repeated rows count once and ids
    play no part.  A null, empty or letterless text teaches nothing; a label with no other texts is not
    learned.  Texts of any length count whole, other columns are ignored, and an empty table gives a model
    that knows no language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), usable.alias("usable")).filter("usable and lang is not null")
    rows = rows.filter(F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = [(r["lang"], max(1, r["n"])) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).collect()]
    if not counts:
        return train(np.zeros((0, DIMENSIONS), np.float32), [])
    per_language = max(1, min(per_language, SAMPLE // len(counts)))
    # about twice as many as are needed pass a threshold; the first of them by hash are taken
    shares = spark.createDataFrame([(v, min(1.0, 2.0 * max(16, per_language) / n)) for v, n in sorted(counts)], "lang string, share double")
    near = F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    passed = rows.join(F.broadcast(shares) if len(counts) <= LOOKUP else shares, "lang").filter(near)
    once = passed.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h")
    sample = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language).select("lang", "text")
    got = sorted((r[0], bytes(r[1])) for r in sample.mapInArrow(by_slices(_featurise), "lang string, x binary").collect())
    x = np.stack([np.frombuffer(v, "<f2").astype(np.float32) for _, v in got]) if got else np.zeros((0, DIMENSIONS), np.float32)
    return train(x, [v for v, _ in got])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0 and counts as ambiguous.  Equal
    texts get equal predictions, ties the first label; texts of any length count whole; repeated rows
    and null keys stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # 512 feature vectors at a time
                part = batch.slice(at, 512)
                names, score, doubt = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], names=list("abcd"))

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select(F.col(key), F.col(text)).mapInArrow(by_slices(run), schema)


def relabel(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that have no language, ``lang`` being the predicted one."""
    place, label = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, _, _ = model.predict(part.column(place).to_pylist())
                part = part.set_column(label, part.schema.field(label), pa.array(names, pa.string()).cast(part.schema.field(label).type))
                yield part.filter(pa.array([n != UNKNOWN for n in names]))

    return docs.mapInArrow(by_slices(run), docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
