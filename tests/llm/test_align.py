"""Incidence products and the summary of alignments against brute force."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesselon.llm import align
from tesselon.llm.queries import tokenizer_file
from tesselon.llm.wordbpe import byte_symbols
from tests.llm.test_llm import ODD, SF, documents

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
TEXTS = [*ODD, "  two  blanks ", " ", "   ", "a\n  b \n\n c", "x▁y", "<s></s><unk>", "naïve Ünïcödé 🙂🙂 日本語\tx", "\r\n", "ab" * 500, "   　  x\xa0 y", "don't  we'll", "0x00 <0x41>", "  x"]


@pytest.fixture(scope="module")
def slow():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_symbols())}

    def encode(text):
        """(A's ids and byte ranges, B's) or None."""
        if not text:
            return None
        want, out = (" " + text).encode(), []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        parts = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids]
        named = b.encode(text)
        others = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in named)]
        for own, bits in ((ids, parts), (named, others)):
            if b"".join(bits) != want:
                return None
            ends = np.cumsum([len(x) for x in bits]).tolist()
            out.append(list(zip(own, [0, *ends], ends, strict=False)))
        return out

    return encode


def brute(encode, texts):
    got, held = [encode(t) for t in texts], collections.Counter()
    links = []
    for x in got:
        own = [] if x is None else [(i, j, a, b) for i, (a, s, e) in enumerate(x[0]) for j, (b, p, q) in enumerate(x[1]) if s < q and p < e]
        links.append(own)
        held.update({(a, b) for _, _, a, b in own})
    top = collections.defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    rows = []
    for x, own in zip(got, links, strict=True):
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        cuts = sorted({e for *_, e in x[0]} & {e for *_, e in x[1]})
        groups = [[[t for t, s, e in side if lo < e <= hi] for side in x] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(held[a, b] == top[a] for _, _, a, b in own)
        rows.append((len(x[0]), len(x[1]), len(groups), len(own), best, sum(held[a, b] for _, _, a, b in own), hashlib.sha256(text.encode()).hexdigest(), sum(len(p) * len(q) for p, q in groups)))
    return rows


@pytest.mark.parametrize("hot", [align.HOT, 300, 0])
def test_summary(spark, slow, hot, monkeypatch):
    texts = [t if t is None else t[:3000] for t in TEXTS] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts = [t if t is None or len(t) < 6000 else t[:6000] for t in texts]
    want = brute(slow, texts)
    got = align.summary(documents(spark, texts).repartition(3), A, B, hot=hot).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], texts[r.doc_id]


@pytest.mark.parametrize("limit", [50, 200_000])
def test_ids_are_the_libraries(slow, limit):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "’s", "日", "1", ".", "Ω", " ", "'ll", "▁", "\t"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    t = align.Tokenizers(A, B, limit)
    for at in range(0, len(texts), 50):
        for text, got in zip(texts[at : at + 50], t.encode(texts[at : at + 50]), strict=True):
            want = slow(text) or [[], []]
            assert [x.tolist() for x in got] == [[i for i, *_ in side] for side in want], text


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = ((rng.random(s) < 0.3) * rng.integers(1, 5, s) for s in ((7, 9), (9, 5)))
        sparse = [align.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], m[m > 0], m.shape[1]) for m in (x, y)]
        c = sparse[0] @ sparse[1]
        dense = np.zeros((7, 5), int)
        dense[np.repeat(np.arange(7), np.diff(c.start)), c.column] = c.value
        assert (dense == x @ y).all() and (sparse[0].reach(sparse[1]) == (x > 0).astype(int) @ (y > 0).sum(axis=1)).all()
        t = sparse[0].transposed()
        back = np.zeros((9, 7), int)
        back[np.repeat(np.arange(9), np.diff(t.start)), t.column] = t.value
        assert (back == x.T).all()


@pytest.mark.parametrize("entries", [1, 7, 1 << 18])
def test_links(spark, slow, monkeypatch, entries):
    monkeypatch.setattr(align, "ENTRIES", entries)
    texts = [t if t is None else t[:200] for t in TEXTS]
    t = align.tokenizers(A, B)
    for text in texts:
        x = slow(text)
        ids = next(iter(t.encode([text or ""])))
        assert (len(ids[0]) == 0) == (x is None)
        if x is None:
            continue
        got = (None, np.cumsum(t.a_table.size[ids[0]]), None, np.cumsum(t.b_table.size[ids[1]]))
        found = {(int(p), int(q)): int(k) for i, j, n in align.overlaps(got[1], got[3]) for p, q, k in zip(i, j, n, strict=True)}
        assert found == {(p, q): min(e, v) - max(s, u) for p, (_, s, e) in enumerate(x[0]) for q, (_, u, v) in enumerate(x[1]) if s < v and u < e}
        shared = [(int(p), int(q)) for i, j in align.shared_groups(got[1], got[3]) for p, q in zip(i, j, strict=True)]
        cuts = {e for *_, e in x[0]} & {e for *_, e in x[1]}
        of = lambda e: sum(c < e for c in cuts)
        assert sorted(shared) == sorted((p, q) for p, (*_, e) in enumerate(x[0]) for q, (*_, v) in enumerate(x[1]) if of(e) == of(v))
    if entries == 7:
        rows = align.links(documents(spark, texts), A, B).collect()
        want = sum(r[-1] for r in brute(slow, texts))
        assert len(rows) == want and sum(r.n_bytes > 0 for r in rows) == sum(r[3] for r in brute(slow, texts))


def test_odd_rows(spark, slow):
    d = documents(spark, ["a b", None, "", "a b"])
    both = d.unionByName(d.filter("doc_id = 3")).unionByName(d.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = align.summary(both, A, B).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 0, 1, 2, 3, 3]
    assert {r.count_sum for r in got if r.n_a} == {4 * next(r.n_links for r in got if r.n_a)}
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", 0) for r in got if r.doc_id in (1, 2))
    assert align.summary(d.limit(0), A, B).count() == 0 and align.links(d.limit(0), A, B).count() == 0


def test_long_texts_take_linear_time(spark):
    texts = [" " * 2_000_000, "ab" * 500_000, "x y " * 300_000]
    got = align.summary(documents(spark, texts), A, B).collect()
    assert all(r.n_links >= max(r.n_a, r.n_b) > 0 for r in got)


def test_vocabularies_can_be_cut():
    assert align.tokenizers(A, B).apart and json.load(open(A, encoding="utf-8"))["model"]["type"] == "BPE"
