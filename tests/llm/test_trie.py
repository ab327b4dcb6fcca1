"""The trie of conversations against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tesselon.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        made[c] = own.get(base, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in nodes if k), collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, convs=90, turns=8):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        copy = rng.choice([None, None, 7, 8])
        own = random.Random(copy) if copy else rng
        for t in range(own.randrange(turns)):
            rows.append((c, rng.choice([t, t, None]) if not copy else t, own.choice(["user", "bot", None, ""]), own.choice(["a b", "a", "", None, "x\ty z", "é"])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth long")


@pytest.mark.parametrize("seed, depth, shard, rows", [(0, 1024, 1 << 18, 1 << 18), (1, 1024, 20, 30), (2, 3, 15, 1 << 18), (4, 2, 40, 25)])
def test_trie(spark, seed, depth, shard, rows):
    given = drawn(seed) + [(1000, t, "user", "long") for t in range(16)] + [(1001, t, "user", "long") for t in range(15)] + [(-25, 0, "a", "b"), (-20, 1, "c", "d"), (None, 0, "x", "y")]
    given += rng_copies(given)
    got = trie.prefixes(table(spark, given).repartition(4), depth=depth, shard=shard, rows=rows).collect()
    assert sorted(map(tuple, got), key=str) == brute(given)


def rng_copies(rows):
    """Repeated rows are repeated turns."""
    return random.Random(1).sample(rows, 10)


def test_edges(spark):
    assert trie.prefixes(table(spark, [(1, 0, "a", "b")]).limit(0)).count() == 0
    assert trie.prefixes(table(spark, [(None, 0, "a", "b")])).count() == 0
    one = [(c, 0, None, None) for c in range(20, 30)]
    assert sorted(map(tuple, trie.prefixes(table(spark, one)).collect()), key=str) == brute(one)
    long = [(40, t, "u", "word " * (t % 5)) for t in range(150)] + [(60, 0, "u", "x" * 1_000_000)]
    assert sorted(map(tuple, trie.prefixes(table(spark, long), depth=64).collect()), key=str) == brute(long)


def test_tree_is_balanced():
    tree = trie.Tree()
    tree.insert_all([([k], [1], 1, k, None) for k in range(1023)])
    deepest, stack = 0, [(tree.down[0], 1)]
    while stack:
        n, d = stack.pop()
        if n >= 0:
            deepest = max(deepest, d)
            stack += [(tree.low[n], d + 1), (tree.high[n], d + 1)]
    assert deepest == 10
