"""Fingerprints, vantage-point trees and groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesselon.llm import simhash, store
from tests.llm.test_llm import LONG, ODD, SF, documents


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, fingerprints, radius=3):
    own = dict(zip(keys, keys, strict=True))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    fp = np.array(fingerprints, np.uint64)
    for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1)).tolist():
        a, b = sorted((find(keys[i]), find(keys[j])))
        own[b] = a
    return {k: find(k) for k in keys}


def drawn(rng, n):
    """Random fingerprints, dense groups around some of them, chains, and equal bits."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for centre in rng.sample(sorted(out), 4):
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(n // 4)}
    x = rng.getrandbits(64)
    for _ in range(n // 8):
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        out.add(x)
    return sorted(out | {0, (1 << 64) - 1, 1, 7})


@pytest.mark.parametrize("text", [*ODD, "a b", "A b C d", "x y z\x0bq\x1cr", "one two three"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("leaf", [1, 8, 64])
@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_all_that_is_connected(seed, leaf):
    rng = random.Random(seed)
    fp = np.array(drawn(rng, 400), np.uint64)
    member = np.array([rng.random() < 0.6 for _ in fp])
    found = simhash.links(fp, member, leaf=leaf)
    assert (np.bitwise_count(fp[found[:, 0]] ^ fp[found[:, 1]]) <= 3).all() and len(found) < len(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    near &= member[None, :] | member[:, None]
    linked = {k: k for k in range(len(fp))}

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    def labels(pairs):
        linked.update({k: k for k in linked})
        for i, j in pairs:
            a, b = sorted((find(i), find(j)))
            linked[b] = a
        return [find(k) for k in range(len(fp))]

    assert labels(found.tolist()) == labels(np.argwhere(np.triu(near, 1)).tolist())


def test_router_brings_every_near_pair_together_once():
    rng = random.Random(5)
    fp = np.array(drawn(rng, 1500), np.uint64)
    router = simhash.Router(fp[::7], 24)
    assert router.shards == 24
    homes, seen = np.full(len(fp), -1), {}
    for shard, own, home in router.route(fp, 3):
        assert (homes[own[home]] == -1).all()
        homes[own[home]] = shard
        seen[shard] = set(own.tolist())
    assert (homes >= 0).all()
    for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1)).tolist():
        assert j in seen[homes[i]] or i in seen[homes[j]]


@pytest.mark.parametrize("shard, members, queries", [(1 << 16, 1 << 17, 1 << 18), (60, 1 << 17, 1 << 18), (100, 50, 40)])
def test_pairs_over_shards_and_blocks(spark, shard, members, queries):
    fp = drawn(random.Random(9), 500)
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "fp long").repartition(5)
    with store.Scratch(spark) as scratch:
        rows = simhash.pairs(table, scratch, shard=shard, most_members=members, most_queries=queries).collect()
    number = {int(np.uint64(x).view(np.int64)): k for k, x in enumerate(fp)}
    own = list(range(len(fp)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for r in rows:
        assert (r.a ^ r.b).bit_count() <= 3 or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
        a, b = sorted((find(number[r.a]), find(number[r.b])))
        own[b] = a
    assert {k: find(k) for k in range(len(fp))} == slow_components(list(range(len(fp))), fp)


def test_groups_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(1)
    base = " ".join(rng.choice(["red", "green", "blue", "stone", "river"]) + str(rng.randrange(400)) for _ in range(900))
    extra = [*ODD, None, "", base, *(base.replace(f" {w} ", " other ", 1) for w in rng.sample(base.split()[1:-1], 40))]
    rows |= {100_000 + i: t for i, t in enumerate(extra)}
    got = simhash.groups(documents(spark, list(rows.values())).repartition(3)).collect()
    texts = list(rows.values())
    want = [slow_fingerprint(t) if t != LONG else simhash.fingerprint(t) for t in texts]
    joined = slow_components(list(range(len(texts))), want)
    assert len(got) == len(texts)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", joined[r.doc_id])
    assert len(set(joined.values())) < len(texts) - 40


def test_odd_rows(spark):
    d = documents(spark, ["a b c", None, "a b c", "x"])
    null = d.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))
    got = simhash.groups(d.unionByName(d.filter("doc_id = 2")).unionByName(null)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == [(-1, None), (0, 0), (1, 1), (2, 0), (2, 0), (3, 3)]
    assert {r.fingerprint for r in got if r.doc_id == 1} == {"0" * 16}
    assert simhash.groups(d.limit(0)).count() == 0
