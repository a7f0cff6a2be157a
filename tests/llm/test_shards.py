"""Differencing against a plain list version and all partitions, and the sharding query against both."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
import xxhash

from siltmark.llm import sharding
from siltmark.llm.queries import QUERIES
from siltmark.session import table

SF = "/root/testdata/sf0.001"


def plain(weights, parts):
    """Partial partitions in a list: the two of largest spread (the older first) are joined, lightest to heaviest, until one is left."""
    items = sorted(weights, key=lambda x: (-x[1], str(x[0])))
    have = [(k, [(0, [])] * (parts - 1) + [(w, [i])]) for k, (i, w) in enumerate(items)]
    age = len(have)
    while len(have) > 1:
        have.sort(key=lambda h: (-(h[1][-1][0] - h[1][0][0]), h[0]))
        (_, a), (_, b) = have[0], have[1]
        joined = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)], key=lambda s: s[0])
        low = joined[0][0]
        have = [*have[2:], (age, [(s - low, m) for s, m in joined])]
        age += 1
    return {i: k for k, (_, m) in enumerate(have[0][1]) for i in m} if have else {}


def sums(weights, to, parts):
    out = [0] * parts
    for i, w in weights:
        out[to[i]] += w
    return sorted(out)


@pytest.mark.parametrize("parts", [2, 3, 8])
def test_differencing_is_that_of_a_plain_list(parts):
    rng = random.Random(parts)
    for n in (0, 1, 2, 5, 17, 60):
        for most in (3, 1000, 10**9):
            weights = [(k, rng.randrange(1, most)) for k in range(n)]
            got = sharding.differencing(weights, parts)
            assert sums(weights, got, parts) == sums(weights, plain(weights, parts), parts) and set(got) == set(range(n))


@pytest.mark.parametrize("parts", [2, 3])
def test_differencing_is_near_the_best_of_all_partitions(parts):
    rng = random.Random(9)
    worse = []
    for _ in range(40):
        weights = [(k, rng.randrange(1, 200)) for k in range(8)]
        spread = lambda to: (s := sums(weights, to, parts))[-1] - s[0]  # noqa: B023, E731
        best = min(spread(dict(enumerate(p))) for p in itertools.product(range(parts), repeat=8))
        got = spread(sharding.differencing(weights, parts))
        assert best <= got <= max(w for _, w in weights)
        worse.append(got - best)
    assert sorted(worse)[20] <= 40  # half of them within a fifth of a large item


def test_query_is_a_plain_differencing_of_its_groups(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    size = {k: len(t.encode()) + 1 for k, t in texts.items()}
    group = {k: hashlib.sha256(t.encode()).digest() for k, t in texts.items()}
    heavy, light = defaultdict(int), defaultdict(int)
    for k, g in group.items():
        heavy[g] += size[k]
    total = sum(size.values())
    bundle = lambda g: (xxhash.xxh64(g, seed=42).intdigest() ^ (1 << 63)) % 4096  # noqa: E731  the sign does not matter modulo a power of two
    big = {g for g, n in heavy.items() if n * 64 * 8 > total}
    for g, n in heavy.items():
        if g not in big:
            light[bundle(g) % 4096] += n
    to = plain([(g, heavy[g]) for g in big] + list(light.items()), 8)
    want = defaultdict(int)
    for k, g in group.items():
        want[to[g] if g in big else to[bundle(g) % 4096]] += size[k]
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    got, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32(texts[r.doc_id].encode()), "bytes", None)
        got[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and sorted(got.values()) == sorted(want.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(group[r.doc_id], r.shard) for r in rows}) == len(set(group.values()))
